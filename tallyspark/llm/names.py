"""Comparing short payment texts and person names that were copied with small damage.

Plain Python for use inside Arrow functions; every function is deterministic and keeps bounded caches only.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Words of payment texts that name nobody. Typing errors in the longer ones are recognised by ``is_filler``.
FILLERS = frozenset(
    """a abeg acct agent alert also an and app at balance bank be being bus by cash charge charges child children class
    collect credit debit deposit dis don exam fee fees first for form from frm general half i in inward is kindly kudin
    kudi kuɗin lesson levy make make me mobile money mob my na naira ngn nip no o of off on one online our own paid
    part pay paying payment payments pls please pos purpose pymt ref second sch schl school session settlement tellers
    teller term terms thank thanks the third this tlr to transfer trf tuition uniform usd via wan web with ya biya
    domin makaranta owo ile iwe owó ilé ìwé fún fun ego ụlọ akwụkwọ maka ugwo ụgwọ""".split()
)
TITLES = frozenset("mr mrs ms miss dr prof chief alhaji alhaja engr barr pastor rev sir mallam hajia madam".split())
_CLASS = re.compile(r"^(?:jss|js|ss|sss|pry|pri|p|primary|nursery|nur|n|kg|creche|basic|year|yr|grade|class)?[0-9]{0,2}[a-e]?$")
_RUN = re.compile(r"[^\W_]+")
_LOOKALIKE = str.maketrans("013458", "oieasb")


def plain(text: str | None) -> str:
    """Lower case without accents."""
    if not text:
        return ""
    if text.isascii():
        return text.lower().replace("'", "")
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c)).replace("'", "").replace("’", "")


@lru_cache(maxsize=500_000)
def _letters(token: str) -> int:
    """The characters that occur, as bits; an edit changes two of them at most."""
    bits = 0
    for c in token:
        bits |= 1 << (ord(c) & 63)
    return bits


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with adjacent transpositions as one edit, or most + 1 if it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most or (_letters(a) ^ _letters(b)).bit_count() > 2 * most:
        return most + 1
    if len(a) > len(b):
        a, b = b, a
    two: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, two[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        two, row = row, now
    return min(row[-1], most + 1)


def slack(n: int) -> int:
    """Edits allowed between two tokens of n characters."""
    return 0 if n < 3 else 1 if n < 6 else 2


@lru_cache(maxsize=500_000)
def fold(token: str) -> str:
    """Digits that stand for letters inside a word, as letters."""
    return token.translate(_LOOKALIKE) if not token.isdigit() and any(c.isalpha() for c in token) else token


@lru_cache(maxsize=100_000)
def is_class(token: str) -> bool:
    return bool(_CLASS.match(token))


def _shortened(word: str) -> set[str]:
    return {word[:k] + word[k + 1 :] for k in range(len(word))}


_LONG = [f for f in FILLERS if len(f) >= 5]
#: Every long filler under itself and its forms with one letter less: near words share such a form.
_NEAR: dict[str, list[str]] = {}
for _filler in sorted(_LONG):
    for _form in {_filler, *_shortened(_filler)}:
        _NEAR.setdefault(_form, []).append(_filler)


@lru_cache(maxsize=500_000)
def is_filler(token: str) -> bool:
    """A word that names nobody, also with one typing error if it has at least five letters."""
    folded = fold(token)
    if token in FILLERS or folded in FILLERS or is_class(token) or token in ("1st", "2nd", "3rd"):
        return True
    if len(folded) < 5:
        return False
    return any(distance(folded, f, 1) <= 1 for form in (folded, *_shortened(folded)) for f in _NEAR.get(form, ()))


@lru_cache(maxsize=50_000)
def name_tokens(text: str | None) -> tuple[str, ...]:
    """The folded words of a text that may name somebody; short ones too."""
    return tuple(fold(t) for t in _RUN.findall(plain(text)) if not is_filler(t) and t not in TITLES)


@lru_cache(maxsize=50_000)
def all_tokens(text: str | None) -> tuple[str, ...]:
    return tuple(fold(t) for t in _RUN.findall(plain(text)))


def unmatched(one: tuple[str, ...], other: tuple[str, ...]) -> int:
    """How many tokens of ``one`` have no like in ``other``: no near token, and no place in its run-together form."""
    joined = "".join(other)
    return sum(
        not (t in other or (len(t) > 2 and t in joined) or any(distance(t, u, slack(min(len(t), len(u)))) <= slack(min(len(t), len(u))) for u in other))
        for t in one
    )


def same_names(a: str | None, b: str | None) -> bool:
    """Whether two texts may name the same people: not both have a name that the other lacks. Texts that name
    nobody agree only if their words do."""
    x, y = name_tokens(a), name_tokens(b)
    if not x or not y:
        x, y = all_tokens(a), all_tokens(b)
        return not (unmatched(x, y) and unmatched(y, x))
    left, right = unmatched(x, y), unmatched(y, x)
    if left and right:
        return distance("".join(sorted(x)), "".join(sorted(y)), 2) <= 2
    return left + right < len(x) + len(y)


def same_person(a: str | None, b: str | None) -> bool:
    """Whether two person names may be one person's: initials stand for names, titles do not matter, and not
    both have a part that the other lacks. Two missing names agree; a missing one and a given one do not."""
    return same_words([fold(t) for t in _RUN.findall(plain(a)) if t not in TITLES], [fold(t) for t in _RUN.findall(plain(b)) if t not in TITLES])


def same_words(x: list[str], y: list[str]) -> bool:
    """``same_person`` for names whose words are known, without titles."""
    if x == y:
        return True
    if not x or not y:
        return not x and not y
    if "".join(sorted("".join(x))) == "".join(sorted("".join(y))):
        return True
    left, right = sorted(x, key=len, reverse=True), sorted(y, key=len, reverse=True)
    matched = 0
    for exact in (True, False):  # full words first, the nearer the better
        for t in [t for t in left if len(t) > 1]:
            for u in [u for u in right if len(u) > 1]:
                s = 0 if exact else slack(min(len(t), len(u)))
                if distance(t, u, s) <= s:
                    left.remove(t)
                    right.remove(u)
                    matched += 1
                    break
    for t in list(left):  # then initials
        for u in right:
            if (len(t) == 1 or len(u) == 1) and t[:1] == u[:1]:
                left.remove(t)
                right.remove(u)
                break
    if matched == 0:
        return distance("".join(sorted(x)), "".join(sorted(y)), 2) <= 2 or distance("".join(x), "".join(y), 2) <= 2
    if left and right:
        return distance("".join(sorted(x)), "".join(sorted(y)), 2) <= 2 or distance("".join(x), "".join(y), 2) <= 2
    return True
