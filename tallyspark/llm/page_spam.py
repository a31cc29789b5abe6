"""Keyword-stuffed pages, link lists and tag lists (problem 10).

Method: recurrence analysis. A text becomes a sequence of terms in units (sentences, lines, items of a list). Units are
sentences, entries of registers, schedules and extracts (numbered or dated, ended by an amount, or a person's name;
each different entry once), or listed text. A page is looked at as a list if most of its letters are listed text. Of
listed text the gaps of each content term to its last occurrence are taken, and the autocorrelation for each lag of a
window: how often a position repeats the one so many places before. Everything is measured over windows of fixed
length or as gap statistics, so that a long page is judged like a short one. Keyword lists recur within the window
far more than prose or names, or at any lag with gaps that are alike (unnaturally regular repetition), or consist of
links or hash tags. Lists of many distinct nouns are spam if they offer goods for amounts or run on in small letters
without function words. Texts of sentences are spam only if content terms recur within the same sentence throughout,
so that repeated passages (questions and answers, quoted lines, forwarded letters) are none; sentences that recur
count once, recurring lines each time.

All texts of a batch are analysed together: terms are found by Arrow kernels, coded as integers, and counted in numpy.
Everything is counted over the whole text. Defined results: null, empty and blank texts, and texts of fewer
than ``LEAST_TERMS`` terms without links, are no spam; equal texts get equal results. Names in small letters, one to a
line and nothing else, cannot be told from keywords and count as such if they recur.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lags of the autocorrelation; terms of the window over which recurrence is measured.
LAGS = 12
WINDOW = 48
LEAST_TERMS = 8
#: A sentence: so many words and at least this share of function words among them.
SENTENCE_WORDS = 4
SENTENCE_FUNCTION_SHARE = 0.17
#: "Mostly": the share of a text's letters, each link as ``LINK_LETTERS``, that is listed text.
LIST_PART = 0.5
LINK_LETTERS = 20
#: Function words among what stands outside sentences: fewer in lists, "with zip" and "add to cart" included.
LIST_FUNCTION_SHARE = 0.25
#: Content terms that recur within the window, of a keyword or product list, with at least
#: this autocorrelation over the lags; or the share of terms that recur within their unit; or at a single lag.
WINDOW_RECURRENCE = 0.37
LIST_RECURRENCE = 0.02
LIST_INSIDE = 0.15
LIST_PEAK = 0.3
#: Repetition at any lag: share of content terms that repeat an earlier one, of those that occur three times or more,
#: and the largest mean spread of such a term's gaps in relation to their mean (random gaps: 1).
LIST_CYCLIC = 0.5
REGULAR = 0.5
#: So few distinct terms are repetition without any rule too.
LIST_WORN = 0.25
#: Share of the units outside sentences that are entries of registers, schedules and extracts.
RECORDS = 0.5
#: An entry that ends with an amount has at most so many words.
ENTRY_WORDS = 12
NAME_WORDS = 4
#: Lists of distinct nouns: offers of goods, at least so many and one for so many terms; or at least so many terms in
#: units with so few function words and capitals, and the share of such terms.
LEAST_OFFERS = 4
OFFER_TERMS = 12
LEAST_BARE = 20
BARE_FUNCTION = 0.05
BARE_CAPITALS = 0.2
BARE_PART = 0.8
#: Links per term of a link list, and hash tags per term of a tag list.
LINK_SHARE = 0.12
TAG_SHARE = 0.30
#: Keyword stuffing in sentences: content terms that recur within their sentence, per content term.
SENTENCE_RECURRENCE = 0.15

#: Frequent function words of the languages of the corpus (English, Pidgin, Yoruba, Hausa, Igbo).
FUNCTION_WORDS = frozenset(
    """a an the and or but of to in on at by for from with without as is are was were be been being am do does did
    has have had will would can could should may might must shall not no nor that this these those it its he she they
    we you i me my your his her our their them us him who whom whose which what when where why how if because so than
    then there here while until before after since each every any some all only also very more most other another
    about into over under between please
    dey don go una make wey wetin im dem abeg fit come still own dis dat sabi di say never see
    ti ní fún pé àti kí tó dé ń náà mo ó fi ẹ wọn ni sí sínú gbogbo bí nítorí pẹ̀lú jẹ́ kù jọ̀ọ́ jọ̀wọ́ e o
    na da ta ya yi cewa wa mu mun shi ne ce kafin domin ko kuma daga zuwa ba sai cikin za
    nke ka anyị ha maka tupu biko bụ nọ n'ime ime ga si gị ndị dị m ahụ naanị""".split()
)
#: Words of selling in the same languages; stock numbers (SKU...) count too.
OFFER_WORDS = frozenset("buy buying sale sell selling shop stock cart order offer offers deal deals discount delivery price checkout rà saya sayarwa zụọ zụta ọrịre".split())
_FUNCTION = pa.array(sorted({unicodedata.normalize("NFC", w) for w in FUNCTION_WORDS}))
_OFFER = pa.array(sorted({unicodedata.normalize("NFC", w) for w in OFFER_WORDS}))
_END, _BREAK, _LINKED = "\x03", "\x04", "\x05"
#: In order: what is replaced by what before a text is cut into terms. A host needs a path, or two dots, or a leading
#: www or scheme to be a link, so that a missing blank after a full stop makes none.
_REWRITE = (
    ("[\\x{ad}\\x{200b}-\\x{200d}\\x{feff}]", ""),
    ("[\\x00-\\x08]", " "),
    (r"(?i)(?:https?://|www\.)[^\s<>()\"'\]]+|\b(?:[a-z0-9][a-z0-9-]*\.)+[a-z]{2,24}[/?#][^\s<>()\"'\]]*|\b(?:[a-z0-9][a-z0-9-]*\.){2,}[a-z]{2,24}\b|\]\(/[^\s)]*", f" {_LINKED} "),
    (f"<[^<>{_LINKED}]*{_LINKED}[^<>]*>", f" {_LINKED} "),
    ("</?[A-Za-z][^<>]*>", " "),
    (r"[.!?]+(?:[\s\"')\]]|$)", f" {_END} "),
    ("[\n\r;•|»]+", f" {_BREAK} "),
)
_BETWEEN = f"[^\\p{{L}}\\p{{M}}\\p{{N}}{_END}-{_LINKED}#'’]+"
_LETTERS = str.maketrans("013458", "oieasb")


def _flags(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(bool)


class _Terms:
    """The terms of a batch of texts: arrays with one element per term, number or mark."""

    def __init__(self, texts: pa.Array):
        t = pa.array([x if x.isascii() else unicodedata.normalize("NFC", x) for x in pc.fill_null(texts.cast(pa.string()), "").to_pylist()], pa.string())
        for pattern, by in _REWRITE:
            t = pc.replace_substring_regex(t, pattern, by)
        lists = pc.split_pattern_regex(t, _BETWEEN)
        values = lists.flatten().dictionary_encode()
        different = pc.utf8_trim(values.dictionary, "'’")
        bare = pc.utf8_ltrim(different, "#")
        low = pc.replace_substring(pc.utf8_lower(bare), "’", "'")
        number, letter = _flags(pc.match_substring_regex(low, r"\p{N}")), _flags(pc.match_substring_regex(low, r"\p{L}"))
        plain = np.array(low.to_pylist(), object)
        mixed = number & letter
        plain[mixed] = [w.translate(_LETTERS) for w in plain[mixed]]
        code = pa.array(plain, pa.string()).dictionary_encode()
        of = values.indices.to_numpy(zero_copy_only=False)
        used = _flags(pc.not_equal(low, ""))[of]
        of = of[used]
        self.doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))[used]
        take = lambda x: x[of]
        self.code = take(code.indices.to_numpy(zero_copy_only=False))
        self.end, self.stop, self.link = (take(_flags(pc.equal(low, m))) for m in (_END, _BREAK, _LINKED))
        self.size = take(np.where(_flags(pc.equal(low, _LINKED)), LINK_LETTERS, pc.utf8_length(bare).to_numpy(zero_copy_only=False)))
        self.tag = take(_flags(pc.starts_with(different, "#")))
        self.number = take(number & ~letter)
        self.amount = take(number & ~letter & (pc.utf8_length(low).to_numpy(zero_copy_only=False) >= 3))
        self.capital = take(_flags(pc.utf8_is_upper(pc.utf8_slice_codeunits(bare, 0, 1))))
        self.function = take(_flags(pc.is_in(pa.array(plain, pa.string()), _FUNCTION)))
        self.offer = take(_flags(pc.is_in(pa.array(plain, pa.string()), _OFFER)) | _flags(pc.starts_with(low, "sku")))
        self.content = ~(self.end | self.stop | self.link | self.number | self.function) & (self.size >= 3)


def _before(group: np.ndarray, code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, gap): the places sorted by group, code and position, and the gap to the one before with the same group and
    code, or 0."""
    order = np.lexsort((at, code, group))
    g, c, a = group[order], code[order], at[order]
    same = np.zeros(len(order), bool)
    same[1:] = (g[1:] == g[:-1]) & (c[1:] == c[:-1])
    gap = np.zeros(len(order), np.int64)
    gap[1:] = np.where(same[1:], a[1:] - a[:-1], 0)
    return order, gap


def _first(*keys: np.ndarray) -> np.ndarray:
    """Whether each row is the first with its keys."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    for k in range(1, len(order) and 2):
        new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in keys])
    out = np.zeros(len(order), bool)
    out[order] = new
    return out


def figures(texts: pa.Array) -> dict[str, np.ndarray]:
    """The figures that the decision uses, one element per text."""
    n = len(texts)
    t = _Terms(texts)
    mark = t.end | t.stop
    begins = np.ones(len(t.doc), bool)
    begins[1:] = mark[:-1] | (t.doc[1:] != t.doc[:-1])
    unit = np.cumsum(begins) - 1
    units = int(unit[-1]) + 1 if len(unit) else 0
    start = np.flatnonzero(begins)
    of_doc = t.doc[start]
    total = lambda x: np.bincount(unit, weights=x, minlength=units)
    term = ~(mark | t.number)
    words, links, tags, function, capitals = total(term), total(t.link), total(t.tag & term), total(t.function & term), total(t.capital & term)
    letters, amounts, offered, ended = total(np.where(mark, 0, t.size)), total(t.amount), total(t.offer & term), total(t.end) > 0
    leads = t.number[start]
    alone = leads & (words == 0) & ended  # the number of an entry is followed by a full stop
    numbered = leads & (words > 0)
    numbered[1:] |= alone[:-1] & (of_doc[1:] == of_doc[:-1])
    last = np.append(start[1:], len(unit)) - 1
    last = np.where((last > start) & mark[last], last - 1, last) if units else last
    second = np.minimum(start + 1, len(unit) - 1) if units else start
    named = t.capital[start] & t.capital[second] & (capitals >= words - 1) if units else np.zeros(0, bool)  # a name, and a word at most
    priced = t.number[last] & (words > 0) if units else np.zeros(0, bool)
    real = words - links
    sentence = ended & (real >= SENTENCE_WORDS) & (function >= SENTENCE_FUNCTION_SHARE * real) & (function >= 3 * links) & (tags < real / 2)
    # what a unit says: a digest of its terms in order, and of all but its number
    weight = np.random.default_rng(20_240_601).integers(1, 1 << 62, int(t.code.max()) + 1 if len(t.code) else 1, dtype=np.int64).view(np.uint64) * 2 + 1
    place = np.arange(len(unit)) - start[unit] if units else np.zeros(0, int)
    behind = np.cumsum(term) - np.cumsum(term)[start][unit] + term[start][unit] if units else place  # terms so far
    said = lambda keep, rank: _hashed(unit, units, np.where(keep, weight[t.code] * (2 * rank.astype(np.uint64) + 1), 0))
    spoken = said(term, behind)
    dates = total(t.number & (behind == 0)) >= 2  # a date or a time leads, not the number of an entry
    entry = said(term | (t.number & ((behind > 0) | dates[unit])), place - np.where(leads, 1, 0)[unit] if units else place)
    some = words > 0
    record = some & (links == 0) & (tags == 0) & (numbered | (priced & (words <= ENTRY_WORDS)) | ((words >= 2) & (words <= NAME_WORDS) & named))
    single = np.zeros(units, bool)
    k = np.flatnonzero(record)
    single[k] = _first(of_doc[k], entry[k])
    # numbered, dated or timed entries may recur where most of them are still different
    dated = record & numbered
    kinds = np.bincount(of_doc, weights=single & dated, minlength=n) / np.maximum(1, np.bincount(of_doc, weights=dated, minlength=n))
    single |= dated & (kinds[of_doc] >= LIST_WORN)
    once = np.ones(units, bool)  # equal sentences count once
    k = np.flatnonzero(sentence & (links == 0))
    once[k] = _first(of_doc[k], spoken[k])
    some &= once
    outside = some & ~sentence
    listed = outside & ~single
    per = lambda keep, x: np.bincount(of_doc[keep], weights=np.broadcast_to(x, units)[keep], minlength=n)
    share = lambda x, y: x / np.maximum(1, y)
    list_terms = per(listed, words)
    bare = listed & ~ended & ~record & (function <= BARE_FUNCTION * words) & (capitals <= np.maximum(1, BARE_CAPITALS * words))
    out = {
        "terms": per(some, words), "list_terms": list_terms, "list_part": share(per(listed, letters), per(some, letters)), "links": per(listed, links),
        "link_share": share(per(listed, links), list_terms), "tag_share": share(per(listed, tags), list_terms), "list_function": share(per(listed, function), list_terms),
        "records": share(per(single & outside, 1.0), per(outside, 1.0)), "offers": per(listed & ~record, np.minimum(amounts, offered)), "bare": per(bare, words),
    }
    # recurrence of content terms of listed text; positions count all its terms
    keep = listed[unit] & term if units else term
    at = np.cumsum(keep)
    k = np.flatnonzero(keep & t.content)
    doc, code, where, own = t.doc[k], t.code[k], at[k], unit[k]
    order, gap = _before(doc, code, where)
    d, again = doc[order], gap > 0
    m = np.bincount(doc, minlength=n)
    count = lambda x: np.bincount(d, weights=x, minlength=n)
    inside = again & (gap <= LAGS)
    inside[1:] &= own[order][1:] == own[order][:-1]
    # gaps of terms that have two or more: their share, and their spread in relation to their mean
    run = np.cumsum(~again) - 1
    gaps = np.bincount(run, weights=again, minlength=1)
    mean = np.bincount(run, weights=gap, minlength=1) / np.maximum(1, gaps)
    spread = np.sqrt(np.maximum(0, np.bincount(run, weights=gap.astype(float) ** 2, minlength=1) / np.maximum(1, gaps) - mean**2)) / np.maximum(1e-9, mean)
    often = again & (gaps[run] > 1) if len(run) else again
    out |= {
        "list_recurrence": share(count(again & (gap <= LAGS)), m), "list_inside": share(count(inside), m), "list_window": share(count(again & (gap <= WINDOW)), m),
        "list_distinct": share(m - count(again), m), "list_cyclic": share(count(often), m), "gap_spread": share(count(np.where(often, spread[run], 0) if len(run) else often), count(often)),
    }
    # autocorrelation at each lag of the sequence of content terms; the highest
    peak = np.zeros(n)
    for lag in range(1, LAGS + 1):
        if lag < len(code):
            equal = (code[lag:] == code[:-lag]) & (doc[lag:] == doc[:-lag])
            peak = np.maximum(peak, np.bincount(doc[lag:], weights=equal, minlength=n) / np.maximum(LEAST_TERMS, m - lag))
    out["peak"] = peak
    # recurrence within units of the whole text, equal units of several words once
    only = some.copy()
    k = np.flatnonzero(some & (words >= SENTENCE_WORDS) & (links == 0))
    only[k] = _first(of_doc[k], spoken[k])
    keep = only[unit] & term if units else term
    k = np.flatnonzero(keep & t.content)
    order, gap = _before(unit[k], t.code[k], np.cumsum(keep)[k])
    out["inside"] = share(np.bincount(t.doc[k][order], weights=(gap > 0) & (gap <= LAGS), minlength=n), np.bincount(t.doc[k], minlength=n))
    return out


def _hashed(unit: np.ndarray, units: int, values: np.ndarray) -> np.ndarray:
    """The sum modulo 2^64 of the values of each unit."""
    start = np.flatnonzero(np.diff(unit, prepend=-1))
    return np.add.reduceat(values, start) if units else np.zeros(0, np.uint64)


def decide(x: dict[str, np.ndarray]) -> np.ndarray:
    """Whether each text is spam, from its figures."""
    mostly = (x["list_part"] >= LIST_PART) & (x["list_terms"] >= LEAST_TERMS)
    linked = (x["links"] >= 3) & (x["link_share"] >= LINK_SHARE)
    stuffed = (x["tag_share"] >= TAG_SHARE) | (x["list_inside"] >= LIST_INSIDE) | (x["peak"] >= LIST_PEAK) | ((x["list_window"] >= WINDOW_RECURRENCE) & (x["list_recurrence"] >= LIST_RECURRENCE))
    entries = x["records"] >= RECORDS
    regular = (x["list_cyclic"] >= LIST_CYCLIC) & ((x["gap_spread"] <= REGULAR) | (x["list_distinct"] <= LIST_WORN)) & ~entries
    offers = (x["offers"] >= LEAST_OFFERS) & (x["offers"] * OFFER_TERMS >= x["list_terms"])
    bare = (x["bare"] >= LEAST_BARE) & (x["bare"] >= BARE_PART * x["list_terms"])
    keywords = (x["list_function"] < LIST_FUNCTION_SHARE) & (stuffed | regular | ((offers | bare) & ~entries))
    return (mostly & (linked | keywords)) | ((x["terms"] >= LEAST_TERMS) & (x["inside"] >= SENTENCE_RECURRENCE))


def is_spam(text: str | None) -> bool:
    return bool(decide(figures(pa.array([text], pa.string())))[0])


@F.arrow_udf(T.BooleanType())
def _spam(texts: pa.Array) -> pa.Array:
    return pa.array(decide(figures(texts)))


_spam = _spam.asNondeterministic()  # run once, also under filters


def spam(text: Column) -> Column:
    """Whether a text is mostly keywords, links or tags instead of sentences; never null."""
    return _spam(text.cast("string"))


def spam_pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key) of the pages found."""
    return docs.select(F.col(f"`{key}`").alias(key), spam(F.col(f"`{text}`")).alias("_spam")).where("_spam").select(key)
