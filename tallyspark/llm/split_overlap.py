"""Evaluation cases that are also, exactly or almost, in training (problem 3).

Method: passages of the evaluation entries are looked up in all training texts. A passage is a part of a word, its beginning
or its end, beside a part of another word of the same name; two words of a student run together are one word too. So is a
part of a student's word beside a whole word of the payer, and the letters of all student names in any
order. An evaluation word has one part at either end; a training word all parts that an evaluation word of up to two
letters more or less may have, so a damaged word keeps one part. Records have passages in common only if they name as many students.

A passage is a hash of 63 bits, not verified: a stray one is compared like any other. The passages of evaluation are written to
the shared folder in order, in shards of ranges of hashes, at most about ``SHARD`` to one. Every task looks its own part of the
training texts up in place, each of their passages in the one shard that may hold it; so the work grows with the passages
and those that are met, not with training times evaluation. What is met must fit by signatures of payer and students, which tell
apart only names that ``names.same_words`` tells apart; the training entries that are left go to the evaluation entries they met.
There the letters of an entry that the training text matches are merged into its coverage, and entries covered by at
least ``COVERED`` (or whose student letters are all found) are compared as wholes: payer, every student, and narration
without collecting-group code.

Cases that agree in all texts are one entry; links are between entries, with a membership table, and pairs of cases
are made from them only where the result is defined as pairs. Defined results: a case whose split is neither
train nor an evaluation split takes no part; missing texts are empty ones, and cases without payer and
students match nothing; repeated case numbers count once per text; texts of any length are read as a whole.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm import names
from tallyspark.operators.skew import join_summaries
from tallyspark.session import cut, cut_table, shared_table

TRAIN, EVALUATION = "train", ("val", "test")
#: Share of the letters of an evaluation case's names that a training text must cover to be compared.
COVERED = 0.5
#: Least likeness of two narrations of one record.
LIKENESS = 0.65
#: Passages of a shard and evaluation entries of a table of signatures (about 32 MB each in a task).
SHARD = 2_000_000
SIGNED = 400_000
#: Training passages that a task looks up at once, and pairs of entries that it judges at once.
HELD = 6_000_000
BLOCK = 500_000
JUDGED = 2_000_000
#: Letters of a word's part at least; shorter words stand as they are.
LEAST_PART = 3
_CODE = re.compile(r"(?<![^\W_])[A-Za-z]{3}[\s./_-]?[0-9]{4}(?![^\W_])")
_COURTESY = frozenset("thanks thank thx tnx pls please plz from mum dad mama papa via o ref app urgent god bless".split())


#: Words for paying in general: exchanging them changes the wording, not the purpose.
_PAYING = frozenset("fee fees due dues payment payments pymt pay paid charge charges bill bills bal balance".split())


def words(text: str | None) -> list[str]:
    return [names.fold(t) for t in re.findall(r"[^\W_]+", names.plain(text))]


def parts(word: str) -> tuple[str, str]:
    """A word's beginning and end; they overlap in short words."""
    size = max(LEAST_PART, (len(word) + 1) // 2)
    return word[:size], word[max(0, len(word) - size) :]


def _letters(students: list[list[str]]) -> str:
    return "=" + "".join(sorted("".join(w for s in students for w in s))) + "|"


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def _spelt(words_: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, start, size): the letters of all words as numbers, and where each word's begin and how many they are."""
    size = np.fromiter(map(len, words_), np.int64, len(words_))
    letters = np.frombuffer("".join(words_).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return letters, np.cumsum(size) - size, size


def _sums(of: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The sums of the ranges of an array; they wrap around."""
    total = np.concatenate([np.zeros((1, *of.shape[1:]), of.dtype), np.cumsum(of, 0, dtype=of.dtype)])
    return total[stop] - total[start]


def _pieces(words_: list[str], many: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of every word: the hashes of the word and of its beginnings and ends, 0 in free places, one part at either end or (many)
    up to three that a word of nearly its length may have; and a sum for its letters, the same in any order."""
    letters, start, size = _spelt(words_)
    place = np.arange(len(letters)) - np.repeat(start, size)
    power = np.cumprod(np.full(size.max(initial=0) + 1, _ODD[0]))
    ahead, back = (letters + np.uint64(1)) * power[place], (letters + np.uint64(1)) * power[np.repeat(size, size) - 1 - place]
    end = start + size
    out, last = [_mixed(_sums(ahead, start, end))], np.zeros(len(size), np.int64)
    for more in (-1, 0, 1) if many else (0,):
        part = np.maximum(LEAST_PART, (size + 1) // 2 + more)
        fits = (part <= size) & (part > last)
        part = last = np.where(fits, part, last)
        some = np.minimum(part, size)
        out += [np.where(fits, _mixed(x), np.uint64(0)) for x in (_sums(ahead, start, start + some) + _ODD[1], _sums(back, end - some, end) + _ODD[2])]
    return np.stack(out, 1), _sums(_mixed(letters * _ODD[2]), start, end)


def _meet(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of every two equal numbers of two arrays, of which the right one is in order."""
    start = np.searchsorted(right, left)
    return _spread(start, np.searchsorted(right, left, "right") - start)


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the ranges, and the place in it, of every place of the ranges (start, count)."""
    which = np.repeat(np.arange(len(start)), count)
    return which, np.arange(len(which)) + np.repeat(start - (np.cumsum(count) - count), count)


def passages(payers: pa.ListArray, students: pa.ListArray, many: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, hashes) of the passages of a batch of entries, in blocks; many for training."""
    n, each = len(payers), students.flatten()
    home = pc.list_parent_indices(students).to_numpy()
    at, paid = pc.list_parent_indices(each).to_numpy(), pc.list_parent_indices(payers).to_numpy()
    own, of_payer = each.flatten(), payers.flatten()
    beside = np.flatnonzero(at[1:] == at[:-1])
    joined = pc.binary_join_element_wise(own.take(pa.array(beside)), own.take(pa.array(beside + 1)), "")
    # empty arrays that come from Spark have no offsets
    coded = pa.concat_arrays([pa.array([], pa.string()), *(x.cast(pa.string()) for x in (own, of_payer, joined) if len(x))]).dictionary_encode()
    words_ = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pieces, letters = _pieces(words_, many)
    long = (pieces[:, 1] != 0)[code]
    own, of_payer, joined = np.split(code, [len(at), len(at) + len(paid)])
    own_long, paid_long, joined_long = np.split(long, [len(at), len(at) + len(paid)])
    filled = np.bincount(home[np.unique(at)], minlength=n)  # students with a name
    bounds = np.searchsorted(home[at], np.arange(n + 1))
    whole = _mixed(_sums(letters[own], bounds[:-1], bounds[1:]) + filled.astype(np.uint64))
    # groups: every student, then the payer of every row; words of the group, and the payer's beside a student's
    first, second = own[beside][joined_long], own[beside + 1][joined_long]
    at_long, at_joined, paid = at[own_long], at[beside][joined_long], paid[paid_long]
    own, of_payer, joined = own[own_long], of_payer[paid_long], joined[joined_long]
    student, k = _meet(home, paid)
    row = np.concatenate([home, np.arange(n)]).astype(np.int64)
    w = max(1, len(words_))
    wholes = np.unique(student * w + of_payer[k])
    halved, of = np.unique(np.concatenate([at_long, paid + len(home), at_joined]) * w + np.concatenate([own, of_payer, joined]), return_index=True)
    none = np.full(len(own) + len(of_payer), -1)
    first, second = (np.concatenate([none, x])[of] for x in (first, second))
    group, word = halved // w, halved % w
    what = (filled[row[group]] * 2 + (group >= len(home))).astype(np.uint64) * _ODD[2]
    part = pieces[word, 1:]

    def blocks(start: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ends = np.cumsum(count)
        bounds = np.unique(np.searchsorted(ends, np.arange(BLOCK, (ends[-1] if len(ends) else 0) + BLOCK, BLOCK)))
        for some in np.split(np.arange(len(start)), bounds[bounds < len(start)]):
            i, k = _spread(start[some], count[some])
            yield some[i], k

    start = np.searchsorted(wholes, group * w)
    for i, k in blocks(start, np.searchsorted(wholes, group * w + w) - start):
        whole_word = wholes[k] % w
        real = (part[i] != 0) & (whole_word != word[i])[:, None]
        # a word says nothing beside that end of two joined words that it makes itself
        real[:, 0::2] &= (whole_word != first[i])[:, None]
        real[:, 1::2] &= (whole_word != second[i])[:, None]
        yield np.repeat(row[group[i]], real.sum(1)), ((part[i] * _ODD[1] + (pieces[whole_word, 0] * _ODD[0] + what[i])[:, None])[real] >> np.uint64(1)).astype(np.int64)
    start = np.arange(len(halved)) + 1
    for i, k in blocks(start, np.searchsorted(group, group, "right") - start):
        # two joined words have nothing beside their own words, nor beside others joined
        apart = (first[i] != word[k]) & (second[i] != word[k]) & (first[k] != word[i]) & (second[k] != word[i]) & ((first[i] < 0) | (first[k] < 0))
        i, k = i[apart], k[apart]
        for one in range(part.shape[1]):
            real = (part[i, one] != 0)[:, None] & (part[k] != 0)
            yield np.repeat(row[group[i]], real.sum(1)), (((part[i, one] + what[i])[:, None] + part[k])[real] >> np.uint64(1)).astype(np.int64)
    some = np.flatnonzero(filled)
    yield some, (whole[some] >> np.uint64(1)).astype(np.int64)


#: Words of a name and students of an entry that a signature tells; longer ones fit all others.
TOLD = 3
_UNTOLD = -1


def signatures(people: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(words, letters) of every name, to tell most different ones apart. words: [names, TOLD], of a word 20 bits for the
    letters that occur, 5 for its size, 5 for its first letter; letters: how often they occur, in 16 classes."""
    coded = people.flatten().cast(pa.string()).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = pc.list_parent_indices(people).to_numpy()
    letters, start, size = _spelt(coded.dictionary.to_pylist())
    letters, of = letters.astype(np.int64), np.repeat(np.arange(len(size)), size)
    mask = (np.bincount(of * 20 + letters % 20, minlength=20 * len(size)).reshape(-1, 20) > 0) << np.arange(20)
    signed = (mask.sum(1) | np.minimum(size, 31) << 20 | (letters[start] & 31) << 25).astype(np.int32)
    bag = np.bincount(of * 16 + (letters & 15), minlength=16 * len(size)).reshape(-1, 16)
    bounds = np.searchsorted(row, np.arange(len(people) + 1))
    place = np.arange(len(row)) - bounds[row]
    words_ = np.zeros((len(people), TOLD), np.int32)
    words_[row[place < TOLD], place[place < TOLD]] = signed[code[place < TOLD]]
    words_[np.diff(bounds) > TOLD] = _UNTOLD
    often = np.minimum(15, _sums(bag[code], bounds[:-1], bounds[1:])).astype(np.uint64) << np.arange(0, 64, 4, dtype=np.uint64)
    return words_, often.sum(1, dtype=np.uint64).view(np.int64)


def may_agree(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """False only where ``names.same_words`` is false. a, x: the words of one name's signature and of another's; b, y: the letters."""
    swap = ((a != 0).sum(1) > (x != 0).sum(1))[:, None]
    few, many = np.where(swap, x, a), np.where(swap, a, x)
    every = np.ones(len(a), bool)
    for k in range(TOLD):
        p = few[:, k]
        some = p == 0
        for m in range(TOLD):
            q = many[:, m]
            n, o = p >> 20 & 31, q >> 20 & 31
            least = np.minimum(n, o)
            edits = np.where(least < 3, 0, np.where(least < 6, 1, 2))
            near = (np.bitwise_count((p ^ q) & 0xFFFFF) <= 2 * edits) & ((np.abs(n - o) <= edits) | (np.maximum(n, o) == 31))
            some |= np.where(least == 1, (p ^ q) >> 25 & 31 == 0, near) & (q != 0)
        every &= some
    none = few[:, 0] == 0
    out = (every & (~none | (many[:, 0] == 0))) | (a[:, 0] == _UNTOLD) | (x[:, 0] == _UNTOLD)
    rest = np.flatnonzero(~out & ~none)
    low = np.uint64(0x0F0F0F0F0F0F0F0F)
    b, y = b[rest].view(np.uint64), y[rest].view(np.uint64)
    far = np.zeros(len(rest), np.int64)
    for p, q in ((b & low, y & low), (b >> np.uint64(4) & low, y >> np.uint64(4) & low)):
        far += np.abs(p.view(np.int8).reshape(-1, 8) - q.view(np.int8).reshape(-1, 8)).sum(1)
    out[rest] = far <= 4
    return out


def signed(payers: pa.ListArray, students: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(words, letters) of the payer and of at most ``TOLD`` students with a name of every entry: [entries, 1 + TOLD, TOLD], [entries, 1 + TOLD]."""
    words_, letters = np.zeros((len(payers), 1 + TOLD, TOLD), np.int32), np.zeros((len(payers), 1 + TOLD), np.int64)
    words_[:, 0], letters[:, 0] = signatures(payers)
    w, b = signatures(students.flatten())
    some = w[:, 0] != 0
    row = pc.list_parent_indices(students).to_numpy()[some]
    bounds = np.searchsorted(row, np.arange(len(payers) + 1))
    place = np.arange(len(row)) - bounds[row]
    told = place < TOLD
    words_[row[told], place[told] + 1], letters[row[told], place[told] + 1] = w[some][told], b[some][told]
    words_[np.diff(bounds) > TOLD, 1:] = _UNTOLD
    return words_, letters


def may_be_same(one: tuple[np.ndarray, np.ndarray], i: np.ndarray, other: tuple[np.ndarray, np.ndarray], j: np.ndarray) -> np.ndarray:
    """False only where ``same_record`` is false, for rows i and j of two ``signed`` that have as many students with a name."""
    (a, b), (x, y) = one, other
    out = may_agree(a[i, 0], b[i, 0], x[j, 0], y[j, 0])
    for k in range(1, 1 + TOLD):
        at = np.flatnonzero(out & (a[i, k, 0] != 0))
        some = np.zeros(len(at), bool)
        for m in range(1, 1 + TOLD):
            left = np.flatnonzero(~some & (x[j[at], m, 0] != 0))
            l, r = i[at[left]], j[at[left]]  # noqa: E741
            some[left] = may_agree(a[l, k], b[l, k], x[r, m], y[r, m])
        out[at] = some
    return out


def same_students(one: list[list[str]], other: list[list[str]]) -> bool:
    left, right = [x for x in one if x], [x for x in other if x]
    if len(left) != len(right) or not left:
        return False
    for x in left:
        best = next((y for y in right if names.same_words(x, y)), None)
        if best is None:
            return False
        right.remove(best)
    return True


def _lacks(one: list[str], other: list[str]) -> bool:
    joined = "".join(other)
    return any(
        len(t) > 2
        and t not in joined
        and not any(len(u) > 2 and (t.startswith(u) or u.startswith(t)) or names.distance(t, u, names.slack(max(len(t), len(u)))) <= names.slack(max(len(t), len(u))) for u in other)
        for t in one
        if t not in _COURTESY and t not in _PAYING
    )


def same_narration(x: list[str], y: list[str]) -> bool:
    """The same text but for spelling, order, form and courtesies; the collecting-group code is left out already."""
    a, b = " ".join(sorted(t for t in x if t not in _COURTESY)), " ".join(sorted(t for t in y if t not in _COURTESY))
    if a == b:
        return True
    like = difflib.SequenceMatcher(None, a, b, False).ratio()
    if like < LIKENESS:
        like = max(like, difflib.SequenceMatcher(None, "".join(x), "".join(y), False).ratio())
    return like >= LIKENESS and not (_lacks(x, y) and _lacks(y, x))


def same_record(a: tuple, b: tuple) -> bool:
    """Whether two cases (payer, students, narration) are one record; all as words."""
    return names.same_words(a[0], b[0]) and same_students(a[1], b[1]) and same_narration(a[2], b[2])


def coverage(entry: tuple, training: tuple) -> float:
    """The share of the letters of an evaluation entry's names in parts of words that the training text has; 1 if it has no such words."""
    text = " ".join([w for s in training[1] for w in s] + training[0] + training[2])
    found = size = 0
    for w in [w for s in entry[1] for w in s] + entry[0]:
        if len(w) >= LEAST_PART:
            begin, end = parts(w)
            places = ((1 << len(begin)) - 1) * (begin in text) | (((1 << len(end)) - 1) << (len(w) - len(end))) * (end in text)
            found, size = found + places.bit_count(), size + len(w)
    return found / size if size else 1.0


def judged(entry: tuple, training: tuple) -> float | None:
    """The covered share of an evaluation entry if the training entry is the same record."""
    if not same_record(entry, training):
        return None
    covered = coverage(entry, training)
    whole = any(entry[1]) and _letters(entry[1]) == _letters(training[1])
    return covered if covered >= COVERED or whole else None


def scan(evaluation: list[tuple], training: list[tuple]) -> Iterator[tuple[int, int]]:
    """(evaluation position, training position) of the same records; both lists hold (payer, students, narration) as
    texts."""
    form = lambda x: (person(x[0]), [person(s) for s in x[1]], purpose(x[2]))
    one, other = [form(x) for x in evaluation], [form(x) for x in training]
    met: dict[int, set[int]] = {}
    for rows, hashes in passages(*_columns(one), False):
        for i, h in zip(rows.tolist(), hashes.tolist()):
            met.setdefault(h, set()).add(i)
    pairs = {(i, j) for rows, hashes in passages(*_columns(other), True) for j, h in zip(rows.tolist(), hashes.tolist()) for i in met.get(h, ())}
    for i, j in sorted(pairs):
        if judged(one[i], other[j]) is not None:
            yield i, j


def _columns(entries: list[tuple]) -> tuple[pa.ListArray, pa.ListArray]:
    return pa.array([x[0] for x in entries], pa.list_(pa.string())), pa.array([x[1] for x in entries], pa.list_(pa.list_(pa.string())))


def person(name: str | None) -> list[str]:
    return [w for w in words(name) if w not in names.TITLES]


def purpose(narration: str | None) -> list[str]:
    return words(_CODE.sub(" ", narration or ""))


_FORM = T.StructType([T.StructField("p", T.ArrayType(T.StringType())), T.StructField("s", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("n", T.ArrayType(T.StringType()))])


@F.arrow_udf(_FORM)
def _form(payers: pa.Array, students: pa.Array, narrations: pa.Array) -> pa.Array:
    p = pa.array([person(x) for x in payers.to_pylist()], pa.list_(pa.string()))
    s = pa.array([[person(x) for x in several or []] for several in students.to_pylist()], pa.list_(pa.list_(pa.string())))
    n = pa.array([purpose(x) for x in narrations.to_pylist()], pa.list_(pa.string()))
    return pa.StructArray.from_arrays([p, s, n], ["p", "s", "n"])


_form = _form.asNondeterministic()  # run once, also under filters
_TEXTS = ("side", "payer", "students", "narration")


def _texts(cases: DataFrame) -> DataFrame:
    students = F.transform(F.coalesce(F.col("setup.students"), F.array()), lambda s: F.coalesce(s["name"], F.lit("")))
    side: Column = F.when(F.col("split") == TRAIN, 0).when(F.col("split").isin(*EVALUATION), 1)
    return cases.select(
        "case_no",
        side.alias("side"),
        F.coalesce("txn.payer_name", F.lit("")).alias("payer"),
        students.alias("students"),
        F.coalesce("txn.narration", F.lit("")).alias("narration"),
    ).where("side is not null")


def entries_of(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, members). entries: one row per different texts, known by their smallest case: (entry, side, p, s, n),
    the texts as words. members: (case_no, side, entry) of every case. Texts are told apart by 128 bits of a digest."""
    digest = F.unhex(F.md5(F.to_json(F.struct(*_TEXTS))))
    texts = _texts(cases).withColumn("_d", digest)
    grouped = texts.groupBy("_d").agg(F.min("case_no").alias("entry"), F.count("*").alias("_n"), *(F.any_value(c).alias(c) for c in _TEXTS))
    grouped = cut_table(grouped.withColumn("x", _form("payer", "students", "narration")).select("_d", "_n", "entry", "side", "x.p", "x.s", "x.n"))
    alone = grouped.where("_n = 1").select(F.col("entry").alias("case_no"), "side", "entry")
    several = cut(grouped.where("_n > 1").select("_d", "_n", "entry"))
    shared = join_summaries(texts.select("case_no", "side", "_d"), several, ["_d"], "_n").select("case_no", "side", "entry").distinct()
    return grouped.select("entry", "side", "p", "s", "n"), alone.unionByName(shared)


@lru_cache(maxsize=2)
def _shard(path: str, number: int, *columns: str) -> list[np.ndarray]:
    """The columns of a shard in the shared folder, in order of the first; a worker keeps the last two."""
    path = re.sub("^file:/+", "/", path)
    files, folder = pyarrow.fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pyarrow.fs.LocalFileSystem(), path)
    table = pyarrow.dataset.dataset(f"{folder}/shard={number}", filesystem=files, format="parquet").to_table(list(columns))
    out = [table[c].to_numpy() for c in columns]
    if (out[0][1:] < out[0][:-1]).any():
        order = np.argsort(out[0])
        out = [x[order] for x in out]
    return out


@lru_cache(maxsize=2)
def _people(path: str, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of a table of signatures, and these."""
    entry, *of = _shard.__wrapped__(path, number, "entry", *_SIGNED)
    words_ = (1 + TOLD) * TOLD
    return entry, np.stack(of[:words_], 1).reshape(-1, 1 + TOLD, TOLD), np.stack(of[words_:], 1)


def _passages_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        entry = batch["entry"].to_numpy(zero_copy_only=False)
        for rows, hashes in passages(batch["p"], batch["s"], False):
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(entry[rows], pa.int64())], ["key", "entry"])


_SIGNED = [*(f"w{k}" for k in range((1 + TOLD) * TOLD)), *(f"b{k}" for k in range(1 + TOLD))]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        w, b = signed(batch["p"], batch["s"])
        columns = [np.ascontiguousarray(x) for x in (*w.reshape(len(w), -1).T, *b.T)]
        yield pa.RecordBatch.from_arrays([batch["entry"], *map(pa.array, columns)], ["entry", *_SIGNED])


def _sharded(df: DataFrame, shard: Column, shards: int, order: str) -> tuple[str, set[int]]:
    """The path of a table in shards, each one file in order, and the numbers of those that hold rows."""
    path = shared_table(df.withColumn("shard", shard.cast("int")).repartition(shards, "shard").sortWithinPartitions("shard", order), "shard")
    return path, {r.shard for r in df.sparkSession.read.parquet(path).select("shard").distinct().collect()}


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.to_pydict()
        covered = [judged(one, other) for one, other in zip(zip(x["p"], x["s"], x["n"]), zip(x["tp"], x["ts"], x["tn"]))]
        yield pa.RecordBatch.from_arrays([batch["e"], batch["t"], pa.array(covered, pa.float64())], ["e", "t", "covered"]).filter(pc.is_valid(pa.array(covered, pa.float64())))


def links(entries: DataFrame) -> DataFrame:
    """(e, t, covered): evaluation and training entries that are the same record, each pair once."""
    entries = entries.where("entry is not null").withColumn("entry", F.col("entry").cast("bigint"))
    evaluation, training = entries.where("side = 1"), entries.where("side = 0")
    keys = cut_table(evaluation.select("entry", "p", "s").mapInArrow(_passages_of, "key bigint, entry bigint"))
    known = keys.count()
    if not known:
        return entries.where("false").select(F.col("entry").alias("e"), F.col("entry").alias("t"), F.lit(0.0).alias("covered"))
    tables, bits = -(-evaluation.count() // SIGNED), (-(-known // SHARD) - 1).bit_length()
    index, filled = _sharded(keys, F.shiftright("key", 63 - bits), 1 << bits, "key")
    told = evaluation.select("entry", "p", "s").mapInArrow(_signed, ", ".join(["entry bigint", *(f"{c} {'int' if c[0] == 'w' else 'bigint'}" for c in _SIGNED)]))
    people, _ = _sharded(told, F.pmod("entry", F.lit(tables)), tables, "entry")

    def fitting(entry: np.ndarray, row: np.ndarray, own: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs of an evaluation entry and a training row whose payers and students may agree, each once."""
        keep = [np.zeros((0, 2), np.int64)]
        table = np.mod(entry, tables)
        for k in np.unique(table).tolist():
            at = np.flatnonzero(table == k)
            e, *of = _people(people, k)
            at = at[may_be_same(tuple(of), np.searchsorted(e, entry[at]), own, row[at])]
            keep.append(np.stack([entry[at], row[at]], 1))
        return np.unique(np.concatenate(keep), axis=0)

    def looked_up(held: list[pa.RecordBatch], rows: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        texts = pa.Table.from_batches(held).combine_chunks()
        own = tuple(map(np.concatenate, zip(*(signed(x["p"], x["s"]) for x in held))))
        order = np.argsort(hashes)
        rows, hashes = rows[order], hashes[order]
        shard = hashes >> (63 - bits)
        met = [np.zeros((0, 2), np.int64)]
        for k in [k for k in np.unique(shard).tolist() if k in filled]:
            some = slice(*np.searchsorted(shard, [k, k + 1]))
            key, entry = _shard(index, k, "key", "entry")
            start = np.searchsorted(key, hashes[some])
            hit = np.flatnonzero(key[np.minimum(start, len(key) - 1)] == hashes[some])
            start, row = start[hit], rows[some][hit]
            count = np.searchsorted(key, hashes[some][hit], "right") - start
            ends = np.cumsum(count)
            blocks = np.searchsorted(ends, np.arange(JUDGED, (ends[-1] if len(ends) else 0) + JUDGED, JUDGED))
            for part in np.split(np.arange(len(hit)), np.unique(blocks[blocks < len(hit)])):
                i, place = _spread(start[part], count[part])
                met.append(fitting(entry[place], row[part][i], own))
        pairs = np.unique(np.concatenate(met), axis=0)
        for k in range(0, len(pairs), 10_000):
            some = pairs[k : k + 10_000]
            at = texts.take(pa.array(some[:, 1])).combine_chunks()
            for batch in pa.table([pa.array(some[:, 0]), at["entry"], at["p"], at["s"], at["n"]], ["e", "t", "tp", "ts", "tn"]).to_batches():
                yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        size = base = 0
        for batch in batches:
            held.append(batch)
            for rows, hashes in passages(batch["p"], batch["s"], True):
                found.append((rows + base, hashes))
                size += len(hashes)
                if size >= 2 * HELD:  # a long text
                    yield from looked_up(held, *map(np.concatenate, zip(*found)))
                    found, size = [], 0
            base += len(batch)
            if size >= HELD:
                yield from looked_up(held, *map(np.concatenate, zip(*found)))
                held, found, size, base = [], [], 0, 0
        if found:
            yield from looked_up(held, *map(np.concatenate, zip(*found)))

    texts = "array<string>", "array<array<string>>", "array<string>"
    met = training.select("entry", "p", "s", "n").mapInArrow(run, "e bigint, t bigint, " + ", ".join(f"t{c} {t}" for c, t in zip("psn", texts)))
    return met.join(evaluation.select(F.col("entry").alias("e"), "p", "s", "n"), "e").mapInArrow(_judge, "e bigint, t bigint, covered double").distinct()


def overlaps(cases: DataFrame) -> DataFrame:
    """(case_no_a, case_no_b): the smaller and the larger case number of every such pair. The pairs of copies are made
    here, where the result is defined as pairs."""
    entries, members = entries_of(cases)
    found = cut(links(entries))
    out = found.join(members.where("side = 1").select(F.col("case_no").alias("x"), F.col("entry").alias("e")), "e")
    out = out.join(members.where("side = 0").select(F.col("case_no").alias("y"), F.col("entry").alias("t")), "t")
    return out.select(F.least("x", "y").alias("case_no_a"), F.greatest("x", "y").alias("case_no_b"))


def report(cases: DataFrame) -> DataFrame:
    """(split, provenance, cases, in_train, pairs, covered) of the evaluation splits: cases, those that are in
    training too, pairs with training cases, and the mean coverage of the former by the training text that covers most.
    Counted from entries and their numbers of members; no pairs of copies are made."""
    entries, members = entries_of(cases)
    found = cut(links(entries))
    copies = members.where("side = 0").groupBy(F.col("entry").alias("t")).agg(F.count("*").alias("k"))
    summed = found.join(copies, "t").groupBy(F.col("e").alias("entry")).agg(F.sum("k").alias("n"), F.max("covered").alias("best"))
    sizes = members.where("side = 1").groupBy("entry").agg(F.count("*").alias("_n"))
    summed = cut(summed.join(sizes, "entry"))
    met = join_summaries(members.where("side = 1").select("case_no", "entry"), summed, ["entry"], "_n").select("case_no", "n", "best")
    known = cases.where(F.col("split").isin(*EVALUATION)).select("case_no", "split", "provenance").join(met, "case_no", "left")
    return known.groupBy("split", "provenance").agg(
        F.count("*").alias("cases"), F.count("n").alias("in_train"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.round(F.avg("best"), 6).alias("covered")
    )
