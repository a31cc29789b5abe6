"""New batches against all accepted history (problem 1).

Method: a segment index for edit distance. The canonical digits of a reference of length L are cut into three
segments; two strings within two edits share one segment at a place that depends only on L. For every
accepted row the index stores a hash of (amount, time window, L, segment number, segment); a new row probes
the selected substrings of its own digits for the lengths L-2..L+2, so it meets only rows that can be near.
Rows without a usable reference meet theirs through the same kind of index over the words that name people
(one edit, two segments), within amount and day. Candidates are verified on the whole texts, and a batch is
added to the history by appending its rows and segments: earlier rows are never indexed again.

Two rows are the same payment if they have the same amount, were posted at most three days apart and
- their references agree or are within two edits after folding look-alike characters, and the texts do not
  name different children or payers, or
- a reference is missing, they share the moment (at the coarser precision written), and payer and child agree.
A payment is a connected group of such rows, known by its smallest row_id.

Rows that agree in all compared values are collapsed to their first before the index is built, so that a
payment copied many times is one entry. Defined results: rows without amount match nothing; a null or
unreadable time agrees with any time if the references are equal and with none otherwise; texts may be null,
empty or of any length; rows repeated as a whole are the same payment; extra columns are ignored.
"""

from __future__ import annotations

from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm import names
from tallyspark.operators.components import connected_components
from tallyspark.operators.instants import utc_micros
from tallyspark.operators.skew import join_summaries, without
from tallyspark.session import cut, cut_table

MAX_DAYS = 3
DAY_US = 86_400_000_000
WINDOW_US = 2 * (MAX_DAYS + 1) * DAY_US
#: Windows stored in one part of the index; parts of references whatever their time; the part of rows without a time.
WINDOWS = 4
BUCKETS = 64
TIMELESS = "timeless"
#: Shorter digit strings are placeholders, not references.
MIN_DIGITS = 6
_COLUMNS = ("row_id", "source", "reference", "raw_reference", "posted_at", "payer_name", "narration", "amount_minor")


def _canonical(name: str) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(F.col(name).cast("string"), F.lit("")), "[^A-Za-z0-9]", ""))


def reference_digits(canonical: Column) -> Column:
    """The digits of a canonical reference without its three-letter channel, look-alike letters as digits."""
    return F.regexp_replace(F.translate(F.regexp_replace(canonical, "^[A-Z]{3}", ""), "OISB", "0158"), "[^0-9]", "")


def attributes(df: DataFrame, rules: dict[str, tuple[str, bool]]) -> DataFrame:
    """One row per row with an amount: row_id and what is compared, whatever other columns ``df`` has."""
    kept = df.select(*(F.col(f"`{c}`") for c in _COLUMNS)).where("amount_minor is not null")
    stripped = F.trim(F.regexp_replace(F.coalesce(F.col("posted_at").cast("string"), F.lit("")), r"[\s\p{Z}]+", " "))
    date_only = ~stripped.rlike(":|[0-9]{9}|[0-9]T[0-9]")
    own = _canonical("reference")
    ref = F.when(own != "", own).otherwise(_canonical("raw_reference"))
    digits = reference_digits(F.col("ref"))
    return (
        kept.withColumn("t", utc_micros(F.col("posted_at"), F.col("source"), rules))
        .withColumn("ref", ref)
        .select(
            "row_id",
            F.col("amount_minor").alias("amount"),
            "t",
            (date_only & F.col("t").isNotNull()).alias("date_only"),
            "ref",
            F.when(F.length(digits) >= MIN_DIGITS, digits).otherwise("").alias("digits"),
            F.coalesce(F.col("payer_name").cast("string"), F.lit("")).alias("payer"),
            F.coalesce(F.col("narration").cast("string"), F.lit("")).alias("narration"),
        )
    )


@F.arrow_udf(T.ArrayType(T.StringType()))
def _name_words(payers: pa.Array, narrations: pa.Array) -> pa.Array:
    """The words of both texts that may name somebody, three letters or more."""
    out = []
    for p, n in zip(payers.to_pylist(), narrations.to_pylist()):
        out.append(sorted({t for t in (*names.name_tokens(n), *names.name_tokens(p)) if len(t) > 2}))
    return pa.array(out, pa.list_(pa.string()))


_name_words = _name_words.asNondeterministic()  # run once, also under filters


def _key(*parts) -> Column:
    """48 bits of a hash: shorter to move than 64, and rare collisions only cost a verification."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 16)


def _reference_segments(window: Column) -> list[Column]:
    """Index entries of a row: three segments of its digits, in one time window."""
    d, n = F.col("digits"), F.length("digits")
    base, extra = F.floor(n / 3).cast("int"), (n % 3).cast("int")
    middle = base + F.when(extra == 2, 1).otherwise(0)
    spans = [(F.lit(0), base), (base, middle), (base + middle, n - base - middle)]
    return [_key(F.lit(k), "amount", window, n, F.substring(d, start + 1, size)) for k, (start, size) in enumerate(spans)]


def _reference_probes(window: Column, longer: bool) -> list[Column]:
    """The substrings that any string within two edits must share a segment with: nineteen, of which the
    twelve for strings that are not longer suffice if every row probes every other."""
    d, out = F.col("digits"), []
    for shift in range(-2 if longer else 0, 3):  # own length minus the other's
        n = F.length("digits") - shift
        base, extra = F.floor(n / 3).cast("int"), (n % 3).cast("int")
        middle = base + F.when(extra == 2, 1).otherwise(0)
        places = [(0, F.lit(0), base)]
        places += [(1, base + move, middle) for move in range(max(-1, shift - 1), min(1, shift + 1) + 1)]
        places += [(2, base + middle + shift, n - base - middle)]
        out += [_key(F.lit(k), "amount", window, n, F.substring(d, start + 1, size)) for k, start, size in places]
    return out


def _word_segments(word: Column, day: Column) -> Column:
    n = F.length(word)
    half = F.floor(n / 2).cast("int")
    entry = lambda k, start, size: _key(F.lit(k), F.col("amount"), day, n, F.substring(word, start + 1, size))
    return F.array(entry(10, F.lit(0), half), entry(11, half, n - half))


def _word_probes(word: Column, day: Column) -> Column:
    out = []
    for shift in (-1, 0, 1):
        n = F.length(word) - shift
        half = F.floor(n / 2).cast("int")
        for k, start, size in ((10, F.lit(0), half), (11, half + shift, n - half)):
            out.append(_key(F.lit(k), F.col("amount"), day, n, F.substring(word, start + 1, size)))
    return F.array(*out)


def _days() -> Column:
    """The UTC days a row's moment may lie in: one, or two for a date alone."""
    day = F.floor(F.col("t") / DAY_US).cast("bigint")
    return F.when(F.col("t").isNull(), F.array().cast("array<bigint>")).when(F.col("date_only"), F.array(day, day + 1)).otherwise(F.array(day))


def _window() -> Column:
    """Windows twice as long as two postings of a payment may lie apart, a day more for dates alone."""
    return F.floor(F.col("t") / WINDOW_US).cast("bigint")


def index_entries(rows: DataFrame) -> DataFrame:
    """(key, row_id): what the history stores of each row; reference segments in the row's window and in
    the neighbour nearer to it, so that whatever lies within the limit looks into one of the two."""
    window = _window()
    nearer = window + F.when(F.pmod(F.col("t"), F.lit(WINDOW_US)) < WINDOW_US // 2, -1).otherwise(1)
    exact = F.array(_key(F.lit(20), "amount", "digits"))
    near = F.flatten(F.transform(F.array(window, nearer), lambda w: F.array(*_reference_segments(w))))
    words = F.flatten(F.flatten(F.transform("words", lambda w: F.transform(_days(), lambda d: _word_segments(w, d)))))
    keys = F.concat(
        F.when(F.col("digits") != "", F.when(F.col("t").isNull(), exact).otherwise(F.concat(exact, near))).otherwise(F.array().cast("array<bigint>")),
        words,
    )
    return rows.select(F.explode(F.array_distinct(keys)).alias("key"), "row_id")


def probe_entries(rows: DataFrame, longer: bool = True) -> DataFrame:
    """(key, row_id): what a new row looks up. Words are looked up by rows without a reference.
    longer: also look for longer references; not needed where those look for this row."""
    window = _window()
    exact = F.array(_key(F.lit(20), "amount", "digits"))
    near = F.array(*_reference_probes(window, longer))
    words = F.flatten(F.flatten(F.transform("words", lambda w: F.transform(_days(), lambda d: _word_probes(w, d)))))
    timed = F.concat(exact, near) if longer else near  # a row without time looks for equal references itself
    keys = F.when(F.col("digits") != "", F.when(F.col("t").isNull(), exact).otherwise(timed)).otherwise(words)
    return rows.select(F.explode(F.array_distinct(keys)).alias("key"), "row_id")


def _same(t_a, t_b, day_a, day_b, ref_a, ref_b, digits_a, digits_b, payer_a, payer_b, text_a, text_b) -> bool:
    apart = None if t_a is None or t_b is None else abs(t_a - t_b)
    if digits_a and digits_b:
        if apart is not None and apart > MAX_DAYS * DAY_US + (DAY_US if day_a or day_b else 0):
            return False
        if ref_a == ref_b:
            return True
        if digits_a == digits_b:
            return names.same_names(text_a, text_b)
        return apart is not None and names.distance(digits_a, digits_b, 2) <= 2 and names.same_names(text_a, text_b) and names.same_person(payer_a, payer_b)
    if apart is None:
        return False
    if day_a and day_b:
        moment = apart < DAY_US
    elif day_a or day_b:
        first, second = (t_a, t_b) if day_a else (t_b, t_a)
        moment = 0 <= second - first < DAY_US
    else:
        moment = apart < 60_000_000 and (apart < 1_000_000 or t_a % 60_000_000 == 0 or t_b % 60_000_000 == 0)
    return moment and names.same_names(text_a, text_b) and names.same_person(payer_a, payer_b)


@F.arrow_udf(T.BooleanType())
def _verified(
    t_a: pa.Array, t_b: pa.Array, day_a: pa.Array, day_b: pa.Array, ref_a: pa.Array, ref_b: pa.Array, digits_a: pa.Array,
    digits_b: pa.Array, payer_a: pa.Array, payer_b: pa.Array, text_a: pa.Array, text_b: pa.Array,
) -> pa.Array:
    columns = [x.to_pylist() for x in (t_a, t_b, day_a, day_b, ref_a, ref_b, digits_a, digits_b, payer_a, payer_b, text_a, text_b)]
    return pa.array(np.fromiter((_same(*row) for row in zip(*columns)), bool, len(t_a)))


_COMPARED = ("t", "date_only", "ref", "digits", "payer", "narration")


def verified_pairs(pairs: DataFrame, history: DataFrame, batch: DataFrame) -> DataFrame:
    """The candidate pairs (a in history, b in batch) that are the same payment."""
    left = history.select(F.col("row_id").alias("a"), *(F.col(c).alias(f"{c}_a") for c in _COMPARED))
    right = batch.select(F.col("row_id").alias("b"), *(F.col(c).alias(f"{c}_b") for c in _COMPARED))
    both = pairs.join(left, "a").join(right, "b")
    sides = [F.col(f"{c}_{s}") for c in _COMPARED for s in "ab"]
    return both.where(_verified(*sides)).select("a", "b")


def collapse(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without exact repeats, (row_id, first) of the repeats): repeats agree in all compared values.
    ``rows`` is read several times: pass a checkpointed frame."""
    same = ["amount", *_COMPARED]
    keyed = rows.select("row_id", F.xxhash64(*same).alias("_h"), *same)
    digests = cut(keyed.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1"))
    suspects = cut(join_summaries(keyed, digests, ["_h"], "_n"))
    groups = suspects.groupBy("_h", *same).agg(F.min("row_id").alias("first"), F.count("*").alias("_n")).where("_n > 1")
    groups = cut(groups.select("_h", "first", "_n", *(F.col(c).alias(f"_{c}") for c in same)))
    agree = None
    for c in same:  # groups of one digest but other values are told apart
        term = F.col(c).eqNullSafe(F.col(f"_{c}"))
        agree = term if agree is None else agree & term
    others = cut(join_summaries(suspects, groups, ["_h"], "_n").where(agree & (F.col("row_id") != F.col("first"))).select("row_id", "first"))
    return without(rows, others, ["row_id"]), others


def with_words(rows: DataFrame) -> DataFrame:
    return rows.withColumn("words", _name_words("payer", "narration"))


def candidates(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(a, b): pairs of different rows that share a key, the smaller first, each once."""
    met = index.withColumnRenamed("row_id", "i").join(probes.withColumnRenamed("row_id", "p"), "key").where("i <> p")
    return met.select(F.least("i", "p").alias("a"), F.greatest("i", "p").alias("b")).distinct()


def payments(df: DataFrame, rules: dict[str, tuple[str, bool]]) -> DataFrame:
    """(first, row_id): every row that repeats an earlier payment of the same table, all batches at once."""
    rows, others = collapse(cut_table(with_words(attributes(df, rules))))
    pairs = candidates(index_entries(rows), probe_entries(rows, longer=False))
    links = verified_pairs(pairs, rows, rows)
    edges = cut(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    groups = cut(connected_components(edges))
    # an exact repeat belongs to the payment of the row it repeats
    repeats = others.join(groups.select(F.col("node").alias("first"), "root"), "first", "left")
    return groups.select(F.col("root").alias("first"), F.col("node").alias("row_id")).unionByName(
        repeats.select(F.coalesce("root", "first").alias("first"), "row_id")
    )


def _group(window: Column) -> Column:
    """The part of the index in which a time window's entries are stored."""
    return F.concat(F.lit("w"), F.floor(window / WINDOWS).cast("string"))


def _bucket() -> Column:
    """The part in which a row's reference is stored whatever its time."""
    return F.concat(F.lit("x"), F.pmod(F.xxhash64("amount", "digits"), F.lit(BUCKETS)).cast("string"))


def _home() -> Column:
    """The part in which a row itself is stored."""
    return F.when(F.col("t").isNull(), TIMELESS).otherwise(_group(_window()))


def _parted(rows: DataFrame, probes: bool) -> DataFrame:
    """(key, row_id, home, part): the index entries, or the probes, of rows with the part they are stored or looked up in."""
    none = F.array().cast("array<struct<key:bigint,part:string>>")
    at = lambda key, part: F.struct(key.alias("key"), part.alias("part"))
    window = _window()
    exact = _key(F.lit(20), "amount", "digits")
    days = lambda make: F.flatten(F.flatten(F.transform("words", lambda w: F.transform(_days(), lambda d: F.transform(make(w, d), lambda k: at(k, _group(F.floor(d * DAY_US / WINDOW_US))))))))
    if probes:
        # a row with a time meets equal references without one; a row without a time all equal references
        near = F.transform(F.array(*_reference_probes(window, True)), lambda k: at(k, _group(window)))
        own = F.when(F.col("t").isNull(), F.array(at(exact, _bucket()))).otherwise(F.concat(F.array(at(exact, F.lit(TIMELESS))), near))
        entries = F.when(F.col("digits") != "", own).otherwise(days(_word_probes))
    else:
        nearer = window + F.when(F.pmod(F.col("t"), F.lit(WINDOW_US)) < WINDOW_US // 2, -1).otherwise(1)
        near = F.flatten(F.transform(F.array(window, nearer), lambda w: F.transform(F.array(*_reference_segments(w)), lambda k: at(k, _group(w)))))
        own = F.concat(F.array(at(exact, _bucket())), F.when(F.col("t").isNull(), F.array(at(exact, F.lit(TIMELESS)))).otherwise(near))
        entries = F.concat(F.when(F.col("digits") != "", own).otherwise(none), days(_word_segments))
    return rows.select(F.explode(F.array_distinct(entries)).alias("e"), "row_id", _home().alias("home")).select("e.key", "row_id", "home", "e.part")


class AcceptedHistory:
    """The accepted rows, their index and the probes of those that look up words, in a folder, to which batches are appended.

    All three tables are stored by parts: time windows, ``BUCKETS`` of references for rows without a time, and those rows
    themselves. ``match`` reads of the index and the probes the parts that its batch looks into, and of the rows the
    parts in which its candidates lie; nothing of an earlier row is computed again. ``append`` writes the batch's rows, segments and
    probes in new files and never touches earlier ones.
    """

    def __init__(self, spark: SparkSession, folder: str, rules: dict[str, tuple[str, bool]]):
        self.spark, self.rules = spark, rules
        self.rows_path, self.index_path, self.probes_path = (str(PurePosixPath(folder) / x) if ":" not in folder else f"{folder.rstrip('/')}/{x}" for x in ("rows", "index", "probes"))

    def _read(self, path: str, column: str, parts: list[str]) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.parquet(path).where(F.col(column).isin(parts)) if there else None

    def prepared(self, batch: DataFrame) -> DataFrame:
        return with_words(attributes(batch, self.rules))

    @staticmethod
    def _parts(df: DataFrame, column: str) -> list[str]:
        """The parts a batch looks into: as many as its windows and buckets, whatever its rows."""
        return sorted(r[0] for r in df.select(column).distinct().collect())

    def candidates(self, new: DataFrame) -> DataFrame:
        """(i, p, home): pairs of an accepted row i or another row of the batch, and a row p of the batch; home is the part of i."""
        entries, probes = cut(_parted(new, False)), cut(_parted(new, True))
        named = lambda df, n: df.withColumnRenamed("row_id", n)
        pairs = named(entries, "i").join(named(probes, "p").select("key", "p"), "key").select("i", "p", F.lit(None).cast("string").alias("home"))
        stored = self._read(self.index_path, "part", self._parts(probes, "part"))
        if stored is not None:
            pairs = pairs.unionByName(named(stored, "i").join(named(probes, "p").select("key", "p"), "key").select("i", "p", "home"))
        # accepted rows without a reference look up the batch's words
        asking = self._read(self.probes_path, "part", self._parts(entries, "part"))
        if asking is not None:
            pairs = pairs.unionByName(named(asking, "i").join(named(entries, "p").select("key", "p"), "key").select("i", "p", "home"))
        return pairs.where("i <> p").distinct()

    def match(self, batch: DataFrame) -> DataFrame:
        """(a, b): b in the batch is the same payment as a, accepted earlier or in the same batch."""
        new = cut(self.prepared(batch))
        met = cut(self.candidates(new))
        inside = met.where("home is null").select(F.least("i", "p").alias("a"), F.greatest("i", "p").alias("b")).distinct()
        out = verified_pairs(inside, new, new)
        before = met.where("home is not null")
        rows = self._read(self.rows_path, "home", self._parts(before, "home"))
        return out if rows is None else out.unionByName(verified_pairs(before.select(F.col("i").alias("a"), F.col("p").alias("b")).distinct(), rows, new))

    def append(self, batch: DataFrame) -> None:
        new = cut(self.prepared(batch))
        tables = ((new.withColumn("home", _home()), "home", "row_id", self.rows_path), (_parted(new, False), "part", "key", self.index_path), (_parted(new.where("digits = ''"), True), "part", "key", self.probes_path))
        for df, part, key, path in tables:  # in few files a part, and a large part in several
            df.repartitionByRange(part, key).write.mode("append").partitionBy(part).parquet(path)
