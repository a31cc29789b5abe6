"""Records that differ only in formatting (problem 2).

Method: bottom-up hashing. A record is a small tree: ordered fields (date, amount, direction, reference) and
one unordered node, the words of payer and narration. Leaves are normalised and hashed; the unordered node
hashes the sorted digests of its children, so neither case, spacing, punctuation nor order of the words
matters; the root hashes the digests of the fields. Rows are grouped by root digest, and only rows whose
digest occurs more than once are confirmed by comparing their whole normal form.

Defined results: null fields are as empty ones; rows repeated as a whole are copies; empty and arbitrarily
long texts are words like any others; an empty table gives no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.skew import join_summaries
from tallyspark.session import cut

_UNIT = "\x1f"  # cannot stand in a word or a canonical reference


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def words(*names: str) -> Column:
    """The words (runs of letters and digits, lower case) of several columns together."""
    joined = F.lower(F.concat_ws(" ", *(_text(n) for n in names)))
    return F.filter(F.split(joined, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def normal_form(reference: str, payer: str, narration: str, date: str, amount: str, direction: str) -> dict[str, Column]:
    """The normalised leaves: four ordered fields and the sorted words."""
    return {
        "date": _text(date),
        "amount": _text(amount),
        "direction": F.lower(F.regexp_replace(_text(direction), r"[\s\p{Z}]+", "")),
        "reference": F.lower(F.regexp_replace(_text(reference), r"[^\p{L}\p{N}]+", "")),
        "words": F.array_sort(words(payer, narration)),
    }


def root_digest(leaves: dict[str, Column]) -> Column:
    """64-bit digest of the tree. Collisions are resolved by the confirmation, so they cost time only."""
    ordered = [F.xxhash64(leaves[n]) for n in ("date", "amount", "direction", "reference")]
    unordered = F.xxhash64(F.array_sort(F.transform(leaves["words"], lambda w: F.xxhash64(w))))
    return F.xxhash64(*ordered, unordered)


def copies(
    df: DataFrame, key: str = "row_id", *, reference: str = "reference", payer: str = "payer", narration: str = "narration",
    date: str = "date", amount: str = "amount", direction: str = "direction",
) -> DataFrame:
    """(first, copy): every further copy of a record with the record's smallest key."""
    leaves = normal_form(reference, payer, narration, date, amount, direction)
    structure = F.concat_ws(_UNIT, leaves["date"], leaves["amount"], leaves["direction"], leaves["reference"], F.concat_ws(" ", leaves["words"]))
    rows = df.select(F.col(f"`{key}`").alias("copy"), root_digest(leaves).alias("_root"), structure.alias("_structure"))
    roots = cut(rows.groupBy("_root").agg(F.count("*").alias("_n")).where("_n > 1"))
    suspects = cut(join_summaries(rows, roots, ["_root"], "_n"))
    records = cut(suspects.groupBy("_root", "_structure").agg(F.min("copy").alias("first"), F.count("*").alias("_n")).where("_n > 1"))
    return join_summaries(suspects, records, ["_root", "_structure"], "_n").where("copy <> first").select("first", "copy")


def records(df: DataFrame, key: str = "row_id", **columns: str) -> DataFrame:
    """(first, copies): one row per record with its number of copies, records without a second copy included."""
    further = copies(df, key, **columns)
    counted = further.groupBy("first").agg((F.count("*") + 1).alias("copies"))
    single = df.select(F.col(f"`{key}`").alias("first")).join(further.select(F.col("copy").alias("first")), "first", "left_anti")
    return single.join(counted, "first", "left").select("first", F.coalesce("copies", F.lit(1).cast("bigint")).alias("copies"))
