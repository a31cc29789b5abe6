"""Importing statements and registers: mapping, validation, idempotent de-duplication, batch summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions.money import parse_money
from tallyspark.functions.text import alias_list, canonical_reference, dedup_hash, normalize_name, tokens
from tallyspark.session import cut


def mapped(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Canonical columns from mapped source columns ('' where a source is missing); other columns are kept."""
    out = df
    for canonical, source in mapping.items():
        out = out.withColumn(canonical, F.coalesce(F.col(f"`{source}`"), F.lit("")) if source in df.columns else F.lit(""))
    return out


def required(df: DataFrame, *fields: str) -> DataFrame:
    """Adds ``error``: the first required field that is missing or blank, else null."""
    error: Column = F.lit(None).cast("string")
    for name in reversed(fields):
        error = F.when(F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) == "", F.lit(name)).otherwise(error)
    return df.withColumn("error", error)


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes"), F.lit(False))


def _statement_rows(rows: DataFrame) -> DataFrame:
    """Rows of statement files with what they are compared by: the canonical reference, the normalised payer, the
    narration's tokens, whether they are credits, and the amount."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(
        "file", "row_no", canonical_reference(F.col("reference")).alias("ref"), blank("date").alias("date"), blank("amount").alias("amount"), F.col("payer"),
        normalize_name(F.col("payer")).alias("who"), F.array_join(tokens(F.col("narration")), " ").alias("words"), "narration",
        (F.lower(F.coalesce(F.nullif(F.col("direction"), F.lit("")), F.lit("credit"))) == "credit").alias("credit"),
        parse_money(F.col("amount")).alias("amount_minor"),
    )


def keyed_rows(rows: DataFrame) -> DataFrame:
    """The credits with an amount and their dedup hash. The occurrence number counts equal rows within a file, which
    is one file's worth of rows at most."""
    good = _statement_rows(rows).where("credit and amount_minor is not null")
    content = Window.partitionBy("file", "date", "amount", "who", "words").orderBy("row_no")
    good = good.withColumn("occurrence", F.row_number().over(content) - 1)
    return good.withColumn("dedup_hash", dedup_hash(F.col("ref"), F.col("file"), F.col("occurrence"), F.col("date"), F.col("amount"), F.col("payer"), F.col("narration")))


def _first_rows(rows: DataFrame, stored: DataFrame | None, *keys: str) -> DataFrame:
    """(file, row_no) of the first row of each key that is not stored. One aggregation with partial sums instead of a
    window, so that a key held by a third of all rows is reduced before it is moved."""
    every = rows.select(*keys, F.struct(F.lit(1).alias("new"), "file", "row_no").alias("at"))
    if stored is not None:
        kinds = dict(rows.dtypes)
        old = F.struct(F.lit(0).alias("new"), F.lit(None).cast(kinds["file"]).alias("file"), F.lit(None).cast(kinds["row_no"]).alias("row_no"))
        every = every.unionByName(stored.select(*keys, old.alias("at")))
    return every.groupBy(*keys).agg(F.min("at").alias("at")).where("at.new = 1").select("at.file", "at.row_no")


def statement_outcomes(rows: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """(file, row_no, outcome, dedup_hash, amount_minor) of statement rows.

    rows: (file, row_no, reference, date, amount, payer, narration, direction). accepted: what is stored already,
    (dedup_hash, posted_at, amount_minor, payer, narration). Outcomes: skipped (not a
    credit), rejected (no amount), duplicate (its hash was accepted before, stored or in an earlier row),
    near_duplicate (no reference, but an accepted payment, stored or earlier, has the same day, amount, normalised
    payer and words), accepted. Files are taken in the order of their
    names, rows in the order of their numbers.
    """
    base = _statement_rows(rows)
    none = lambda kind: F.lit(None).cast(kind)
    skipped = base.where("not credit").select("file", "row_no", F.lit("skipped").alias("outcome"), none("string").alias("dedup_hash"), none("bigint").alias("amount_minor"))
    bad = base.where("credit and amount_minor is null").select("file", "row_no", F.lit("rejected").alias("outcome"), none("string").alias("dedup_hash"), "amount_minor")
    good = keyed_rows(rows).withColumn("day", F.substring("date", 1, 10))
    hashes = content = None
    if accepted is not None:
        hashes = accepted.select("dedup_hash")
        content = accepted.select(
            F.substring(F.coalesce("posted_at", F.lit("")), 1, 10).alias("day"), "amount_minor", normalize_name(F.col("payer")).alias("who"), F.array_join(tokens(F.col("narration")), " ").alias("words")
        )
    first = _first_rows(good, hashes, "dedup_hash").withColumn("first", F.lit(True))
    fresh = cut(good.join(first, ["file", "row_no"], "left").select("file", "row_no", "ref", "day", "amount_minor", "who", "words", "dedup_hash", F.coalesce("first", F.lit(False)).alias("first")))
    new = _first_rows(fresh.where("first"), content, "day", "amount_minor", "who", "words").withColumn("new", F.lit(True))
    outcome = F.when(~F.col("first"), "duplicate").when(F.col("ref").isNull() & F.col("new").isNull(), "near_duplicate").otherwise("accepted")
    judged = fresh.join(new, ["file", "row_no"], "left").select("file", "row_no", outcome.alias("outcome"), "dedup_hash", "amount_minor")
    return skipped.unionByName(bad).unionByName(judged)


def import_errors(rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(file, row_no, field, reason, raw): the rows an import refuses, with the row as it came."""
    bad = outcomes.where("outcome = 'rejected'").select("file", "row_no")
    raw = F.to_json(F.struct(*sorted(c for c in rows.columns if c not in ("file", "row_no"))), {"ignoreNullFields": "false"})
    reason = F.when(F.trim(F.coalesce("amount", F.lit(""))) == "", "missing").otherwise("no amount")
    return rows.join(bad, ["file", "row_no"], "left_semi").select("file", "row_no", F.lit("amount").alias("field"), reason.alias("reason"), raw.alias("raw"))


def setup_register(rows: DataFrame, keys: tuple[str, ...], needed: tuple[str, ...], existing: DataFrame | None = None) -> DataFrame:
    """``rows`` with the fields trimmed and ``outcome`` and ``error``: of a register of terms, guardians or relationships the first
    row of a key wins, rows that lack a needed field are rejected with the fields' names. rows: (row_no, ...)."""
    out = rows.select("row_no", *(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in rows.columns if c != "row_no"))
    missing = F.greatest(F.lit(False), *(F.col(c) == "" for c in needed))
    good = out.where(~missing)
    first = good.groupBy(*keys).agg(F.min("row_no").alias("row_no"))
    if existing is not None:
        first = first.join(existing.select(*keys).distinct(), list(keys), "left_anti")
    good = good.join(first.select("row_no", F.lit(True).alias("_first")), "row_no", "left")
    good = good.withColumn("outcome", F.when(F.col("_first"), "accepted").otherwise("duplicate")).drop("_first").withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(out.where(missing).withColumn("outcome", F.lit("rejected")).withColumn("error", F.lit("/".join(needed))))


def batch_summary(outcomes: DataFrame) -> DataFrame:
    """(file, accepted, rejected, duplicate, skipped) per batch, in one aggregation."""
    count = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    return outcomes.groupBy("file").agg(
        count("accepted", "near_duplicate").alias("accepted"), count("rejected").alias("rejected"), count("duplicate").alias("duplicate"), count("skipped").alias("skipped")
    )


def student_register(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(student_id, name, normalized_name, class, term_id, aliases, outcome) of register rows; the first row of
    an id wins, rows without id or name are rejected."""
    checked = required(rows, "student_id", "name")
    nth = F.row_number().over(Window.partitionBy("student_id").orderBy("row_no"))
    checked = checked.withColumn("nth", nth)
    if existing is not None:
        checked = checked.join(existing.select("student_id").distinct().withColumn("known", F.lit(True)), "student_id", "left")
    else:
        checked = checked.withColumn("known", F.lit(None).cast("boolean"))
    outcome = F.when(F.col("error").isNotNull(), "rejected").when(F.col("known").isNotNull() | (F.col("nth") > 1), "duplicate").otherwise("accepted")
    return checked.select("row_no", "student_id", "name", normalize_name(F.col("name")).alias("normalized_name"), "class", "term_id", alias_list(F.col("aliases")).alias("aliases"), outcome.alias("outcome"))


def fee_register(rows: DataFrame) -> DataFrame:
    """(charge_id, student_id, fee_id, term_id, amount_minor, priority, outcome): one charge per student, fee
    and term; the first row wins. Priority is 100 where the file has no such column, and an error where it is no number."""
    priority = F.trim(F.col("priority")).try_cast("int") if "priority" in rows.columns else F.lit(100)
    parsed = rows.select("student_id", "fee_id", "term_id", "row_no", parse_money(F.col("amount")).alias("amount_minor"), priority.alias("priority"))
    good = F.col("amount_minor").isNotNull() & F.col("priority").isNotNull()
    nth = F.row_number().over(Window.partitionBy("student_id", "fee_id", "term_id", good).orderBy("row_no"))  # a refused row takes no place
    outcome = F.when(~good, "rejected").when(nth > 1, "duplicate").otherwise("accepted")
    return parsed.select(F.concat_ws("-", F.lit("CHG"), "student_id", "fee_id", "term_id").alias("charge_id"), "student_id", "fee_id", "term_id", "amount_minor", "priority", outcome.alias("outcome"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """(key, rows) of keys the parent lacks: what a foreign key would refuse."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count("*").alias("rows"))


def first_wins(new: DataFrame, existing: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert-or-ignore: of each key the first new row, if the key is not there yet."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return new.withColumn("_nth", nth).where("_nth = 1").drop("_nth").join(existing.select(*keys).distinct(), keys, "left_anti")


def latest_state(log: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The current state of every key of a state log: the values of its last entry."""
    return log.groupBy(key).agg(*(F.max_by(c, order).alias(c) for c in columns))
