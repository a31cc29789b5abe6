"""Scenario cases: their worlds as tables, validity of expected answers, seeded generation and planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions.money import parse_money


def case_charges(cases: DataFrame) -> DataFrame:
    """(case_no, student_id, fee_id, amount_minor): the charges of every case's world, all cases in one job."""
    students = cases.select("case_no", F.explode("setup.students").alias("s"))
    lines = students.select("case_no", F.col("s.id").alias("student_id"), F.explode("s.charges").alias("c"))
    return lines.select("case_no", "student_id", F.col("c.fee_id").alias("fee_id"), parse_money(F.col("c.amount_naira")).alias("amount_minor"))


def expected_allocations(cases: DataFrame) -> DataFrame:
    """(case_no, pos, student_id, fee_id, amount_minor): expected lines; a missing fee is the student's only
    charge if there is exactly one."""
    lines = cases.select("case_no", F.posexplode("expected.allocations").alias("pos", "a"))
    lines = lines.select("case_no", "pos", F.col("a.student_id").alias("student_id"), F.col("a.fee_id").alias("fee"), parse_money(F.col("a.amount_naira")).alias("amount_minor"))
    single = case_charges(cases).groupBy("case_no", "student_id").agg(F.count("*").alias("n"), F.min("fee_id").alias("only")).where("n = 1")
    return lines.join(single, ["case_no", "student_id"], "left").select("case_no", "pos", "student_id", F.coalesce("fee", "only").alias("fee_id"), "amount_minor")


def invalid_cases(cases: DataFrame) -> DataFrame:
    """(case_no, problems): expected answers that could not be posted: a student without any charge in the case's
    world, more money than the student's charges, or more than the payment."""
    owed = case_charges(cases).groupBy("case_no", "student_id").agg(F.sum("amount_minor").alias("owed"))
    paid = expected_allocations(cases).groupBy("case_no", "student_id").agg(F.sum("amount_minor").alias("paid"))
    per = paid.join(owed, ["case_no", "student_id"], "left").groupBy("case_no").agg(
        F.max(F.col("owed").isNull()).alias("unknown"), F.max(F.col("paid") > F.col("owed")).alias("over"), F.sum("paid").alias("total")
    )
    money = cases.select("case_no", parse_money(F.col("txn.amount_naira")).alias("amount"))
    found = F.array_join(F.array_compact(F.array(F.when(F.col("unknown"), "unknown_student"), F.when(F.col("over"), "overpaid_student"), F.when(F.col("total") > F.col("amount"), "overspent_payment"))), ",")
    return per.join(money, "case_no").select("case_no", found.alias("problems")).where("problems <> ''")


def draw(seed: str, key: Column, n: int, part: str) -> Column:
    """A reproducible number from 0 to n - 1 for a key."""
    return (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:{part}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("bigint") % n).cast("int")


def synthetic(spark: SparkSession, n: int, seed: str, templates: list[tuple[str, str]], first: list[str], last: list[str]) -> DataFrame:
    """(case_no, family, text, amount_minor) of n generated cases with different signatures.

    Four times as many are drawn by digests of their numbers; of equal (family, text, amount step) the first
    number stays. If fewer than n remain the result is shorter, which the caller can tell from its count.
    """
    pick = lambda values, part: F.element_at(F.array(*map(F.lit, values)), draw(seed, F.col("id"), len(values), part) + 1)
    drawn = spark.range(4 * n).select(
        F.col("id").alias("case_no"), pick([t[0] for t in templates], "template").alias("family"), pick([t[1] for t in templates], "template").alias("frame"),
        F.concat(pick(first, "first"), F.lit(" "), pick(last, "last")).alias("name"), ((draw(seed, F.col("id"), 200, "amount") + 1) * 50_000).cast("bigint").alias("amount_minor"),
    )
    texts = drawn.withColumn("text", F.replace("frame", F.lit("{name}"), F.col("name")))
    nth = F.row_number().over(Window.partitionBy("family", "text", F.floor(F.col("amount_minor") / 1_000_000)).orderBy("case_no"))
    return texts.withColumn("_nth", nth).where("_nth = 1").orderBy("case_no").limit(n).select("case_no", "family", "text", "amount_minor")


def draft_plan(families: DataFrame, variants: int, quotas: dict[str, int], seed: str) -> DataFrame:
    """(family, variant, language): every family in so many variants, languages dealt by seeded order to quotas;
    what the quotas leave takes the last language. families: (family), a short list."""
    spark = families.sparkSession
    slots = families.crossJoin(F.broadcast(spark.range(variants).select(F.col("id").cast("int").alias("variant"))))
    order = Window.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "family", F.col("variant").cast("string")), 256))
    ranked = slots.withColumn("n", F.row_number().over(order))
    language, upto = F.lit(list(quotas)[-1]), 0
    cases = F
    for name, size in quotas.items():
        upto += size
        cases = cases.when(F.col("n") <= upto, name)
    return ranked.select("family", "variant", cases.otherwise(language).alias("language"))


def model_choice(scores: DataFrame, margin: float = 5.0, least_speed: float = 13.0) -> DataFrame:
    """(chosen, reason): the small model if the large one is too slow, or if it is within the margin in every
    suite. scores: (suite, model, score, speed) with models 'small' and 'large'."""
    wide = scores.groupBy("suite").pivot("model", ["small", "large"]).agg(F.first("score").alias("score"), F.first("speed").alias("speed"))
    one = wide.agg(F.max(F.col("large_score") - F.col("small_score")).alias("gap"), F.min("large_speed").alias("speed"), F.count_if(F.col("small_score").isNull() | F.col("large_score").isNull()).alias("gaps"))
    chosen = F.when(F.col("gaps") > 0, "none").when(F.col("speed") < least_speed, "small").when(F.col("gap") <= margin, "small").otherwise("large")
    reason = F.when(F.col("gaps") > 0, "incomplete").when(F.col("speed") < least_speed, "too_slow").when(F.col("gap") <= margin, "within_margin").otherwise("better")
    return one.select(chosen.alias("chosen"), reason.alias("reason"))
