"""Distributing money over charges: priority waterfall and order-dependent posting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def waterfall(balances: DataFrame, amounts: DataFrame) -> DataFrame:
    """(student_id, charge_id, take): a student's money fills positive balances by (priority, charge_id).

    balances: (student_id, charge_id, priority, balance); amounts: (student_id, amount). A prefix sum per
    student; charges that get nothing are left out.
    """
    before = F.coalesce(F.sum("balance").over(Window.partitionBy("student_id").orderBy("priority", "charge_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = balances.where("balance > 0").join(amounts, "student_id").withColumn("_before", before)
    take = F.least(F.col("balance"), F.col("amount") - F.col("_before"))
    return open_.select("student_id", "charge_id", take.alias("take")).where("take > 0")


def surplus(balances: DataFrame, amounts: DataFrame) -> DataFrame:
    """(student_id, surplus): what is left once every balance is filled."""
    owed = balances.where("balance > 0").groupBy("student_id").agg(F.sum("balance").alias("owed"))
    left = amounts.join(owed, "student_id", "left").select("student_id", (F.col("amount") - F.coalesce("owed", F.lit(0))).alias("surplus"))
    return left.where("surplus > 0")


def post_in_order(limits: DataFrame, payments: DataFrame) -> DataFrame:
    """(key, remaining, posted, skipped): payments in order of (at, id); one that does not fit into what remains
    is skipped, so this is a fold and no prefix sum.

    limits: (key, limit); payments: (key, at, id, amount). The fold runs over one key's payments as an array; a
    key's payments are bounded by the events of one account.
    """
    listed = payments.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "id", "amount"))).alias("all"))
    start = F.struct(F.col("limit").cast("bigint").alias("remaining"), F.lit(0).alias("posted"), F.lit(0).alias("skipped"))

    def step(acc, p):
        fits = p["amount"] <= acc["remaining"]
        return F.struct(
            F.when(fits, acc["remaining"] - p["amount"]).otherwise(acc["remaining"]).alias("remaining"),
            (acc["posted"] + fits.cast("int")).alias("posted"),
            (acc["skipped"] + (~fits).cast("int")).alias("skipped"),
        )

    return limits.join(listed, "key").withColumn("s", F.aggregate("all", start, step)).select("key", "s.remaining", "s.posted", "s.skipped")
