"""Access to the Parquet tables of a data folder, and the star-schema-to-ledger mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import ship_package


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table of ``folder``; with ``columns``, only those (so that the scan reads no others)."""
    ship_package(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def kobo(column: str):
    """A floating amount as minor units; rounded once, here at the edge."""
    return F.round(F.col(column) * 100).cast("bigint")


def charges(spark: SparkSession, folder: str) -> DataFrame:
    """Charge identities: one per order. (charge_id, student_id, priority)"""
    return table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderpriority").select(
        F.col("o_orderkey").alias("charge_id"),
        F.col("o_custkey").alias("student_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
    )


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Incoming payments: one per stream event. (transaction_id, payer, amount_minor, posted_at, kind)"""
    return table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value").select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id").alias("payer"),
        kobo("value").alias("amount_minor"),
        F.col("ts").alias("posted_at"),
        F.col("event_type").alias("kind"),
    )


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The append-only event log derived from orders, lineitem and events.

    Columns: event_id, event_type, transaction_id, charge_id, student_id, holder, amount_minor, reverses_event_id.
    """
    none_long = F.lit(None).cast("bigint")
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    created = orders.select(
        (F.col("o_orderkey") * 100).alias("event_id"),
        F.lit("charge_created").alias("event_type"),
        none_long.alias("transaction_id"),
        F.col("o_orderkey").alias("charge_id"),
        F.col("o_custkey").alias("student_id"),
        none_long.alias("holder"),
        kobo("o_totalprice").alias("amount_minor"),
        none_long.alias("reverses_event_id"),
    )
    lines = (
        table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_partkey")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.sum(kobo("l_extendedprice")).alias("amount_minor"),
            F.max("l_returnflag").alias("flag"),
            F.min("l_partkey").alias("part"),
        )
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    )
    key = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    allocated = lines.select(
        key.alias("event_id"),
        F.lit("allocation").alias("event_type"),
        F.col("part").alias("transaction_id"),
        F.col("l_orderkey").alias("charge_id"),
        F.col("o_custkey").alias("student_id"),
        none_long.alias("holder"),
        "amount_minor",
        none_long.alias("reverses_event_id"),
    )
    reversed_ = lines.where("flag = 'R'").select(
        (key + 50).alias("event_id"),
        F.lit("reversal").alias("event_type"),
        F.col("part").alias("transaction_id"),
        F.col("l_orderkey").alias("charge_id"),
        F.col("o_custkey").alias("student_id"),
        none_long.alias("holder"),
        "amount_minor",
        key.alias("reverses_event_id"),
    )
    credits = (
        transactions(spark, folder)
        .where(F.col("kind").isin("purchase", "error"))
        .select(
            (F.col("transaction_id") + F.lit(10_000_000_000)).alias("event_id"),
            F.when(F.col("kind") == "purchase", "credit_grant").otherwise("credit_application").alias("event_type"),
            "transaction_id",
            none_long.alias("charge_id"),
            none_long.alias("student_id"),
            F.col("payer").alias("holder"),
            "amount_minor",
            none_long.alias("reverses_event_id"),
        )
    )
    return created.unionByName(allocated).unionByName(reversed_).unionByName(credits)
