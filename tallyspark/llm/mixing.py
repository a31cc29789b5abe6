"""Mixing sources to target weights (problem 9).

Method: weighted fair queueing. The documents of a source are shuffled by a seeded hash and queued, pass
after pass up to the source's cap. A document's virtual finish time is the number of its source's tokens up
to and including it, divided by the source's weight. All queues are merged by that time (a global range
sort) and cut where the total budget is reached; at that time every source has sent its share of it. The
document in transmission at the cut counts as sent if more than half of it is, so that a source misses its
share by half a document at most.

The running sums need no task that holds a whole source: documents fall into hash ranges, a window sums
within one range, and the sums of the ranges before are added from a table of bounded size.

Budget: the largest at which every source can give its share within its cap, unless a smaller one is given;
with a budget beyond it sources run dry and the reported shares show it. Defined results: sources that are
null or not listed, and listed ones without tokens or with a share of 0, take no part (the shares of the
others are then taken relative to their sum); null and empty texts have no tokens and take no part; a null or
negative cap counts as 0; equal documents are separate documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.session import cut

#: Most hash ranges per source, and most rows of the table of their sums, which the driver adds up.
RANGES = 1_024
MAX_SUMS = 200_000
#: More sources than this are refused: the list of targets is configuration.
MAX_SOURCES = 10_000
SEED = "mix-1"


def _targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    rows = targets.select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources in the list of targets")
    return [(r.source, float(r.target_share), int(r.max_repeats or 0)) for r in rows if r.source is not None and (r.target_share or 0) > 0]


def mix(sized: DataFrame, targets: DataFrame, budget: float | None = None) -> DataFrame:
    """(doc_id, source, pass, n_tokens, finish) of every document sent, in the order of ``finish``.

    sized: (doc_id, source, n_tokens). ``pass`` counts from 1 up to the source's cap.
    """
    spark = sized.sparkSession
    wanted = _targets(targets)
    schema = "source string, weight double, cap int"
    shares = spark.createDataFrame(wanted, schema)
    ranges = 1 << (min(RANGES, MAX_SUMS // max(1, len(wanted))).bit_length() - 1)
    spread = F.col("_h").bitwiseAND(F.lit(ranges - 1))
    docs = cut(
        sized.where("n_tokens > 0")
        .join(F.broadcast(shares.select("source")), "source")
        .withColumn("_h", F.xxhash64("doc_id", F.lit(SEED)))
        .select("doc_id", "source", "n_tokens", "_h", spread.alias("_range"))
    )
    # at most MAX_SUMS rows, whatever the data
    sums = docs.groupBy("source", "_range").agg(F.sum("n_tokens").alias("n")).collect()
    supply: dict[str, int] = {}
    for r in sums:
        supply[r.source] = supply.get(r.source, 0) + r.n
    live = [(s, w, c) for s, w, c in wanted if supply.get(s) and c > 0]
    weights = sum(w for _, w, _ in live)
    live = [(s, w / weights, c) for s, w, c in live]
    reach = min((supply[s] * c / w for s, w, c in live), default=0.0)
    end = reach if budget is None else float(budget)  # the common virtual time is tokens over weight
    starts, before = [], {}
    for r in sorted(sums, key=lambda r: (r.source, r._range)):
        starts.append((r.source, r._range, before.get(r.source, 0)))
        before[r.source] = before.get(r.source, 0) + r.n
    offsets = spark.createDataFrame(starts, "source string, _range bigint, _start bigint")
    plan = spark.createDataFrame([(s, w, c, supply[s]) for s, w, c in live], schema + ", _supply bigint")
    within = Window.partitionBy("source", "_range").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        docs.withColumn("_sum", F.sum("n_tokens").over(within))
        .join(F.broadcast(offsets), ["source", "_range"])
        .join(F.broadcast(plan), "source")
        .withColumn("_first", F.col("_start") + F.col("_sum"))
    )
    # as many passes as end before the budget; the last one may be cut
    passes = F.least(F.col("cap"), F.ceil((F.lit(end) * F.col("weight") - F.col("_first") + F.col("n_tokens")) / F.col("_supply")) + 1).cast("int")
    sent = queued.where(passes >= 1).withColumn("pass", F.explode(F.sequence(F.lit(1), F.greatest(passes, F.lit(1)))))
    finish = (F.col("_first") + (F.col("pass") - 1) * F.col("_supply")) / F.col("weight")
    return (
        sent.withColumn("finish", finish)
        .where(F.col("finish") - F.col("n_tokens") / (2 * F.col("weight")) <= F.lit(end))
        .select("doc_id", "source", "pass", "n_tokens", "finish")
    )


def in_order(mixed: DataFrame) -> DataFrame:
    """The mix globally sorted by virtual finish time (a range sort; ties by source, document and pass)."""
    return mixed.orderBy("finish", "source", "doc_id", "pass")


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, documents, most_repeats) of every listed source."""
    got = mixed.groupBy("source").agg(
        F.sum("n_tokens").alias("n_tokens"), F.countDistinct("doc_id").alias("documents"), F.max("pass").alias("most_repeats")
    )
    whole = got.agg(F.sum("n_tokens").alias("_all"))
    share: Column = F.round(F.coalesce(F.col("n_tokens"), F.lit(0)) / F.col("_all"), 6)
    return (
        targets.where("source is not null")
        .select("source", "target_share")
        .join(F.broadcast(got), "source", "left")
        .join(F.broadcast(whole), how="left")
        .select(
            "source",
            "target_share",
            F.coalesce(share, F.lit(0.0)).alias("actual_share"),
            F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"),
            F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"),
            F.coalesce("most_repeats", F.lit(0)).cast("int").alias("most_repeats"),
        )
    )
