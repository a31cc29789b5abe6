"""Measures over evaluation records, calibration of a score, and decision tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import seeded_hash, sigmoid
from tallyspark.session import cut


def rate(flag: Column) -> Column:
    """Mean of a three-valued flag: nulls do not count, null if there is nothing else."""
    return F.round(F.avg(flag.cast("double")), 6)


def metric_card(records: DataFrame, *flags: str) -> DataFrame:
    """(group, cases, one rate per flag) over all records and per group. records: (group, flags...)."""
    aggs = [F.count("*").alias("cases"), *(rate(F.col(f)).alias(f) for f in flags)]
    return records.rollup("group").agg(*aggs)


def gates(records: DataFrame) -> DataFrame:
    """One row: wrong automatic decisions, rate of blocked duplicates, what fails and what was never tried.
    records: (auto, correct, duplicate_blocked), the latter two three-valued."""
    one = records.agg(
        F.count_if(F.col("auto") & ~F.coalesce("correct", F.lit(True))).alias("wrong_auto"), rate(F.col("duplicate_blocked")).alias("blocked_rate"), F.count_if("auto").alias("autos"), F.count("duplicate_blocked").alias("duplicates")
    )
    failed = F.array_compact(F.array(F.when(F.col("wrong_auto") > 0, "wrong_auto"), F.when(F.col("blocked_rate") < 1, "duplicate_blocked")))
    idle = F.array_compact(F.array(F.when(F.col("autos") == 0, "wrong_auto"), F.when(F.col("duplicates") == 0, "duplicate_blocked")))
    return one.select("wrong_auto", "blocked_rate", F.array_join(failed, ",").alias("failed"), F.array_join(idle, ",").alias("untried"))


def run_diff(before: DataFrame, after: DataFrame, *flags: str) -> DataFrame:
    """(case_id, flag) of every flag that was true before and is false after; cases both runs have."""
    joined = before.select("case_id", *(F.col(f).alias(f"b_{f}") for f in flags)).join(after.select("case_id", *(F.col(f).alias(f"a_{f}") for f in flags)), "case_id")
    lost = F.array_compact(F.array(*(F.when(F.col(f"b_{f}") & ~F.col(f"a_{f}"), f) for f in flags)))
    return joined.select("case_id", F.explode(lost).alias("flag"))


def rubric(scores: DataFrame, key: DataFrame, most: int) -> DataFrame:
    """(model, percent) of blind reviews: points over attainable points. scores: (review_id, points)."""
    joined = scores.join(key, "review_id").groupBy("model").agg(F.sum("points").alias("p"), F.count("*").alias("n"))
    return joined.select("model", F.round(100.0 * F.col("p") / (F.col("n") * most), 4).alias("percent"))


def blind_packet(outputs: DataFrame, seed: str) -> DataFrame:
    """(review_id, output_id): reproducible shuffled ids that tell nothing about the model, from blind-0001 on. Places are counted
    over a range partitioning of the digests, so the outputs are never in one task."""
    hashed = outputs.select("output_id", seeded_hash(seed, F.col("output_id")).alias("h")).repartitionByRange("h").sortWithinPartitions("h")
    placed = cut(hashed.withColumns({"p": F.spark_partition_id(), "m": F.monotonically_increasing_id()}))
    starts, at = [], 0
    for r in placed.groupBy("p").agg(F.count("*").alias("n")).orderBy("p").collect():  # one row per partition
        starts.append((r.p, at))
        at += r.n
    offsets = outputs.sparkSession.createDataFrame(starts or [(0, 0)], "p int, s bigint")
    number = F.col("s") + F.col("m") - F.col("p").cast("bigint") * (1 << 33) + 1
    text = F.when(number < 10_000, F.lpad(number.cast("string"), 4, "0")).otherwise(number.cast("string"))
    return placed.join(F.broadcast(offsets), "p").select(F.concat(F.lit("blind-"), text).alias("review_id"), "output_id")


def side_by_side(one: DataFrame, other: DataFrame, *columns: str) -> DataFrame:
    """The columns of two runs' records next to each other, of the cases both have."""
    name = lambda df, tag: df.select("case_id", *(F.col(c).alias(f"{tag}_{c}") for c in columns))
    return name(one, "a").join(name(other, "b"), "case_id")


def regression_points(before: Column, after: Column) -> Column:
    """How many points of a hundred a rate fell; never its absolute value."""
    return F.round(100 * (before - after), 6)


def stress_summary(records: DataFrame) -> DataFrame:
    """One row of counts over distinct inputs and whether they pass: 99.5 % valid answers and nothing else wrong.
    records: (valid_json, unsupported_id, thinking_leak, transport, wrong_auto)."""
    kinds = ("unsupported_id", "thinking_leak", "transport", "wrong_auto")
    one = records.agg(F.count("*").alias("inputs"), F.count_if("valid_json").alias("valid_json"), *(F.count_if(F.coalesce(k, F.lit(False))).alias(k) for k in kinds))
    rate_ = F.col("valid_json") / F.col("inputs")
    passes = (rate_ >= 0.995) & (sum((F.col(k) for k in kinds), F.lit(0)) == 0)
    return one.select("*", F.round(rate_, 6).alias("valid_rate"), F.coalesce(passes, F.lit(False)).alias("passes"))


def release_decision(scores: DataFrame) -> DataFrame:
    """(ship, retry, gates): what to ship after a fine-tuning, from one row of measures: zero_gold, gold, zero_proxy, proxy, zero_bare,
    bare, merged_gold (or null), valid_json_rate, unsupported_ids, thinking_leaks, wrong_auto, stress_passed, gates_failed."""
    c = F.col
    loss = 100 * (c("merged_gold") - c("gold"))
    rules = {
        "gold_improved": c("gold") > c("zero_gold"), "enterprise_regression": 100 * (c("zero_proxy") - c("proxy")) <= 2, "bare_regression": c("zero_bare") - c("bare") <= 5,
        "valid_json": F.coalesce("valid_json_rate", F.lit(0.0)) >= 0.995, "unsupported_ids": c("unsupported_ids") == 0, "thinking_leaks": c("thinking_leaks") == 0, "incorrect_auto_posts": c("wrong_auto") == 0,
        "stress_passed": c("stress_passed"), "safety_gates": c("gates_failed") == 0, "merged_loss": loss.isNull() | (loss <= 3),
    }
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(kept, F.lit(False)), F.lit(name)) for name, kept in rules.items())))
    incomplete = F.greatest(*(c(x).isNull() for x in ("zero_gold", "gold", "zero_proxy", "proxy")))
    ship = F.when(incomplete, "incomplete").when(loss > 3, "finer_quantisation").when(F.size(failed) == 0, "fine_tuned").otherwise("zero_shot")
    return scores.select(ship.alias("ship"), F.coalesce(100 * (c("zero_proxy") - c("proxy")) > 2, F.lit(False)).alias("retry"), F.array_join(failed, ",").alias("failed"))


def authored_problems(cases: DataFrame, total: int, languages: dict[str, int], abstentions: int, per_family: int) -> DataFrame:
    """(rule, expected, found) of a case set that is not as it was to be authored. cases: (language, family, abstains)."""
    whole = cases.agg(F.count("*").alias("n"), F.count_if("abstains").alias("a"), *(F.count_if(F.col("language") == k).alias(f"l_{k}") for k in languages))
    rules = [("total", total, F.col("n")), ("abstentions", abstentions, F.col("a")), *((f"language {k}", v, F.col(f"l_{k}")) for k, v in languages.items())]
    rows = whole.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(v).cast("bigint").alias("expected"), f.alias("found")) for r, v, f in rules))).alias("x")).select("x.*")
    each = cases.where("family is not null").groupBy("family").agg(F.count("*").alias("found")).select(F.concat(F.lit("family "), "family").alias("rule"), F.lit(per_family).cast("bigint").alias("expected"), "found")
    return rows.unionByName(each).where("expected <> found")


def standardisation(rows: DataFrame, *features: str) -> DataFrame:
    """(feature, mean, deviation) with the population deviation, 1 where it is 0: one pass over the rows."""
    aggs = [x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]
    parts = [F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"), F.when(F.col(f"s_{f}") == 0, 1.0).otherwise(F.col(f"s_{f}")).alias("deviation")) for f in features]
    return rows.agg(*aggs).select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def threshold(rows: DataFrame, least: float = 0.9) -> tuple[float, bool]:
    """The score from which no negative passes, and whether there is such a score. rows: (score, label)."""
    worst = rows.where("not label").agg(F.max("score").alias("s")).first().s
    cut = max(least, math.nextafter(worst, math.inf)) if worst is not None else least
    return cut, cut <= 1


def route(score: Column, auto: Column | float, review: float = 0.65) -> Column:
    return F.when(score >= auto, "auto").when(score < review, "unmatched").otherwise("review")


def fit_logistic(rows: DataFrame, features: list[str], label: str, most_rows: int = 100_000, steps: int = 4_000, speed: float = 0.08, shrink: float = 0.001, seed: int = 7) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression by full-batch gradient descent.

    A classifier may be fitted on a bounded sample: of more than ``most_rows`` rows those with the smallest
    hash of all their values are taken, the same in every run.
    """
    sample = rows.select(*features, F.col(label).cast("int").alias("_y")).orderBy(F.xxhash64(*features, label)).limit(most_rows).toPandas()
    x, y = sample[features].to_numpy(float), sample["_y"].to_numpy(float)
    if not len(y):
        return 0.0, np.zeros(len(features))
    weights = np.random.default_rng(seed).uniform(-0.001, 0.001, len(features))
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    bias = math.log(share / (1 - share))
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -60, 60))) - y
        weights -= speed * (x.T @ error / len(y) + shrink * weights)
        bias -= speed * error.mean()
    return bias, weights


def score(bias: float, weights: dict[str, float]) -> Column:
    """The confidence of fitted weights as one expression."""
    z = F.lit(float(bias))
    for name, w in weights.items():
        z = z + F.lit(float(w)) * F.col(name)
    return F.round(sigmoid(z), 8)
