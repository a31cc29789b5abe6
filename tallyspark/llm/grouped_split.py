"""Splits that keep related cases together (problem 6).

Method: component swap search. Cases are linked by shared guardian ids and shared collecting-group codes;
the connected components are the units of assignment. Each component starts in the split its hash gives;
then whole components are moved or exchanged by simulated annealing so that split sizes and label counts
come close to the wanted shares. Annealing runs in parallel over buckets of components, several chains per
bucket, and each bucket keeps its best state; buckets are independent because each aims at the same shares.
Components that hold at least a thousandth of all cases (there can be at most a thousand of them) are annealed
first, together, with the same cost, and the aims of the buckets are what those leave. The ``LABELS`` most frequent labels
are balanced one by one and all others together, as one label; a bucket looks only at labels that occur in it.

Defined results: a case without ids and codes is a component of its own; null or blank ids link nothing;
repeated case numbers count once; an empty table gives empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.operators.components import connected_components, links_by_key
from tallyspark.session import cut

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Components with at least 1/LARGE of all cases are placed before the others.
LARGE = 1_000
#: Components per bucket, on average; chains per bucket and steps per chain.
BUCKET = 2_000
CHAINS = 4
STEPS = 6_000
SEED = 20_240_601
#: Labels that are balanced one by one.
LABELS = 1_000
_CODE = r"(?<![\p{L}\p{N}])([A-Za-z]{3})[\s\p{Z}./_-]?([0-9]{4})(?![\p{L}\p{N}])"


def group_codes(text: Column) -> Column:
    """The collecting-group codes quoted in a text, as LLLDDDD in capitals, each once."""
    quoted = F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(_CODE), F.lit(0))
    return F.array_distinct(F.transform(quoted, lambda c: F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))))


def guardian_ids(students: Column) -> Column:
    """The guardian ids of all students of a case, outer blanks and case removed."""
    each = F.flatten(F.transform(students, lambda s: F.coalesce(s["guardians"], F.array().cast("array<string>"))))
    clean = F.transform(each, lambda g: F.upper(F.regexp_replace(g, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")))
    return F.array_distinct(F.filter(clean, lambda g: g.isNotNull() & (g != "")))


def memberships(cases: DataFrame) -> DataFrame:
    """(case_no, key): every guardian id and group code of every case."""
    keys = F.concat(
        F.coalesce(F.transform(guardian_ids(F.col("setup.students")), lambda g: F.concat(F.lit("g:"), g)), F.array().cast("array<string>")),
        F.transform(group_codes(F.col("txn.narration")), lambda c: F.concat(F.lit("c:"), c)),
    )
    return cases.select("case_no", F.explode(keys).alias("key"))


def related(cases: DataFrame) -> DataFrame:
    """(node, root): every case of a group but the first, with the group's smallest case number."""
    return connected_components(links_by_key(memberships(cases), "case_no", "key"))


def anneal(sizes: np.ndarray, labels: np.ndarray, size_aim: np.ndarray, label_aim: np.ndarray, start: np.ndarray, seed: int, steps: int = STEPS) -> np.ndarray:
    """Assignment of components to splits after one chain.

    sizes: [n]; labels: [n, k] counts; size_aim: [splits]; label_aim: [splits, k]; start: [n]. The cost is the
    squared deviation of the sizes plus the mean squared deviation of the labels, both relative to the total.
    """
    rng = np.random.default_rng(seed)
    n, k = labels.shape
    total = max(sizes.sum(), 1)
    weight = 1.0 / max(k, 1)
    split = start.copy()
    size_now = np.bincount(split, weights=sizes, minlength=len(size_aim)).astype(float)
    label_now = np.zeros_like(label_aim, dtype=float)
    np.add.at(label_now, split, labels)
    scale = np.maximum(labels.sum(0), 1)

    def part(s: int) -> float:
        return ((size_now[s] - size_aim[s]) / total) ** 2 + weight * (((label_now[s] - label_aim[s]) / scale) ** 2).sum()

    costs = np.array([part(s) for s in range(len(size_aim))])
    best, best_cost = split.copy(), costs.sum()
    heat = max(best_cost, 1e-9) / 10
    for step in range(steps if n > 1 and len(size_aim) > 1 else 0):
        i = int(rng.integers(n))
        a = int(split[i])
        j = -1
        if rng.random() < 0.5:
            j = int(rng.integers(n))
            b = int(split[j])
        else:
            b = int(rng.integers(len(size_aim)))
        if a == b:
            continue
        by_size, by_label = sizes[i] - (sizes[j] if j >= 0 else 0), labels[i] - (labels[j] if j >= 0 else 0)
        size_now[a] -= by_size
        size_now[b] += by_size
        label_now[a] -= by_label
        label_now[b] += by_label
        new_a, new_b = part(a), part(b)
        worse = new_a + new_b - costs[a] - costs[b]
        if worse <= 0 or rng.random() < np.exp(-worse / max(heat * (1 - step / steps) ** 2, 1e-15)):
            split[i] = b
            if j >= 0:
                split[j] = a
            costs[a], costs[b] = new_a, new_b
            if (now := costs.sum()) < best_cost:
                best, best_cost = split.copy(), now
        else:
            size_now[a] += by_size
            size_now[b] -= by_size
            label_now[a] += by_label
            label_now[b] -= by_label
    return best


def _hashed(keys: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The split each key's uniform number in [0, 1) falls into."""
    return np.minimum(np.searchsorted(np.cumsum(shares), keys, side="right"), len(shares) - 1)


def deviation(split: np.ndarray, sizes: np.ndarray, labels: np.ndarray, size_aim: np.ndarray, label_aim: np.ndarray) -> float:
    """The cost of an assignment: squared deviations of sizes and, on average, of labels, relative to their totals."""
    now = np.zeros_like(label_aim, dtype=float)
    np.add.at(now, split, labels)
    size = np.bincount(split, weights=sizes, minlength=len(size_aim))
    return float((((size - size_aim) / max(sizes.sum(), 1)) ** 2).sum() + (((now - label_aim) / np.maximum(labels.sum(0), 1)) ** 2).sum() / max(labels.shape[1], 1))


def _best(sizes: np.ndarray, labels: np.ndarray, start: np.ndarray, size_aim: np.ndarray, label_aim: np.ndarray, seed: int) -> np.ndarray:
    """The best of the start and several chains from it."""
    chains = [start, *(anneal(sizes, labels, size_aim, label_aim, start, seed + c) for c in range(CHAINS))]
    return min(chains, key=lambda split: deviation(split, sizes, labels, size_aim, label_aim))


def assign(cases: DataFrame, groups: DataFrame, label: str = "scenario_family", shares: dict[str, float] | None = None) -> DataFrame:
    """(case_no, group, split) of every case. ``groups``: (node, root) as from ``related``."""
    shares = shares or SPLITS
    names, aims = list(shares), np.array(list(shares.values()), float)
    aims = aims / aims.sum()
    labelled = cases.groupBy("case_no").agg(F.coalesce(F.min(F.col(f"`{label}`").cast("string")), F.lit("")).alias("_label"))
    member = cut(
        labelled.join(groups.select(F.col("node").alias("case_no"), "root"), "case_no", "left").select(
            "case_no", "_label", F.coalesce("root", "case_no").alias("group")
        )
    )
    totals = {r._label: r.n for r in member.groupBy("_label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_label").limit(LABELS).collect()}
    total = member.count()
    if total > sum(totals.values()):  # what is left is one label
        member = member.withColumn("_label", F.when(F.col("_label").isin(list(totals)), F.concat(F.lit("="), "_label")).otherwise(""))
        totals = {f"={k}": n for k, n in totals.items()} | {"": total - sum(totals.values())}
    kinds = list(totals)
    at = {k: i for i, k in enumerate(kinds)}
    counts = member.groupBy("group", "_label").agg(F.count("*").alias("n"))
    parts = cut(
        counts.groupBy("group").agg(
            F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.struct("_label", "n"))).alias("labels")
        ).withColumn("uniform", (F.xxhash64("group", F.lit(SEED)).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52)))
    )
    bound = max(2, -(-total // LARGE))
    large = parts.where(F.col("size") >= bound).orderBy("group").toPandas()
    whole = np.array([totals[k] for k in kinds], float)

    def matrix(maps) -> np.ndarray:
        out = np.zeros((len(maps), len(kinds)))
        for i, m in enumerate(maps):
            for k, n in dict(m).items():
                out[i, at[k]] = n
        return out

    size_left, label_left = aims * total, np.outer(aims, whole)
    placed: list[tuple[int, str]] = []
    if len(large):
        sizes, labels = large["size"].to_numpy(float), matrix(large["labels"])
        fit = np.zeros(len(large), int)
        room = size_left.copy()
        for k in np.argsort(-sizes, kind="stable"):  # into the split with most room, then exchanged
            fit[k] = int(np.argmax(room))
            room[fit[k]] -= sizes[k]
        # where others are left for the buckets, a split that lacks something is no fault: each aims at its share of these
        part = sizes.sum() / total
        fit = _best(sizes, labels, fit, aims * total * part, label_left * np.where(whole > 0, labels.sum(0) / np.maximum(whole, 1), 0), SEED)
        size_left = np.maximum(size_left - np.bincount(fit, weights=sizes, minlength=len(aims)), 0)
        taken = np.zeros_like(label_left)
        np.add.at(taken, fit, labels)
        label_left = np.maximum(label_left - taken, 0)
        placed = [(g, names[f]) for g, f in zip(large["group"], fit)]
    size_share = size_left / max(size_left.sum(), 1e-12) if size_left.sum() else aims
    label_share = np.where(label_left.sum(0) > 0, label_left / np.maximum(label_left.sum(0), 1e-12), size_share[:, None])

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group", kind="stable")
        sizes, labels = pdf["size"].to_numpy(float), matrix(pdf["labels"])
        here = labels.sum(0) > 0
        start = _hashed(pdf["uniform"].to_numpy(), size_share)
        split = _best(sizes, labels[:, here], start, size_share * sizes.sum(), (label_share * labels.sum(0))[:, here], SEED + int(key[0]))
        return pd.DataFrame({"group": pdf["group"], "split": [names[s] for s in split]})

    small = parts.where(F.col("size") < bound)
    buckets = max(1, round(small.count() / BUCKET))
    kind = dict(cases.dtypes)["case_no"]
    found = (
        small.withColumn("_bucket", F.pmod(F.xxhash64("group", F.lit(SEED + 1)), F.lit(buckets)))
        .groupBy("_bucket")
        .applyInPandas(place, f"group {kind}, split string")
    )
    if placed:
        big = cases.sparkSession.createDataFrame(placed, f"group {kind}, split string")
        near = member.join(F.broadcast(big), "group")
        far = member.join(F.broadcast(big.select("group")), "group", "left_anti").join(found, "group")
        return near.unionByName(far).select("case_no", "group", "split")
    return member.join(found, "group").select("case_no", "group", "split")


def deviations(assigned: DataFrame, cases: DataFrame, label: str = "scenario_family", shares: dict[str, float] | None = None) -> DataFrame:
    """(label, split, cases, share, target) of every label and split; the row with null label is the whole."""
    shares = shares or SPLITS
    joined = assigned.join(cases.select("case_no", F.col(f"`{label}`").cast("string").alias("label")), "case_no")
    counts = joined.groupBy("label", "split").agg(F.count("*").alias("cases"))
    every = counts.withColumn("label", F.coalesce("label", F.lit(""))).unionByName(
        counts.groupBy("split").agg(F.sum("cases").alias("cases")).withColumn("label", F.lit(None).cast("string"))
    )
    target = F.create_map(*(x for k, v in shares.items() for x in (F.lit(k), F.lit(float(v)))))
    share = F.col("cases") / F.sum("cases").over(Window.partitionBy("label"))
    return every.select("label", "split", "cases", F.round(share, 6).alias("share"), target[F.col("split")].alias("target"))
