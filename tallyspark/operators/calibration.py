"""A fitted confidence: its artefact with the rules it must keep, scores, routes, threshold, and its verification."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import sigmoid
from tallyspark.operators.evaluation import fit_logistic, standardisation

#: The features in the order of the coefficients, the version they are made by, and the limits of an artefact.
FEATURES = (
    "name_alias_similarity", "guardian_relationship", "amount_to_balance_agreement", "historical_payer_consistency", "candidate_separation", "llm_ranking_consistency",
    "constraint_validation_result", "budget_shed", "candidate_count",
)
PLAIN, VERSION, LEAST_AUTO, REVIEW, LEAST_FITS, LEAST_HELD_OUT = 7, 1, 0.90, 0.65, 25, 200


@dataclass(frozen=True)
class Artefact:
    """Standardisation, intercept and coefficients of a logistic confidence with its thresholds and counts."""

    means: tuple[float, ...]
    scales: tuple[float, ...]
    intercept: float
    coefficients: tuple[float, ...]
    model_sha256: str
    manifest_sha256: str
    auto_threshold: float = LEAST_AUTO
    review_threshold: float = REVIEW
    auto_enabled: bool = False
    positives: int = 0
    negatives: int = 0
    held_out: int = 0
    held_out_negatives: int = 0
    held_out_false: int = 0
    seed: int = 0
    features: tuple[str, ...] = FEATURES
    features_version: int = VERSION
    schema_version: int = 1

    def problems(self, model_sha256: str | None = None) -> list[str]:
        """Every rule that the artefact breaks; one with problems may not be used."""
        wide = len(FEATURES)
        numbers = (*self.means, *self.scales, *self.coefficients, self.intercept, self.auto_threshold, self.review_threshold)
        digest = lambda x: len(x) == 64 and set(x) <= set("0123456789abcdef")
        rules = {
            "schema_version": self.schema_version == 1,
            "features_version": self.features_version == VERSION,
            "features": tuple(self.features) == FEATURES,
            "width": len(self.means) == len(self.scales) == len(self.coefficients) == wide,
            "finite": all(math.isfinite(x) for x in numbers),
            "scales": all(x > 0 for x in self.scales),
            "order": 0 <= self.review_threshold <= self.auto_threshold <= 1,
            "auto_threshold": self.auto_threshold >= LEAST_AUTO,
            "review_threshold": self.review_threshold == REVIEW,
            "counts": min(self.positives, self.negatives) >= 0 and 0 <= self.held_out_negatives <= self.held_out,
            "fits": not self.auto_enabled or min(self.positives, self.negatives) >= LEAST_FITS,
            "held_out": not self.auto_enabled or (self.held_out >= LEAST_HELD_OUT and self.held_out_false == 0),
            "model": digest(self.model_sha256) and (model_sha256 is None or self.model_sha256 == model_sha256.lower()),
            "manifest": digest(self.manifest_sha256.lower()),
        }
        return [name for name, kept in rules.items() if not kept]


def confidence(artefact: Artefact | None) -> Column:
    """The score of a row with the features: without an artefact the mean of the first seven, of another version 0."""
    if artefact is None:
        return F.round(sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES[:PLAIN]), F.lit(0.0)) / PLAIN, 4)
    z = F.lit(float(artefact.intercept))
    for name, mean, scale, weight in zip(artefact.features, artefact.means, artefact.scales, artefact.coefficients):
        z = z + F.lit(float(weight)) * ((F.coalesce(F.col(name).cast("double"), F.lit(0.0)) - F.lit(float(mean))) / F.lit(float(scale)))
    return F.when(F.col("features_version") == artefact.features_version, F.round(sigmoid(z), 8)).otherwise(F.lit(0.0))


def routed(artefact: Artefact | None, score: Column) -> Column:
    """auto, review or unmatched; review wherever there is no artefact, another version or no leave to post."""
    if artefact is None or not artefact.auto_enabled:
        return F.lit("review")
    own = F.col("features_version") == artefact.features_version
    return F.when(~F.coalesce(own, F.lit(False)), "review").when(score >= artefact.auto_threshold, "auto").when(score < artefact.review_threshold, "unmatched").otherwise("review")


def fit(rows: DataFrame, held_out: DataFrame, model_sha256: str, manifest_sha256: str, seed: int = 7, most_rows: int = 100_000) -> Artefact:
    """An artefact from labelled rows: standardised features, logistic fit, and the least threshold that no negative
    of ``held_out`` passes. Posting is enabled if both have rows enough and such a threshold exists.
    rows, held_out: the features, features_version and label."""
    scale = {r.feature: r for r in standardisation(rows, *FEATURES).collect()}
    means, scales = ([float(getattr(scale[f], c) or 0.0) for f in FEATURES] for c in ("mean", "deviation"))
    scales = [s or 1.0 for s in scales]
    level = rows.select(*((F.col(f) - m) / s if s else F.col(f) for f, m, s in zip(FEATURES, means, scales)), "label").toDF(*FEATURES, "label")
    bias, weights = fit_logistic(level, list(FEATURES), "label", most_rows, seed=seed)
    counts = rows.agg(F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("n")).first()
    first = Artefact(tuple(means), tuple(scales), float(bias), tuple(map(float, weights)), model_sha256, manifest_sha256, seed=seed, positives=counts.p, negatives=counts.n)
    judged = held_out.select("label", confidence(first).alias("score")).agg(F.count("*").alias("k"), F.count_if(~F.col("label")).alias("n"), F.max(F.when(~F.col("label"), F.col("score"))).alias("worst")).first()
    threshold = max(LEAST_AUTO, math.nextafter(judged.worst, math.inf)) if judged.worst is not None else LEAST_AUTO
    enabled = threshold <= 1 and min(counts.p, counts.n) >= LEAST_FITS and judged.k >= LEAST_HELD_OUT
    return Artefact(**{**first.__dict__, "auto_threshold": min(threshold, 1.0), "auto_enabled": enabled, "held_out": judged.k, "held_out_negatives": judged.n})


def wrong_automatic(rows: DataFrame, artefact: Artefact) -> DataFrame:
    """The rows that the artefact would post although they are labelled false: what a verification must not find."""
    scored = rows.withColumn("score", confidence(artefact))
    return scored.where(~F.col("label") & (routed(artefact, F.col("score")) == "auto"))
