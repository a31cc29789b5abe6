"""Who a payment may be for: exact identifiers, eight signals of evidence, ranked candidates, and their features.

Everything is keyed by a scope: the world in which a payment is looked at, such as one case or one school. Payments
and students meet by an equi-join on the scope, and all evidence of a pair is computed in its row from arrays, so
nothing is moved for a signal but the links of siblings.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyspark.functions.similarity import winkler
from tallyspark.functions.text import digit_runs, identifier_tokens, normalize_name, tokens
from tallyspark.operators.relations import ALIKE, MEDIUM, STRONG, TOP

#: The signals in the order in which they are looked at; each counts once, all but the last as strong.
SIGNALS = ("name_token_overlap", "alias_token_overlap", "fuzzy_name", "guardian_name", "phone_suffix", "prior_payer", "exact_balance", "sibling_rider")


@F.arrow_udf(T.DoubleType())
def _best_similarity(probes: pa.Array, targets: pa.Array) -> pa.Array:
    rows = zip(probes.to_pylist(), targets.to_pylist())
    return pa.array([max((winkler(x, y) for x in xs or [] for y in ys or [] if y), default=0.0) for xs, ys in rows], pa.float64())


_best_similarity = _best_similarity.asNondeterministic()  # run once, also under filters


def exact_identifiers(payments: DataFrame, students: DataFrame) -> DataFrame:
    """(scope, payment_id, student_id): the first token of the narration that is a student's id in capitals.
    payments: (scope, payment_id, narration); students: (scope, student_id)."""
    told = payments.select("scope", "payment_id", F.posexplode(identifier_tokens(F.col("narration"))).alias("pos", "student_id"))
    return told.join(students.select("scope", "student_id").distinct(), ["scope", "student_id"]).groupBy("scope", "payment_id").agg(F.min_by("student_id", "pos").alias("student_id"))


def _some(array: Column, test) -> Column:
    return F.coalesce(F.exists(array, test), F.lit(False))


def evidence(pairs: DataFrame) -> DataFrame:
    """Adds ``similarity``, the likeness of the payment's words and the student's names, and ``signals``, those of the first seven
    that fire, to pairs of a payment and a student of its scope.

    pairs: (scope, payment_id, student_id, payer, narration, amount_minor, name, aliases array, guardians
    array<struct<id, name, phone_suffix>>, balances array<struct<charge_id, balance>> in the order of payment, prior boolean).
    """
    texts = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    out = pairs.withColumns({"_payer": normalize_name(F.col("payer")), "_name": normalize_name(F.col("name")), "_runs": digit_runs(F.col("narration"))})
    out = out.withColumn("_aliases", F.array_distinct(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), normalize_name)))
    out = out.withColumn("_probe", F.array_union(tokens(F.col("narration")), texts(F.col("_payer"))))
    out = out.withColumn("similarity", _best_similarity("_probe", F.concat(F.array("_name"), "_aliases")))
    guardian = lambda g: (normalize_name(g["name"]) != "") & (F.contains("_payer", normalize_name(g["name"])) | F.arrays_overlap(texts(normalize_name(g["name"])), "_probe"))
    phone = lambda g: (F.coalesce(g["phone_suffix"], F.lit("")) != "") & F.exists("_runs", lambda run: F.endswith(run, g["phone_suffix"]))
    fires = (
        F.arrays_overlap(texts(F.col("_name")), "_probe"), F.arrays_overlap("_aliases", "_probe"), F.col("similarity") >= ALIKE, _some(F.col("guardians"), guardian), _some(F.col("guardians"), phone),
        F.col("prior"), (F.col("amount_minor") > 0) & _some(F.col("balances"), lambda b: b["balance"] == F.col("amount_minor")),
    )
    fired = F.array_compact(F.array(*(F.when(F.coalesce(f, F.lit(False)), F.lit(s)) for f, s in zip(fires, SIGNALS))))
    return out.withColumn("signals", fired).drop("_payer", "_name", "_runs", "_aliases")


def with_siblings(found: DataFrame) -> DataFrame:
    """The pairs with a signal, and those without one whose student shares a guardian with one that has, as siblings.
    Adds ``score``. found: as from ``evidence``."""
    kin = lambda df: df.select("scope", "payment_id", "student_id", F.explode(F.array_distinct(F.transform("guardians", lambda g: g["id"]))).alias("g"))
    scored = found.where(F.size("signals") > 0)
    near = kin(scored).select("scope", "payment_id", "g").distinct()
    riders = kin(found.where(F.size("signals") == 0)).join(near, ["scope", "payment_id", "g"], "left_semi").select("scope", "payment_id", "student_id").distinct().withColumn("_rider", F.lit(True))
    out = found.join(riders, ["scope", "payment_id", "student_id"], "left").where("size(signals) > 0 or _rider")
    out = out.withColumn("score", F.when(F.col("_rider"), MEDIUM).otherwise(F.size("signals") * STRONG))
    return out.withColumn("signals", F.when(F.col("_rider"), F.array(F.lit(SIGNALS[-1]))).otherwise(F.col("signals"))).drop("_rider")


def ranked(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """The best few candidates of each payment by score, then id, with ``rank``, ``pool``, how many there were, and ``next``, the
    score of the one behind."""
    order = Window.partitionBy("scope", "payment_id").orderBy(F.desc("score"), "student_id")
    whole = Window.partitionBy("scope", "payment_id")
    out = candidates.withColumns({"rank": F.row_number().over(order), "pool": F.count("*").over(whole), "next": F.lead("score").over(order)})
    return out.where(F.col("rank") <= top).withColumn("next", F.when(F.col("rank") < top, F.col("next")))


def features(chosen: DataFrame) -> DataFrame:
    """The nine features of a chosen candidate and ``features_version``. chosen: a ranked candidate with allocated_minor, the amount
    proposed for it, top_score and second_score of the candidates that were kept, top, whether it is the first, dry_ok,
    shed and kept, how many candidates were kept. All but the last four are about a candidate and 0 without one."""
    own = F.col("student_id").isNotNull()
    guardian = _some(F.col("guardians"), lambda g: F.array_contains("_probe", F.element_at(F.split(normalize_name(g["name"]), " "), 1)) & (normalize_name(g["name"]) != ""))
    first = F.get("balances", F.lit(0))["balance"]
    agreement = F.when(own & first.isNotNull() & F.col("allocated_minor").isNotNull(), 1 - F.least(F.lit(1.0), F.abs(F.col("allocated_minor") - first) / F.greatest(first, F.lit(1)))).otherwise(0.0)
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return chosen.withColumns({
        "features_version": F.lit(1),
        "name_alias_similarity": F.round(F.when(own, F.col("similarity")).otherwise(0.0), 4),
        "guardian_relationship": flag(own & guardian),
        "amount_to_balance_agreement": F.round(agreement, 4),
        "historical_payer_consistency": flag(own & F.col("prior")),
        "candidate_separation": F.round((F.coalesce("top_score", F.lit(1)) - F.coalesce("second_score", F.lit(0))) / F.greatest(F.coalesce("top_score", F.lit(1)), F.lit(1)), 4),
        "llm_ranking_consistency": flag(F.coalesce("top", F.lit(False))),
        "constraint_validation_result": flag(F.col("dry_ok")),
        "budget_shed": flag(F.col("shed")),
        "candidate_count": F.coalesce("kept", F.lit(0)),
    })
