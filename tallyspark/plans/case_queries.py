"""Payments of the cases against their worlds: evidence, candidates, features, answers, states, reviews and evaluation, with
their SQL. All cases are looked at in one job; a case is its own scope."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.money import parse_money
from tallyspark.functions.text import normalize_name
from tallyspark.operators import calibration, candidates, modelpath, reconcile
from tallyspark.tables import table

#: A fixed artefact for the queries; a fitted one comes from ``calibration.fit``.
ARTEFACT = calibration.Artefact(
    (0.9, 0.5, 0.7, 0.1, 0.4, 0.9, 0.95, 0.0, 2.0), (0.1, 0.5, 0.3, 0.3, 0.3, 0.3, 0.2, 1.0, 1.0), 0.6, (1.1, 0.9, 1.4, 0.4, 0.8, 0.5, 0.7, -0.3, -0.2),
    "a" * 64, "b" * 64, 0.95, 0.65, True, 300, 100, 400, 100,
)
CODES = (
    "EXACT_STUDENT_ID", "SINGLE_GUARDIAN_STUDENT", "EXACT_OUTSTANDING_BALANCE", "KNOWN_PAYER_MAPPING", "DUPLICATE_REFERENCE", "AMBIGUOUS_CANDIDATES", "NO_CANDIDATE", "PROMPT_BUDGET_EXCEEDED",
    "INFERENCE_UNAVAILABLE", "SCHEMA_INVALID", "MODEL_RANKED", "MODEL_ABSTAINED", "OVERPAYMENT_REQUIRES_REVIEW",
)
#: Tokens of the prompts of these queries.
BUDGET = 330
SYSTEM = "Decide which of the candidate students a bank payment is for. Answer with one JSON object; use only the given ids and codes, whole minor units, and review when in doubt."


def _cases(spark, folder):
    """Payments of the cases; every fifth case that is to be posted names its first student's id."""
    cases = table(spark, folder, "gold_cases", "case_no", "id", "split", "scenario_family", "language", "setup", "txn", "expected")
    told = F.concat(F.coalesce("txn.narration", F.lit("")), F.lit(" "), F.get("setup.students", F.lit(0))["id"])
    return cases.select(
        F.col("case_no").alias("scope"), F.col("id").alias("payment_id"), "split", "scenario_family", "language", "setup", "expected", F.col("txn.payer_name").alias("payer"),
        F.when((F.col("expected.outcome") == "auto") & (F.col("case_no") % 5 == 0), told).otherwise(F.col("txn.narration")).alias("narration"), parse_money(F.col("txn.amount_naira")).alias("amount_minor"),
    )


def _guardian_key(text):
    return F.upper(F.trim(text))


def _history(spark, folder):
    """(payer, student_id, since): the first training case in which a payer, as normalised, paid for a student; each sixth case
    brings the like of its own payment as history."""
    cases = _cases(spark, folder).where("split = 'train'")
    paid = cases.select(F.when(F.col("scope") % 6 == 0, F.col("scope") - 1).otherwise(F.col("scope")).alias("scope"), normalize_name(F.col("payer")).alias("who"), F.explode(F.transform("expected.allocations", lambda a: a["student_id"])).alias("student_id"))
    return paid.where("who <> ''").groupBy("who", "student_id").agg(F.min("scope").alias("since"))


def _pairs(spark, folder):
    world = _cases(spark, folder).select("*", F.explode("setup.students").alias("s"))
    own = F.transform("s.guardians", _guardian_key)
    guardians = F.transform(F.filter("setup.guardians", lambda g: F.array_contains(own, _guardian_key(g["id"]))), lambda g: F.struct(_guardian_key(g["id"]).alias("id"), g["name"].alias("name"), g["phone_suffix"].alias("phone_suffix")))
    charge = lambda c: F.struct(F.concat_ws("-", F.lit("CHG"), F.col("s.id"), c["fee_id"]).alias("charge_id"), parse_money(c["amount_naira"]).alias("balance"))
    pairs = world.select(
        "scope", "payment_id", "payer", "narration", "amount_minor", F.col("s.id").alias("student_id"), F.col("s.name").alias("name"), F.coalesce("s.aliases", F.array().cast("array<string>")).alias("aliases"),
        F.coalesce(guardians, F.array().cast("array<struct<id:string,name:string,phone_suffix:string>>")).alias("guardians"),
        F.array_sort(F.filter(F.coalesce(F.transform("s.charges", charge), F.array().cast("array<struct<charge_id:string,balance:bigint>>")), lambda b: b["balance"] > 0)).alias("balances"),
    )
    known = pairs.withColumn("who", normalize_name(F.col("payer"))).join(_history(spark, folder), ["who", "student_id"], "left")
    return known.withColumn("prior", F.coalesce(F.col("since") < F.col("scope"), F.lit(False))).drop("who", "since")


def _ranked(spark, folder):
    return candidates.ranked(candidates.with_siblings(candidates.evidence(_pairs(spark, folder))))


def exact_matches(spark, folder):
    """(case_no, student_id, full_balance): payments that quote a student's id."""
    cases = _cases(spark, folder)
    students = cases.select("scope", F.explode("setup.students").alias("s")).select("scope", F.col("s.id").alias("student_id"))
    found = candidates.exact_identifiers(cases, students)
    owed = F.aggregate("balances", F.lit(0).cast("bigint"), lambda a, b: a + b["balance"])
    return found.join(_pairs(spark, folder), ["scope", "payment_id", "student_id"]).select(F.col("scope").alias("case_no"), "student_id", (owed == F.col("amount_minor")).alias("full_balance"))


def candidate_signals(spark, folder):
    """(case_no, student_id, signals, score) of every candidate."""
    found = candidates.with_siblings(candidates.evidence(_pairs(spark, folder)))
    return found.select(F.col("scope").alias("case_no"), "student_id", F.array_join("signals", ",").alias("signals"), F.col("score").cast("bigint").alias("score"))


def candidate_top5(spark, folder):
    """(case_no, student_id, score, rank, pool, outstanding): the best five with what they owe."""
    lines = F.transform("balances", lambda b: F.concat_ws(":", b["charge_id"], b["balance"].cast("string")))
    return _ranked(spark, folder).select(F.col("scope").alias("case_no"), "student_id", F.col("score").cast("bigint").alias("score"), "rank", "pool", F.array_join(lines, ",").alias("outstanding"))


def prior_payers(spark, folder):
    """(case_no, student_id): students the payer paid for in an earlier training case."""
    return _pairs(spark, folder).where("prior").select(F.col("scope").alias("case_no"), "student_id")


def _prompts(spark, folder):
    """Per payment with candidates its ladder: (scope, payment_id, kept, prompt, listed)."""
    line = F.struct(
        "rank", "student_id", "name", "aliases", F.array_compact(F.transform("guardians", lambda g: g["name"])).alias("guardians"), "balances", "prior",
        (F.array_contains("signals", "fuzzy_name") | F.array_contains("signals", "alias_token_overlap")).alias("alias_told"), F.col("score"),
    )
    listed = _ranked(spark, folder).groupBy("scope", "payment_id").agg(F.array_sort(F.collect_list(line)).alias("listed"), *(F.first(c).alias(c) for c in ("payer", "narration", "amount_minor")))
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    head = F.concat(
        F.lit(f"<|im_start|>system\n{SYSTEM}<|im_end|>\n<|im_start|>user\nTransaction: id="), F.col("payment_id"), F.lit(" payer="), show("payer"), F.lit(" amount_minor="), show("amount_minor"),
        F.lit("\nNarration: "), show("narration"), F.lit("\nAllowed reason_codes: " + ",".join(CODES) + "\nCandidates:"),
    )
    ladder = listed.withColumn("ladder", reconcile.prompt_ladder(head, F.col("listed"), BUDGET))
    return ladder.select("scope", "payment_id", "listed", F.col("ladder.kept").alias("kept"), F.concat(F.col("ladder.prompt"), F.lit(" /no_think<|im_end|>\n<|im_start|>assistant")).alias("prompt"))


def prompt_ladder(spark, folder):
    """(case_no, kept, prompt, answer): prompts under a tight budget, so that all steps occur."""
    return _prompts(spark, folder).select(F.col("scope").alias("case_no"), "kept", F.md5("prompt").alias("prompt"), modelpath.answer_budget(F.col("prompt")).alias("answer"))


def answer_grammars(spark, folder):
    """(case_no, grammar): digests of what answers are restricted to."""
    ids = F.transform(F.slice("listed", 1, F.greatest("kept", F.lit(1))), lambda c: c["student_id"])
    return _prompts(spark, folder).where("kept > 0").select(F.col("scope").alias("case_no"), F.md5(reconcile.grammar(F.col("payment_id"), ids, CODES)).alias("grammar"))


def chat_forms(spark, folder):
    """(case_no, joined, separate): digests of the prompts in the chat forms of two model families."""
    shown = _prompts(spark, folder).where("kept > 0")
    return shown.select(F.col("scope").alias("case_no"), F.get_json_object(modelpath.messages(F.col("prompt"), "joined"), "$[0].content").substr(1, 40).alias("joined"), F.md5(F.get_json_object(modelpath.messages(F.col("prompt"), "separate"), "$[1].content")).alias("separate"))


def _answered(spark, folder):
    """Every payment with the answer of a deterministic stand-in for a model: the whole amount to the first candidate, review where the
    first two are equal; some answers fail in transport, are no JSON or name a stranger."""
    cases = _cases(spark, folder).select("scope", "payment_id", "amount_minor", "setup", "expected", "scenario_family", "language")
    prompts = _prompts(spark, folder).select("scope", "kept", F.col("listed").alias("all"), F.slice("listed", 1, F.greatest("kept", F.lit(1))).alias("listed"))
    joined = cases.join(prompts, "scope", "left").withColumn("first", F.get("listed", F.lit(0)))
    n, no = F.col("scope"), F.array().cast("array<string>")
    equal = F.col("first.score") == F.get("listed", F.lit(1))["score"]
    line = F.struct(F.when(n % 23 == 0, F.lit("STU-X")).otherwise(F.col("first.student_id")).alias("student_id"), F.col("amount_minor").alias("amount_minor"), F.array(F.lit("MODEL_RANKED")).alias("reason_codes"))
    raw = F.to_json(F.struct(F.col("payment_id").alias("transaction_id"), F.when(equal, "review").otherwise("auto").alias("recommended_action"), F.lit("first of the list").alias("explanation"), F.array(line).alias("candidate_allocations")))
    raw = F.when(n % 29 == 0, F.lit("{no json")).when(n % 31 != 0, raw)
    allowed = F.coalesce(F.transform("listed", lambda c: c["student_id"]), no)
    problem = modelpath.output_problem(F.col("raw"), F.col("payment_id"), F.col("allowed"), CODES, ("auto", "review", "unmatched"))
    out = joined.withColumns({"raw": raw, "allowed": allowed}).withColumn("problem", F.when(F.col("raw").isNotNull(), problem))
    failure = F.when(F.col("first").isNull(), "no_candidates").when(F.col("kept") == 0, "prompt_budget").when(F.col("raw").isNull(), "transport").when(F.col("problem").isNotNull(), "schema")
    out = out.withColumn("failure", failure).withColumn("takes", reconcile.distributed(F.col("first.balances"), F.col("amount_minor")))
    exact = candidates.exact_identifiers(_cases(spark, folder), cases.select("scope", F.explode("setup.students").alias("s")).select("scope", F.col("s.id").alias("student_id")))
    out = out.join(exact.select("scope", F.col("student_id").alias("exact_student")), "scope", "left")
    held = F.get(F.filter("setup.students", lambda s: s["id"] == F.col("exact_student")), F.lit(0))
    charge = lambda c: F.struct(F.concat_ws("-", F.lit("CHG"), F.col("exact_student"), c["fee_id"]).alias("charge_id"), parse_money(c["amount_naira"]).alias("balance"))
    return out.withColumn("exact_balances", F.array_sort(F.filter(F.transform(held["charges"], charge), lambda b: b["balance"] > 0)))


def _features(spark, folder):
    """The features of every payment that is neither matched exactly nor without a valid answer."""
    found = candidates.evidence(_pairs(spark, folder)).select("scope", "student_id", "similarity", "guardians", "balances", "prior", "_probe")
    good = _answered(spark, folder).where("exact_student is null and failure is null").select(
        "scope", F.col("first.student_id").alias("student_id"), F.col("amount_minor").alias("allocated_minor"), F.col("first.score").alias("top_score"), F.get("listed", F.lit(1))["score"].alias("second_score"),
        F.lit(True).alias("top"), (F.col("amount_minor") >= 0).alias("dry_ok"), (F.size("listed") < F.size("all")).alias("shed"), F.size("listed").alias("kept"),
    )
    return candidates.features(good.join(found, ["scope", "student_id"]))


def feature_vector(spark, folder):
    return _features(spark, folder).select(F.col("scope").alias("case_no"), *calibration.FEATURES)


def confidence_score(spark, folder):
    """(case_no, plain, score, route) without and with an artefact."""
    score = calibration.confidence(ARTEFACT)
    return _features(spark, folder).select(F.col("scope").alias("case_no"), calibration.confidence(None).alias("plain"), score.alias("score"), calibration.routed(ARTEFACT, score).alias("route"))


def reconcile_states(spark, folder):
    """(case_no, state, reason, confidence): the final state of every payment; each 37th was posted before."""
    score = calibration.confidence(ARTEFACT)
    judged = _features(spark, folder).select("scope", "shed", "dry_ok", score.alias("score"), calibration.routed(ARTEFACT, score).alias("action"))
    owed = F.aggregate(F.coalesce("exact_balances", F.array().cast("array<struct<charge_id:string,balance:bigint>>")), F.lit(0).cast("bigint"), lambda a, b: a + b["balance"])
    every = _answered(spark, folder).join(judged, "scope", "left").withColumns({
        "used_minor": F.when(F.col("scope") % 37 == 0, F.col("amount_minor")), "state_before": F.lit("approved"), "exact_open": owed, "candidates": F.coalesce(F.size("all"), F.lit(0)),
        "allocated_minor": F.col("amount_minor"), "remainder": F.col("takes.left"), "failure": F.when(F.col("failure") != "no_candidates", F.col("failure")),
    })
    every = every.withColumn("candidates", F.greatest("candidates", F.lit(0)))
    confidence = F.when(F.col("reason") == "EXACT_STUDENT_ID", 1.0).when(F.col("exact_student").isNull() & F.coalesce(F.col("used_minor") <= 0, F.lit(True)), F.col("score"))
    return reconcile.final_states(every).select(F.col("scope").alias("case_no"), "state", "reason", confidence.alias("confidence"))


def _evaluated(spark, folder):
    """One record per case, with flags that are null where they do not apply."""
    fee = lambda a: F.coalesce(a["fee_id"], F.get(F.filter("setup.students", lambda s: (s["id"] == a["student_id"]) & (F.size(s["charges"]) == 1)), F.lit(0))["charges"][0]["fee_id"])
    wanted = F.transform("expected.allocations", lambda a: F.concat_ws("|", a["student_id"], F.concat_ws("-", F.lit("CHG"), a["student_id"], fee(a)), parse_money(a["amount_naira"]).cast("string")))
    first = F.get("expected.allocations", F.lit(0))["student_id"]
    truth = F.coalesce("expected.pool_must_include", F.transform("expected.allocations", lambda a: a["student_id"]))
    exact, done = F.col("exact_student").isNotNull(), F.col("failure").isNull()
    abstains = F.size("expected.allocations") == 0
    made = F.when(exact, reconcile.triples(F.col("exact_student"), reconcile.distributed(F.col("exact_balances"), F.col("amount_minor")), F.lit(True))).when(done, reconcile.triples(F.col("first.student_id"), F.col("takes"), F.lit(True)))
    action = F.get_json_object("raw", "$.recommended_action")
    none = F.lit(None).cast("boolean")
    model_abstains = F.when(exact, none).when(done, action == "unmatched").otherwise(F.col("failure") == "no_candidates")
    return _answered(spark, folder).select(
        F.col("scope").alias("case_id"), F.col("scenario_family").alias("family"), F.col("language").alias("group"), exact.alias("auto"), abstains.alias("abstains"), model_abstains.alias("model_abstains"),
        (F.array_sort(F.array_distinct(made)) == F.array_sort(F.array_distinct(wanted))).alias("exact_allocation"),
        F.when(exact, F.col("expected.outcome") == "auto").when(done, action == F.col("expected.outcome")).alias("correct"),
        F.when(exact, F.col("exact_student") == first).when(done & first.isNotNull(), F.col("first.student_id") == first).when(done, F.lit(False)).alias("top1"),
        F.when(~exact & (F.size(truth) > 0), F.size(F.array_except(truth, "allowed")) == 0).alias("pool_recall"),
        F.when(~exact & done, F.lit(True)).when(~exact & (F.col("failure") == "schema"), F.lit(False)).alias("valid_json"),
        F.when(~exact, F.coalesce(F.col("problem") == "unknown_student_id", F.lit(False)) & (F.coalesce("failure", F.lit("")) == "schema")).alias("unsupported_id"),
    )


def case_records(spark, folder):
    return _evaluated(spark, folder)


def metric_set(spark, folder):
    """One row with the measures over all cases."""
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    c = F.col
    return _evaluated(spark, folder).agg(
        F.count_if(c("auto") & (~c("exact_allocation"))).alias("incorrect_auto_posts"), rate(c("correct")).alias("action_accuracy"), rate(c("valid_json")).alias("valid_json_rate"), rate(c("top1")).alias("top1_student"),
        rate(c("exact_allocation")).alias("exact_allocation"), rate(F.when(c("family") == "sibling_split", c("exact_allocation"))).alias("sibling_split"), rate(c("pool_recall")).alias("pool_recall"),
        rate(c("unsupported_id")).alias("unsupported_id_rate"), rate(F.when(c("model_abstains"), c("abstains"))).alias("abstention_precision"), rate(F.when(c("abstains"), F.coalesce("model_abstains", F.lit(False)))).alias("abstention_recall"),
    )


def language_accuracy(spark, folder):
    return _evaluated(spark, folder).groupBy("group").agg(F.round(F.avg(F.col("top1").cast("double")), 6).alias("top1"), F.count("*").alias("cases"))


def calibration_labels(spark, folder):
    """(case_no, label): whether an answer may count as right for a fit: no failure, the expected postings, none of them
    credit, the whole amount, and a dry run without violation."""
    seen = _answered(spark, folder).where("exact_student is null").select("scope", "failure", F.col("takes.left").alias("left"), (F.col("amount_minor") >= 0).alias("dry_ok"))
    joined = seen.join(_evaluated(spark, folder).select(F.col("case_id").alias("scope"), "exact_allocation"), "scope")
    label = F.col("failure").isNull() & F.coalesce("exact_allocation", F.lit(False)) & (F.col("left") == 0) & F.col("dry_ok")
    return joined.select(F.col("scope").alias("case_no"), F.coalesce(label, F.lit(False)).alias("label"))


def split_divergence(spark, folder):
    """(case_no, dealt): cases whose authored lines are not what distributing each student's total over the charges gives."""
    cases = _cases(spark, folder).where("size(expected.allocations) > 0")
    amounts = F.transform("expected.allocations", lambda a: F.struct(a["student_id"].alias("student_id"), parse_money(a["amount_naira"]).alias("amount_minor")))
    charge = lambda s, c: F.struct(F.concat_ws("-", F.lit("CHG"), s["id"], c["fee_id"]).alias("charge_id"), parse_money(c["amount_naira"]).alias("balance"))
    zero = F.lit(0).cast("bigint")
    total = lambda s: F.aggregate(F.filter("_a", lambda a: a["student_id"] == s["id"]), zero, lambda x, a: x + F.coalesce(a["amount_minor"], zero))
    open_ = lambda s: F.array_sort(F.filter(F.transform(s["charges"], lambda c: charge(s, c)), lambda b: b["balance"] > 0))
    paid = F.filter("setup.students", lambda s: F.exists("_a", lambda a: a["student_id"] == s["id"]))
    natural = F.flatten(F.transform(paid, lambda s: reconcile.triples(s["id"], reconcile.distributed(open_(s), total(s)), F.lit(True))))
    fee = lambda a: F.coalesce(a["fee_id"], F.get(F.filter("setup.students", lambda s: (s["id"] == a["student_id"]) & (F.size(s["charges"]) == 1)), F.lit(0))["charges"][0]["fee_id"])
    wanted = F.transform("expected.allocations", lambda a: F.concat_ws("|", a["student_id"], F.concat_ws("-", F.lit("CHG"), a["student_id"], fee(a)), parse_money(a["amount_naira"]).cast("string")))
    both = cases.withColumn("_a", amounts).select(F.col("scope").alias("case_no"), F.array_sort(F.array_distinct(natural)).alias("dealt"), F.array_sort(F.array_distinct(wanted)).alias("wanted"))
    return both.where("dealt <> wanted").select("case_no", F.array_join("dealt", ",").alias("dealt"))


def app_examples(spark, folder):
    """(case_no, prompt, completion): digests of the prompts of cases whose students are all in the pool, with the answer wanted."""
    cases = _cases(spark, folder).where("expected.outcome <> 'duplicate_blocked'").select("scope", "expected", "scenario_family")
    joined = _prompts(spark, folder).where("kept > 0").join(cases, "scope")
    pool = F.transform(F.slice("listed", 1, F.greatest("kept", F.lit(1))), lambda c: c["student_id"])
    truth = F.transform("expected.allocations", lambda a: a["student_id"])
    lines = F.transform("expected.allocations", lambda a: F.struct(a["student_id"].alias("student_id"), parse_money(a["amount_naira"]).alias("amount_minor")))
    answer = F.to_json(F.struct(F.col("payment_id").alias("transaction_id"), F.col("scenario_family").alias("payment_intent"), lines.alias("candidate_allocations"), F.col("expected.outcome").alias("recommended_action")), {"ignoreNullFields": "false"})
    return joined.where(F.size(F.array_except(truth, pool)) == 0).select(F.col("scope").alias("case_no"), F.md5("prompt").alias("prompt"), F.md5(answer).alias("completion"))


def evidence_snapshots(spark, folder):
    """(row_id, evidence): digests of what a decision keeps of a payment, as it was then."""
    kept = ("transaction_id", "source", "reference", "raw_reference", "posted_at", "payer_name", "narration", "amount_minor", "direction")
    rows = table(spark, folder, "canonical_transactions", "row_id", *kept)
    return rows.select("row_id", F.md5(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"})).alias("evidence"))


def superseded_proposals(spark, folder):
    """(transaction_id, proposals, pending): proposals of a transaction, of which only the latest still waits."""
    rows = table(spark, folder, "canonical_transactions", "row_id", "transaction_id").where("transaction_id is not null")
    return rows.groupBy("transaction_id").agg(F.count("*").alias("proposals"), F.max("row_id").alias("pending"))


def frozen_cases(spark, folder):
    """(id, problem): of the frozen ids of the test split, and one that never was, those that the cases lack or have twice."""
    cases = table(spark, folder, "gold_cases", "id", "split")
    frozen = cases.where("split = 'test'").select("id").unionByName(spark.createDataFrame([("gold-none",)], "id string"))
    have = cases.groupBy("id").agg(F.count("*").alias("n"))
    return frozen.distinct().join(have, "id", "left").select("id", F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").alias("problem")).where("problem is not null")


def students_by_name(spark, folder):
    return table(spark, folder, "students", "student_id", "name").orderBy("name", "student_id")


def review_decisions(spark, folder):
    """(case_no, outcome, allocations, allocated_minor, unapplied_minor, credit_minor) of decisions on the cases' expected lines: each
    tenth proposal was decided before, each seventh is rejected; some edits name strangers or too much."""
    cases = _cases(spark, folder)
    n = F.col("scope")
    factor = F.when(n % 11 == 0, 2).when(n % 17 == 0, -1).otherwise(1)
    edits = F.transform("expected.allocations", lambda a: F.struct(F.when(n % 13 == 0, F.lit("STU-X")).otherwise(F.concat(F.lit(" "), a["student_id"])).alias("student_id"), (parse_money(a["amount_naira"]) * factor).alias("amount_minor")))
    charge = lambda s, c: F.struct(F.concat_ws("-", F.lit("CHG"), s["id"], c["fee_id"]).alias("charge_id"), parse_money(c["amount_naira"]).alias("balance"))
    known = F.transform("setup.students", lambda s: F.struct(s["id"].alias("student_id"), F.array_sort(F.filter(F.transform(s["charges"], lambda c: charge(s, c)), lambda b: b["balance"] > 0)).alias("balances")))
    ids = F.transform("setup.students", lambda s: s["id"])
    decisions = cases.select(
        n.alias("proposal_id"), F.when(n % 10 == 0, "approved").otherwise("pending").alias("status"), F.when(n % 7 == 0, "reject").otherwise("approve").alias("decision"), "amount_minor", edits.alias("edits"), ids.alias("allowed"),
        known.alias("known"), F.when(n % 3 == 0, F.when(n % 9 == 0, F.lit("GHOST")).otherwise(F.get("setup.guardians", F.lit(0))["id"])).alias("credit_holder"), F.concat(ids, F.transform("setup.guardians", lambda g: g["id"])).alias("holders"),
    )
    return reconcile.reviewed(decisions).withColumnRenamed("proposal_id", "case_no").withColumn("allocations", F.array_join("allocations", ","))


QUERIES = {
    f.__name__: f
    for f in (
        exact_matches, candidate_signals, candidate_top5, prior_payers, prompt_ladder, answer_grammars, chat_forms, feature_vector, confidence_score, reconcile_states, case_records, metric_set,
        language_accuracy, calibration_labels, review_decisions, split_divergence, app_examples, evidence_snapshots, superseded_proposals, frozen_cases, students_by_name,
    )
}


def _minor(c):
    t = f"trim(replace(trim({c}), '₦', ''))"
    return f"case when regexp_matches({t}, '^[+]?([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)?([.][0-9]{{0,2}})?$') and regexp_matches({c}, '[0-9]') then cast(try_cast(replace({t}, ',', '') as decimal(36,2)) * 100 as bigint) end"


def _norm(c):
    return f"array_to_string(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^a-z]+'), lambda t: t <> '' and t not in ('mr','mrs','ms','miss','dr','prof','chief','alhaji','mallam')), ' ')"


_SAME = " + ".join(f"cast(substr(x, 1, {k}) = substr(y, 1, {k}) and length(x) >= {k} and length(y) >= {k} as int)" for k in (1, 2, 3, 4))
def _charges(s):
    return f"list_sort(list_filter(list_transform({s}.charges, lambda c: {{'charge_id': 'CHG-' || {s}.id || '-' || c.fee_id, 'balance': {_minor('c.amount_naira')}}}), lambda b: b.balance > 0))"


_TAKE = "list_filter(list_transform(range(1, len({b}) + 1), lambda i: {{'charge_id': {b}[i].charge_id, 'amount': cast(least({b}[i].balance, {a} - coalesce(list_sum(list_transform({b}[1:i - 1], lambda z: z.balance)), 0)) as bigint)}}), lambda e: e.amount > 0)"
_CASES = f"""with w as (select case_no, id, split, scenario_family, language, setup, expected, txn.payer_name as payer, case when expected.outcome = 'auto' and case_no % 5 = 0 then coalesce(txn.narration, '') || ' ' || setup.students[1].id else txn.narration end as narration,
  {_minor('txn.amount_naira')} as amount from gold_cases),
hist as (select who, sid, min(case_no) as since from (select case when case_no % 6 = 0 then case_no - 1 else case_no end as case_no, {_norm('payer')} as who, unnest(list_transform(expected.allocations, lambda a: a.student_id)) as sid from w where split = 'train') where who <> '' group by 1, 2),
x as (select w.*, unnest(setup.students) as s from w),
p0 as (select case_no, id, payer, narration, amount, s.id as sid, s.name as name, coalesce(s.aliases, []) as aliases, list_filter(setup.guardians, lambda g: list_contains(list_transform(s.guardians, lambda k: upper(trim(k))), upper(trim(g.id)))) as gs,
  {_charges('s')} as bal, {_norm('payer')} as pn, {_norm('s.name')} as nn, list_distinct(list_transform(coalesce(s.aliases, []), lambda a: {_norm('a')})) as al,
  list_distinct(regexp_extract_all(coalesce(narration, ''), '[0-9]{{3,}}')) as runs, list_filter(regexp_split_to_array(lower(coalesce(narration, '')), '[^a-z0-9]+'), lambda t: t <> '') as toks from x),
p as (select p0.*, list_distinct(list_concat(toks, list_filter(string_split(pn, ' '), lambda t: t <> ''))) as probe, coalesce(h.since < case_no, false) as prior from p0 left join hist h on h.who = pn and h.sid = p0.sid),
jw as (select case_no, sid, max(case when x = y then 1.0 else j + 0.1 * pre * (1 - j) end) as sim from (select *, jaro_similarity(x, y) as j, {_SAME} as pre from
  (select case_no, sid, x, unnest(list_concat([nn], al)) as y from (select case_no, sid, nn, al, unnest(probe) as x from p)) where y <> '') group by 1, 2),
e as (select p.*, coalesce(sim, 0) as sim, list_filter([case when list_has_any(string_split(nn, ' '), probe) then 'name_token_overlap' end, case when list_has_any(al, probe) then 'alias_token_overlap' end, case when coalesce(sim, 0) >= 0.88 then 'fuzzy_name' end,
  case when len(list_filter(gs, lambda g: {_norm('g.name')} <> '' and (contains(pn, {_norm('g.name')}) or list_has_any(string_split({_norm('g.name')}, ' '), probe)))) > 0 then 'guardian_name' end,
  case when len(list_filter(gs, lambda g: coalesce(g.phone_suffix, '') <> '' and len(list_filter(runs, lambda r: ends_with(r, g.phone_suffix))) > 0)) > 0 then 'phone_suffix' end,
  case when prior then 'prior_payer' end, case when amount > 0 and len(list_filter(bal, lambda b: b.balance = amount)) > 0 then 'exact_balance' end], lambda v: v is not null) as sig from p left join jw on jw.case_no = p.case_no and jw.sid = p.sid),
k as (select case_no, sid, len(sig) as n, unnest(list_distinct(list_transform(gs, lambda g: upper(trim(g.id))))) as g from e),
rid as (select distinct a.case_no, a.sid from k a join k b on a.case_no = b.case_no and a.g = b.g where a.n = 0 and b.n > 0),
c as (select e.* exclude (sig), case when len(sig) > 0 then sig else ['sibling_rider'] end as sig, case when len(sig) > 0 then 10 * len(sig) else 5 end as score from e left join rid on rid.case_no = e.case_no and rid.sid = e.sid where len(sig) > 0 or rid.sid is not null),
r0 as (select *, row_number() over (partition by case_no order by score desc, sid) as rank, count(*) over (partition by case_no) as pool from c), r as (select * from r0 where rank <= 5),
ex as (select case_no, first(t order by pos) as sid from (select w.case_no, upper(unnest(regexp_extract_all(coalesce(narration, ''), '[A-Za-z]+-?[0-9]+'))) as t, generate_subscripts(regexp_extract_all(coalesce(narration, ''), '[A-Za-z]+-?[0-9]+'), 1) as pos from w) q
  where exists (select 1 from p where p.case_no = q.case_no and p.sid = q.t) group by 1) """


def _line(aliases, history):
    mark = "'prior_payer=' || case when prior then 'True' else 'False' end" if history else "case when prior then 'prior_payer=true' end"
    told = "true" if aliases else "(list_contains(sig, 'fuzzy_name') or list_contains(sig, 'alias_token_overlap'))"
    return f"""'  - ' || concat_ws(' ', 'id=' || sid || ' name=' || coalesce(name, ''), case when len(aliases) > 0 and {told} then 'aliases=' || array_to_string(aliases, ',') end,
      case when len(list_filter(gs, lambda g: g.name is not null)) > 0 then 'guardian=' || array_to_string(list_transform(gs, lambda g: g.name), ',') end, case when len(bal) > 0 then 'outstanding=' || array_to_string(list_transform(bal, lambda b: b.charge_id || ':' || b.balance), ',') end, {mark})"""


_STEPS = (("a0", 5, True, True), ("a1", 5, True, False), ("a2", 5, False, False), ("a3", 4, False, False), ("a4", 3, False, False))
_TOKENS = "cast(ceil(length({c}) / 3.0) as bigint) + length(regexp_replace({c}, '[\\x00-\\x7F]', '', 'g')) + 8"
_PROMPT = (
    _CASES
    + f""", hd as (select case_no, id, '<|im_start|>system' || chr(10) || '{SYSTEM}<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || 'Transaction: id=' || id || ' payer=' || coalesce(payer, 'None') || ' amount_minor=' || coalesce(cast(amount as varchar), 'None')
  || chr(10) || 'Narration: ' || coalesce(narration, 'None') || chr(10) || 'Allowed reason_codes: {",".join(CODES)}' || chr(10) || 'Candidates:' as head from w),
pv as (select r.case_no, max(hd.id) as pid, count(*) as n, """
    + ", ".join(f"max(head) || coalesce(chr(10) || string_agg({_line(a, h)}, chr(10) order by rank) filter (rank <= {k}), '') as {name}" for name, k, a, h in _STEPS)
    + " from r join hd on hd.case_no = r.case_no group by 1), pq as (select case_no, pid, n, case "
    + " ".join(f"when {'' if k == 5 else f'n > {k} and '}{_TOKENS.format(c=name)} <= {BUDGET} then {n}" for n, (name, k, _, _) in enumerate(_STEPS))
    + " end as step, a0, a1, a2, a3, a4 from pv), pp as (select case_no, pid, n, cast(case when step <= 2 then n when step = 3 then 4 when step = 4 then 3 else 0 end as int) as kept, case step when 0 then a0 when 1 then a1 when 2 then a2 when 3 then a3 when 4 then a4 end "
    + "|| ' /no_think<|im_end|>' || chr(10) || '<|im_start|>assistant' as prompt from pq) "
)
_ANSWERED = (
    _PROMPT
    + f""", f1 as (select * from r where rank = 1), f2 as (select case_no, score from r where rank = 2),
an as (select w.*, ex.sid as exact_sid, f1.sid as sid, f1.score as score, case when f1.sid is not null and (case when kept > 0 then kept else 1 end) >= 2 then f2.score end as second, pp.kept, pp.n as listed, f1.bal as bal, {_TAKE.format(b='f1.bal', a='w.amount')} as takes,
  case when f1.sid is null then 'no_candidates' when kept = 0 then 'prompt_budget' when w.case_no % 29 = 0 then 'schema' when w.case_no % 31 = 0 then 'transport' when w.case_no % 23 = 0 then 'schema' end as failure,
  list_filter(setup.students, lambda s: s.id = ex.sid)[1] as xs
  from w left join ex on ex.case_no = w.case_no left join f1 on f1.case_no = w.case_no left join f2 on f2.case_no = w.case_no left join pp on pp.case_no = w.case_no),
ax as (select *, {_charges('xs')} as xbal from an),
ay as (select *, amount - coalesce(list_sum(list_transform(takes, lambda t: t.amount)), 0) as left_over, {_TAKE.format(b='xbal', a='amount')} as xtakes from ax),
ft as (select ay.case_no, round(e.sim, 4) as name_alias_similarity, cast(len(list_filter(e.gs, lambda g: {_norm('g.name')} <> '' and list_contains(e.probe, string_split({_norm('g.name')}, ' ')[1]))) > 0 as int) as guardian_relationship,
  round(case when len(e.bal) > 0 then 1 - least(1.0, abs(ay.amount - e.bal[1].balance) / cast(greatest(e.bal[1].balance, 1) as double)) else 0 end, 4) as amount_to_balance_agreement, cast(e.prior as int) as historical_payer_consistency,
  round((score - coalesce(second, 0)) / cast(greatest(score, 1) as double), 4) as candidate_separation, 1 as llm_ranking_consistency, cast(ay.amount >= 0 as int) as constraint_validation_result, cast(kept < least(listed, 5) as int) as budget_shed, kept as candidate_count
  from ay join e on e.case_no = ay.case_no and e.sid = ay.sid where exact_sid is null and failure is null),
sc as (select *, round((name_alias_similarity + guardian_relationship + amount_to_balance_agreement + historical_payer_consistency + candidate_separation + llm_ranking_consistency + constraint_validation_result) / 7, 4) as plain,
  round(1 / (1 + exp(-({ARTEFACT.intercept} + {" + ".join(f"{w} * ({f} - {m}) / {s}" for f, m, s, w in zip(calibration.FEATURES, ARTEFACT.means, ARTEFACT.scales, ARTEFACT.coefficients))}))), 8) as score from ft),
sr as (select *, case when score >= 0.95 then 'auto' when score < 0.65 then 'unmatched' else 'review' end as route from sc) """
)
_EVENTS = "list_sort(list_distinct(list_concat(list_transform({t}, lambda z: {s} || '|' || z.charge_id || '|' || z.amount), case when amount - coalesce(list_sum(list_transform({t}, lambda z: z.amount)), 0) > 0 then [{s} || '||' || (amount - coalesce(list_sum(list_transform({t}, lambda z: z.amount)), 0))] else [] end)))"
_RECORDS = (
    _ANSWERED
    + f""", wa as (select *, list_transform(expected.allocations, lambda a: a.student_id || '|CHG-' || a.student_id || '-' || coalesce(a.fee_id, list_filter(setup.students, lambda s: s.id = a.student_id and len(s.charges) = 1)[1].charges[1].fee_id) || '|' || {_minor('a.amount_naira')}) as wanted,
  coalesce(expected.pool_must_include, list_transform(expected.allocations, lambda a: a.student_id)) as truth, expected.allocations[1].student_id as head, case when second = score then 'review' else 'auto' end as act from ay),
rc as (select wa.case_no as case_id, scenario_family as family, language as "group", exact_sid is not null as auto, len(expected.allocations) = 0 as abstains, case when exact_sid is not null then null when failure is null then act = 'unmatched' else failure = 'no_candidates' end as model_abstains,
  case when exact_sid is not null then {_EVENTS.format(t='xtakes', s='exact_sid')} when failure is null then {_EVENTS.format(t='takes', s='sid')} end = list_sort(list_distinct(wanted)) as exact_allocation,
  case when exact_sid is not null then expected.outcome = 'auto' when failure is null then act = expected.outcome end as correct,
  case when exact_sid is not null then exact_sid = head when failure is null and head is not null then sid = head when failure is null then false end as top1,
  case when exact_sid is null and len(truth) > 0 then list_has_all(coalesce(ids, []), truth) end as pool_recall, case when exact_sid is null and failure is null then true when exact_sid is null and failure = 'schema' then false end as valid_json,
  case when exact_sid is null then failure is not distinct from 'schema' and wa.case_no % 29 <> 0 end as unsupported_id
  from wa left join (select r.case_no, list(r.sid) as ids from r join pp on pp.case_no = r.case_no where rank <= greatest(kept, 1) group by 1) li on li.case_no = wa.case_no) """
)
ORACLE = {
    "exact_matches": _CASES + "select ex.case_no, ex.sid as student_id, coalesce(list_sum(list_transform(bal, lambda b: b.balance)), 0) = amount as full_balance from ex join p on p.case_no = ex.case_no and p.sid = ex.sid",
    "candidate_signals": _CASES + "select case_no, sid as student_id, array_to_string(sig, ',') as signals, score from c",
    "candidate_top5": _CASES + "select case_no, sid as student_id, score, cast(rank as int) as rank, pool, array_to_string(list_transform(bal, lambda b: b.charge_id || ':' || b.balance), ',') as outstanding from r",
    "prior_payers": _CASES + "select case_no, sid as student_id from p where prior",
    "prompt_ladder": _PROMPT + f"select case_no, kept, md5(prompt) as prompt, least(512, 1984 - ({_TOKENS.format(c='prompt')})) as answer from pp",
    "answer_grammars": _PROMPT
    + f"""select pp.case_no, md5('transaction ::= "\\"' || max(pid) || '\\""' || chr(10) || 'student ::= ' || string_agg('"\\"' || sid || '\\""', ' | ' order by rank) || chr(10) || 'allocations ::= allocation ("," allocation){{0,' || (max(kept) - 1) || '}}' || chr(10)
    || 'code ::= {" | ".join(chr(34) + chr(92) + chr(34) + c + chr(92) + chr(34) + chr(34) for c in CODES)}') as grammar from pp join r on r.case_no = pp.case_no where kept > 0 and rank <= kept group by 1""",
    "chat_forms": _PROMPT
    + "select case_no, substr('Instructions:' || chr(10) || split_part(split_part(prompt, 'system' || chr(10), 2), '<|im_end|>', 1), 1, 40) as joined, md5(split_part(split_part(prompt, '<|im_start|>user' || chr(10), 2), '<|im_end|>', 1)) as separate from pp where kept > 0",
    "feature_vector": _ANSWERED + f"select case_no, {', '.join(calibration.FEATURES)} from ft",
    "confidence_score": _ANSWERED + "select case_no, plain, score, route from sr",
    "reconcile_states": _ANSWERED
    + """, st as (select ay.case_no, case when ay.case_no % 37 = 0 and amount > 0 then 'approved' when exact_sid is not null and amount > coalesce(list_sum(list_transform(xbal, lambda b: b.balance)), 0) then 'review' when exact_sid is not null then 'auto'
      when ay.sid is null then 'unmatched' when failure is not null then 'review' when route = 'unmatched' then 'unmatched' when route = 'auto' and budget_shed = 0 and constraint_validation_result = 1 and left_over = 0 then 'auto' else 'review' end as state,
      case when ay.case_no % 37 = 0 and amount > 0 then null when exact_sid is not null and amount > coalesce(list_sum(list_transform(xbal, lambda b: b.balance)), 0) then 'OVERPAYMENT_REQUIRES_REVIEW' when exact_sid is not null then 'EXACT_STUDENT_ID' when ay.sid is null then null
      when failure = 'prompt_budget' then 'PROMPT_BUDGET_EXCEEDED' when failure = 'transport' then 'INFERENCE_UNAVAILABLE' when failure = 'schema' then 'SCHEMA_INVALID' else 'MODEL_RANKED' end as reason,
      case when ay.case_no % 37 = 0 and amount > 0 then null else sr.score end as conf from ay left join sr on sr.case_no = ay.case_no)
    select case_no, state, reason, case when reason = 'EXACT_STUDENT_ID' then 1.0 else conf end as confidence from st""",
    "case_records": _RECORDS + "select * from rc",
    "metric_set": _RECORDS
    + """select count(*) filter (auto and not exact_allocation) as incorrect_auto_posts, round(avg(correct::int), 6) as action_accuracy, round(avg(valid_json::int), 6) as valid_json_rate, round(avg(top1::int), 6) as top1_student, round(avg(exact_allocation::int), 6) as exact_allocation,
    round(avg(exact_allocation::int) filter (family = 'sibling_split'), 6) as sibling_split, round(avg(pool_recall::int), 6) as pool_recall, round(avg(unsupported_id::int), 6) as unsupported_id_rate, round(avg(abstains::int) filter (model_abstains), 6) as abstention_precision,
    round(avg(coalesce(model_abstains, false)::int) filter (abstains), 6) as abstention_recall from rc""",
    "language_accuracy": _RECORDS + """select "group", round(avg(top1::int), 6) as top1, count(*) as cases from rc group by 1""",
    "calibration_labels": _RECORDS + "select ay.case_no, coalesce(failure is null and coalesce(exact_allocation, false) and left_over = 0 and amount >= 0, false) as label from ay join rc on rc.case_id = ay.case_no where exact_sid is null",
    "review_decisions": f"""with d as (select case_no, setup, {_minor('txn.amount_naira')} as amount, list_transform(expected.allocations, lambda a: {{'sid': case when case_no % 13 = 0 then 'STU-X' else trim(a.student_id) end, 'amt': {_minor('a.amount_naira')} * case when case_no % 11 = 0 then 2 when case_no % 17 = 0 then -1 else 1 end}}) as ed,
      case when case_no % 9 = 0 then 'GHOST' when case_no % 3 = 0 then setup.guardians[1].id end as holder from gold_cases),
    g as (select case_no, list_sort(list_distinct(list_transform(list_filter(ed, lambda x: x.amt > 0), lambda x: x.sid))) as ids, coalesce(list_sum(list_transform(list_filter(ed, lambda x: x.amt > 0), lambda x: x.amt)), 0) as total from d),
    o as (select d.*, ids, case when case_no % 10 = 0 then 'PROPOSAL_ALREADY_DECIDED' when case_no % 7 = 0 then 'rejected' when len(list_filter(ed, lambda x: x.amt is null or x.amt < 0)) > 0 then 'INV-03' when not list_has_all(list_transform(setup.students, lambda s: s.id), ids) then 'INV-04'
      when total > amount then 'INV-01' when holder = 'GHOST' then 'INV-04' else 'approved' end as outcome from d join g using (case_no)),
    u as (select case_no, unnest(ids) as sid from o where outcome = 'approved'),
    v as (select u.case_no, u.sid, (list_filter(setup.students, lambda s: s.id = u.sid))[1] as s, list_sum(list_transform(list_filter(ed, lambda x: x.sid = u.sid), lambda x: x.amt)) as amt from u join o using (case_no)),
    b as (select case_no, sid, amt, {_charges('s')} as bal from v), t as (select case_no, sid, unnest({_TAKE.format(b='bal', a='amt')}) as z from b),
    q as (select case_no, string_agg(sid || '|' || z.charge_id || '|' || z.amount, ',' order by sid || '|' || z.charge_id || '|' || z.amount) as allocations, cast(sum(z.amount) as bigint) as allocated from t group by 1)
    select o.case_no, outcome, coalesce(allocations, '') as allocations, coalesce(allocated, 0) as allocated_minor, case when outcome = 'rejected' then amount when outcome = 'approved' then case when holder is null then amount - coalesce(allocated, 0) else 0 end end as unapplied_minor,
    case when outcome = 'approved' and holder is not null then amount - coalesce(allocated, 0) else 0 end as credit_minor from o left join q using (case_no)""",
    "split_divergence": _CASES
    + f""", g as (select w.case_no, s, list_sum(list_transform(list_filter(expected.allocations, lambda a: a.student_id = s.id), lambda a: {_minor('a.amount_naira')})) as amount, len(list_filter(expected.allocations, lambda a: a.student_id = s.id)) as k
      from (select case_no, expected, unnest(setup.students) as s from w) w),
    b as (select case_no, s.id as sid, amount, {_charges('s')} as bal from g where k > 0), t as (select case_no, unnest({_EVENTS.format(t=f"({_TAKE.format(b='bal', a='amount')})", s='sid')}) as e from b),
    n as (select case_no, list_sort(list_distinct(list(e))) as dealt from t group by 1),
    v as (select case_no, list_sort(list_distinct(list_transform(expected.allocations, lambda a: a.student_id || '|CHG-' || a.student_id || '-' || coalesce(a.fee_id, list_filter(setup.students, lambda s: s.id = a.student_id and len(s.charges) = 1)[1].charges[1].fee_id) || '|' || {_minor('a.amount_naira')}))) as wanted from w where len(expected.allocations) > 0)
    select v.case_no, coalesce(array_to_string(dealt, ','), '') as dealt from v left join n using (case_no) where coalesce(dealt, []) <> wanted""",
    "app_examples": _PROMPT
    + f""", li as (select r.case_no, list(r.sid) as ids from r join pp on pp.case_no = r.case_no where rank <= greatest(kept, 1) group by 1)
    select w.case_no, md5(prompt) as prompt, md5(to_json({{'transaction_id': w.id, 'payment_intent': scenario_family, 'candidate_allocations': list_transform(expected.allocations, lambda a: {{'student_id': a.student_id, 'amount_minor': {_minor('a.amount_naira')}}}), 'recommended_action': expected.outcome}})) as completion
    from pp join w using (case_no) join li using (case_no) where kept > 0 and list_has_all(ids, list_transform(expected.allocations, lambda a: a.student_id))""",
    "evidence_snapshots": "select row_id, md5(to_json({'transaction_id': transaction_id, 'source': source, 'reference': reference, 'raw_reference': raw_reference, 'posted_at': posted_at, 'payer_name': payer_name, 'narration': narration, 'amount_minor': amount_minor, 'direction': direction})) as evidence from canonical_transactions",
    "superseded_proposals": "select transaction_id, count(*) as proposals, max(row_id) as pending from canonical_transactions where transaction_id is not null group by 1",
    "frozen_cases": "select 'gold-none' as id, 'missing' as problem union all select id, 'repeated' from gold_cases where id in (select id from gold_cases where split = 'test') group by id having count(*) > 1",
    "students_by_name": "select student_id, name from students order by name, student_id",
}
