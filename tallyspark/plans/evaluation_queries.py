"""Evaluation measures, set tests and data-set building over the case tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyspark import tables
from tallyspark.functions import text
from tallyspark.functions.text import seeded_hash
from tallyspark.operators import calibration, datasets, evaluation, modelpath
from tallyspark.plans import ingest_queries, ledger_queries
from tallyspark.plans.case_queries import ARTEFACT
from tallyspark.session import ensure_checkpoint_dir
from tallyspark.streaming import imports
from tallyspark.tables import table


def _records(spark, folder):
    """Evaluation records derived from the cases: three-valued flags that depend on the case alone."""
    cases = table(spark, folder, "gold_cases", "case_no", "scenario_family", "language", "difficulty", "expected")
    n = F.size("expected.allocations")
    return cases.select(
        F.col("case_no").alias("case_id"), F.coalesce("language", F.lit("?")).alias("group"),
        F.when(F.col("expected.outcome") == "auto", F.col("case_no") % 7 != 0).alias("correct"),
        F.when(n > 0, (F.col("case_no") % 5) != 0).alias("top1"),
        F.when(F.col("scenario_family") == "sibling_split", n > 1).alias("sibling"),
        F.when(F.col("difficulty") == "hard", F.col("case_no") % 3 == 0).alias("duplicate_blocked"),
        (F.col("expected.outcome") == "auto").alias("auto"),
    )


def metric_card(spark, folder):
    return evaluation.metric_card(_records(spark, folder), "correct", "top1", "sibling")


def gates(spark, folder):
    return evaluation.gates(_records(spark, folder).select(F.coalesce("auto", F.lit(False)).alias("auto"), "correct", "duplicate_blocked"))


def run_diff(spark, folder):
    before = _records(spark, folder)
    after = before.select("case_id", (F.col("correct") & (F.col("case_id") % 11 != 0)).alias("correct"), (F.col("top1") & (F.col("case_id") % 13 != 0)).alias("top1"))
    return evaluation.run_diff(before, after, "correct", "top1")


def rubric_scores(spark, folder):
    cases = table(spark, folder, "gold_cases", "case_no")
    scores = cases.select(F.col("case_no").alias("review_id"), (F.col("case_no") % 9).alias("points"))
    key = cases.select(F.col("case_no").alias("review_id"), F.when(F.col("case_no") % 2 == 0, "small").otherwise("large").alias("model"))
    return evaluation.rubric(scores, key, 8)


def coverage(spark, folder):
    cases = table(spark, folder, "gold_cases", "split", "scenario_family", "language")
    return cases.rollup("split", "scenario_family", "language").agg(F.count("*").alias("cases"), F.grouping_id().cast("int").alias("level"))


def missing_families(spark, folder):
    cases = table(spark, folder, "gold_cases", "split", "scenario_family").where("scenario_family is not null")
    every = cases.select("scenario_family").distinct().crossJoin(F.broadcast(table(spark, folder, "gold_cases", "split").distinct()))
    wanted = every.unionByName(every.select(F.concat("scenario_family", F.lit("_hard")).alias("scenario_family"), "split"))
    return wanted.select("split", "scenario_family").exceptAll(cases.select("split", "scenario_family").distinct())


def pool_sets(spark, folder):
    cases = table(spark, folder, "gold_cases", "case_no", "setup", "expected")
    pool = F.array_distinct(F.transform("setup.students", lambda s: s["id"]))
    truth = F.array_distinct(F.transform("expected.allocations", lambda a: a["student_id"]))
    listed = F.coalesce("expected.pool_must_include", F.array().cast("array<string>"))
    return cases.select(
        "case_no", (F.size(F.array_except(truth, pool)) == 0).alias("truth_in_pool"), (F.array_sort(truth) == F.array_sort(F.array_distinct(listed))).alias("same_as_listed"),
        F.size(F.array_union(pool, listed)).alias("allowed"), F.arrays_overlap(pool, listed).alias("overlap"),
    )


def standardise(spark, folder):
    rows = table(spark, folder, "lineitem", "l_quantity", "l_discount", "l_tax")
    out = evaluation.standardisation(rows, "l_quantity", "l_discount", "l_tax")
    return out.select("feature", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


def _scored(spark, folder):
    rows = table(spark, folder, "events", "event_id", "value", "event_type")
    z = (F.col("value") - 50) / 25
    from tallyspark.functions.text import sigmoid

    return rows.select("event_id", F.round(sigmoid(z), 8).alias("score"), (F.col("event_type") == "purchase").alias("label"))


def confidence_routes(spark, folder):
    return _scored(spark, folder).select("event_id", "score", evaluation.route(F.col("score"), 0.9).alias("state"))


def threshold_report(spark, folder):
    """The least threshold that no negative passes: the next number above the worst one, 0.9 at least."""
    scored = _scored(spark, folder)
    counts = scored.agg(F.count_if("label").alias("positives"), F.count_if(~F.col("label")).alias("negatives"))
    value, enabled = evaluation.threshold(scored)
    return counts.select("positives", "negatives", F.lit(value).alias("threshold"), F.lit(enabled).alias("enabled"), F.lit(value > 0.9).alias("above_floor"))


def logistic_fit(spark, folder):
    rows = table(spark, folder, "lineitem", "l_quantity", "l_discount", "l_tax", "l_returnflag").select((F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("d"), (F.col("l_tax") * 10).alias("t"), (F.col("l_returnflag") == "R").alias("label"))
    bias, weights = evaluation.fit_logistic(rows, ["q", "d", "t"], "label")
    return spark.createDataFrame([("bias", float(bias)), *zip(("q", "d", "t"), map(float, weights))], "name string, weight double")


def _signed(spark, folder):
    cases = table(spark, folder, "gold_cases", "case_no", "scenario_family", "txn", "setup")
    return cases.select("case_no", F.col("scenario_family").alias("family"), F.col("txn.narration").alias("text"), F.col("txn.amount_naira").alias("amount"), F.transform("setup.students", lambda s: s["name"]).alias("names"))


def case_signatures(spark, folder):
    return datasets.signatures(_signed(spark, folder)).select("case_no", F.md5("signature").alias("signature"))


def signature_groups(spark, folder):
    return datasets.signatures(_signed(spark, folder)).groupBy("signature").agg(F.count("*").alias("cases"), F.min("case_no").alias("first")).where("cases > 1").select("first", "cases")


def _families(spark, folder):
    """Families of cases: the same guardian family, template family or signature, directly or through others."""
    labels = table(spark, folder, "gold_cases", "case_no", "guardian_family", "template_family")
    signed = datasets.signatures(_signed(spark, folder)).select("case_no", F.md5("signature").alias("signature"))
    return datasets.families(labels.join(signed, "case_no"), "guardian_family", "template_family", "signature")


def case_families(spark, folder):
    return _families(spark, folder)


def guardian_families(spark, folder):
    """The same by guardian families and signatures alone, which leaves more and smaller families."""
    labels = table(spark, folder, "gold_cases", "case_no", "guardian_family")
    signed = datasets.signatures(_signed(spark, folder)).select("case_no", F.md5("signature").alias("signature"))
    return datasets.families(labels.join(signed, "case_no"), "guardian_family", "signature")


def split_assignment(spark, folder):
    """(case_no, family, split, problem): authored families dealt to the splits, synthetic ones to training; families whose first case is
    authored and divisible by 29 are pinned to the test split as a whole."""
    cases = table(spark, folder, "gold_cases", "case_no", "provenance")
    members = guardian_families(spark, folder).join(cases, "case_no")
    return datasets.component_split(members.withColumn("pinned", F.when(F.col("family") % 29 == 0, "test")), "split-1")


def split_leaks(spark, folder):
    """(family, splits) of families that the authored splits tear apart."""
    return datasets.leaks(guardian_families(spark, folder).join(table(spark, folder, "gold_cases", "case_no", "split"), "case_no"))


def fit_parts(spark, folder):
    """(case_no, part): the first two thirds of the cases by number for the fit."""
    return datasets.fit_and_threshold(table(spark, folder, "gold_cases", "case_no"), "case_no")


def owned_mixture(spark, folder):
    """General examples beside two rendered rows of each training case, a fifth of the whole."""
    rendered = 2 * table(spark, folder, "gold_cases", "split").where("split = 'train'").count()
    owned, _ = datasets.mixture_counts(rendered, 0.2)
    tasks = [("summary", "Sum up: {topic} ({no})", "{topic} in brief"), ("letter", "Write about {topic}, no. {no}", "Dear all, {topic}"), ("plan", "Plan {topic} {no}", "First {topic}"), ("risk", "Risks of {topic} {no}", "Check {topic}")]
    return datasets.owned_examples(spark, owned, "owned-1", tasks, ["a late bus", "a new desk", "an audit", "a lost key", "a broken printer"])


def chat_pairs(spark, folder):
    """(message_id, question, answer): English documents as messages, each third answers the one before."""
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    n = F.col("doc_id")
    messages = docs.select(
        n.alias("row_no"), n.cast("string").alias("message_id"), (n - 1).cast("string").alias("parent_id"), F.when(n % 3 == 0, "assistant").otherwise("prompter").alias("role"), "lang", "text", (n % 2).cast("int").alias("rank"),
        F.when(n % 7 == 0, F.lit(True)).alias("deleted"),
    )
    return datasets.answer_pairs(messages).select("message_id", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


def blind_packet(spark, folder):
    return evaluation.blind_packet(table(spark, folder, "gold_cases", "case_no").withColumnRenamed("case_no", "output_id"), "blind-1")


def side_by_side(spark, folder):
    one = _records(spark, folder)
    other = one.where("case_id % 3 <> 0").withColumn("top1", F.col("correct"))
    return evaluation.side_by_side(one, other, "correct", "top1")


def stress_summary(spark, folder):
    n = F.col("case_no")
    rows = table(spark, folder, "gold_cases", "case_no").select((n % 401 != 0).alias("valid_json"), (n % 503 == 0).alias("unsupported_id"), F.lit(False).alias("thinking_leak"), (n % 997 == 0).alias("transport"), F.lit(None).cast("boolean").alias("wrong_auto"))
    return evaluation.stress_summary(rows)


def _measures(spark, folder):
    """One row of rates of two runs over the cases."""
    n = F.col("case_no")
    rate = lambda keep: F.round(F.avg(keep.cast("double")), 6)
    return table(spark, folder, "gold_cases", "case_no").agg(
        rate(n % 3 != 0).alias("zero_gold"), rate(n % 4 != 0).alias("gold"), rate(n % 9 != 0).alias("zero_proxy"), rate(n % 7 != 0).alias("proxy"), F.lit(71.0).alias("zero_bare"), F.lit(70.0).alias("bare"), rate(n % 4 != 1).alias("merged_gold"),
        rate(n % 401 != 0).alias("valid_json_rate"), F.count_if(n % 503 == 502).alias("unsupported_ids"), F.lit(0).alias("thinking_leaks"), F.lit(0).alias("wrong_auto"), F.lit(True).alias("stress_passed"), F.lit(0).alias("gates_failed"),
    )


def release_decision(spark, folder):
    return evaluation.release_decision(_measures(spark, folder)).crossJoin(_measures(spark, folder).select(evaluation.regression_points(F.col("zero_proxy"), F.col("proxy")).alias("points")))  # one row each


def authored_problems(spark, folder):
    cases = table(spark, folder, "gold_cases", "language", "scenario_family", "expected").select("language", F.col("scenario_family").alias("family"), (F.size("expected.allocations") == 0).alias("abstains"))
    return evaluation.authored_problems(cases, 140, {"en": 77, "pcm": 39, "yo": 24}, 42, 11)


def verify_artifact(spark, folder):
    """(case_no): cases whose made-up features a fixed artefact would post although they are labelled false."""
    n = F.col("case_no")
    rows = table(spark, folder, "gold_cases", "case_no").select("case_no", (n % 5 != 0).alias("label"), F.lit(1).alias("features_version"), *(((n * (k + 3)) % 11 / 5).alias(f) for k, f in enumerate(calibration.FEATURES)))
    return calibration.wrong_automatic(rows, ARTEFACT).select("case_no", "score")


def choice_scoring(spark, folder):
    """(source, right, texts): documents whose first letter A to D that stands alone is the one their number asks for."""
    docs = table(spark, folder, "documents", "doc_id", "text", "source").where("source is not null")
    wanted = text.choice_label((F.col("doc_id") % 4).cast("string"))
    return docs.groupBy("source").agg(F.count_if(text.choice_letter(F.coalesce("text", F.lit(""))) == wanted).alias("right"), F.count("*").alias("texts"))


def chat_examples(spark, folder):
    """(case_no, prompt, completion): digests of the cases as questions and answers in plain words."""
    cases = table(spark, folder, "gold_cases", "case_no", "setup", "txn", "expected")
    return datasets.chat_examples(cases).select("case_no", F.md5("prompt").alias("prompt"), F.md5("completion").alias("completion"))


def leakage(spark, folder):
    cases = table(spark, folder, "gold_cases", "case_no", "split", "guardian_family")
    return datasets.leaks(cases.where("guardian_family is not null").select(F.col("guardian_family").alias("family"), "split"))


def seeded_order(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    return datasets.first_of_digest(docs, "text", "doc_id", "general-1").select("doc_id", F.substring(seeded_hash("general-1", F.col("doc_id")), 1, 12).alias("h"))


def seeded_top_per_source(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "source").where("source is not null")
    return datasets.top_per_group(docs, "source", "doc_id", "proxy-1", 50)


def prompt_budget(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    t = F.coalesce("text", F.lit(""))
    chosen = modelpath.within_budget([F.concat(t, F.lit(" "), t), t, F.substring_index(t, ".", 3)], 120)
    return docs.select("doc_id", F.md5(chosen).alias("chosen"), modelpath.answer_budget(t).alias("answer"))


def output_schema_check(spark, folder):
    cases = table(spark, folder, "gold_cases", "case_no", "id", "expected", "setup")
    lines = F.transform("expected.allocations", lambda a: F.struct(F.when(F.col("case_no") % 17 == 0, F.lit("NOBODY")).otherwise(a["student_id"]).alias("student_id"), F.when(F.col("case_no") % 19 == 0, F.lit("12.5")).otherwise(F.lit("500")).alias("amount_minor"), F.array(F.lit("NAME_MATCH")).alias("reason_codes")))
    raw = F.to_json(F.struct(F.when(F.col("case_no") % 23 == 0, F.lit("other")).otherwise(F.col("id")).alias("transaction_id"), F.when(F.col("case_no") % 29 == 0, F.lit("guess")).otherwise(F.lit("propose")).alias("recommended_action"), F.lit("ok").alias("explanation"), lines.alias("candidate_allocations")))
    raw = F.when(F.col("case_no") % 31 == 0, F.lit("{not json")).otherwise(raw)
    problem = modelpath.output_problem(raw, F.col("id"), F.transform("setup.students", lambda s: s["id"]), ("NAME_MATCH",), ("propose", "abstain"))
    return cases.select("case_no", problem.alias("problem")).where("problem is not null").groupBy("problem").agg(F.count("*").alias("cases"))


def _place(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_import(spark, folder):
    """The statement file as a stream; each dedup hash once, as in the batch import."""
    schema = table(spark, folder, "bank_statement").schema
    rows = spark.readStream.schema(schema).parquet(f"{folder}/bank_statement*.parquet").withColumnsRenamed({"batch_id": "file", "row_id": "row_no"})
    place = _place(spark)
    imports.import_stream(rows, place)
    return spark.read.parquet(f"{place}/accepted").select("dedup_hash", "amount_minor")


def stream_balances(spark, folder):
    """(student_id, owed, events): the ledger as a stream with state per student; reversals take back what they name."""
    log = tables.ledger(spark, folder).where("student_id is not null")
    place = _place(spark)
    log.write.parquet(f"{place}/log")
    imports.student_stream(spark.readStream.schema(log.schema).parquet(f"{place}/log"), place)
    last = spark.read.parquet(f"{place}/balances")
    return last.groupBy("student_id").agg(F.max_by("owed", "events").alias("owed"), F.max("events").alias("events"))


QUERIES = {
    f.__name__: f
    for f in (
        metric_card, gates, run_diff, rubric_scores, coverage, missing_families, pool_sets, standardise, confidence_routes, threshold_report, logistic_fit, case_signatures, signature_groups,
        case_families, guardian_families, split_assignment, split_leaks, fit_parts, owned_mixture, chat_pairs, blind_packet, side_by_side, stress_summary, release_decision, authored_problems, verify_artifact,
        choice_scoring, chat_examples, stream_balances, leakage, seeded_order, seeded_top_per_source, prompt_budget, output_schema_check, stream_import,
    )
}
_REC = """with rec as (select case_no as case_id, coalesce(language, '?') as "group", case when expected.outcome = 'auto' then case_no % 7 <> 0 end as correct, case when len(expected.allocations) > 0 then case_no % 5 <> 0 end as top1,
  case when scenario_family = 'sibling_split' then len(expected.allocations) > 1 end as sibling, case when difficulty = 'hard' then case_no % 3 = 0 end as duplicate_blocked, expected.outcome = 'auto' as auto from gold_cases) """
_MINOR = """case when regexp_matches(trim(replace(trim({c}), '₦', '')), '^[+]?([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)?([.][0-9]{{0,2}})?$') and regexp_matches({c}, '[0-9]') then cast(try_cast(replace(trim(replace(trim({c}), '₦', '')), ',', '') as decimal(36,2)) * 100 as bigint) end"""
_PERSON = "array_to_string(list_filter(regexp_split_to_array(lower(coalesce(s.name, '')), '[^a-z]+'), lambda t: t <> '' and t not in ('mr','mrs','ms','miss','dr','prof','chief','alhaji','mallam')), ' ')"
_SIG = f"""with recursive sig as (select case_no, array_to_string([coalesce(scenario_family, ''), array_to_string(list_sort(list_filter(regexp_split_to_array(lower(coalesce(txn.narration, '')), '[^a-z0-9]+'), lambda t: t <> '')), ' '),
  case when regexp_full_match(trim(coalesce(txn.amount_naira, '')), '[0-9]+') then cast(cast(trim(txn.amount_naira) as bigint) // 10000 as varchar) else '0' end, array_to_string(list_sort(list_transform(setup.students, lambda s: {_PERSON})), ' ')], '|') as signature from gold_cases) """


def _family_sql(*keys):
    parts = " union all ".join(f"select case_no, '{k}:' || {'md5(signature)' if k == 'signature' else k} as k from {'sig' if k == 'signature' else 'gold_cases'}" for k in keys)
    return _SIG + f""", m as (select distinct case_no, k from ({parts}) where k is not null), lead as (select k, min(case_no) as u from m group by 1), e0 as (select distinct m.case_no as a, lead.u as b from m join lead using (k)),
    e as (select a, b from e0 union select b, a from e0), t as (select a, b from e union select t.a, e.b from t join e on e.a = t.b), fam as (select a as case_no, least(a, min(b)) as family from t group by a) """


_SPLIT = _family_sql("guardian_family", "signature") + """, mem as (select case_no, family, provenance, case when family % 29 = 0 then 'test' end as pin from fam join gold_cases using (case_no)),
    comp as (select family, count(*) as size, count(*) filter (provenance = 'team_authored') as authored, coalesce(bool_or(provenance = 'synthetic'), false) as syn, min(pin) as pin from mem group by 1),
    tot as (select count(*) as n from gold_cases where provenance = 'team_authored'),
    free as (select *, row_number() over (order by size desc, family) as i, row_number() over (partition by size order by family) as r from comp where pin is null and not syn),
    steps as (select cast(0 as bigint) as i, cast(0 as bigint) as sz, '' as pick, 0.0::double as c1, 0.0::double as c2, cast(coalesce((select sum(authored) from comp where pin = 'test'), 0) as double) as c3
      union all select s.i + 1, f.size, p.pick, s.c1 + case when p.pick = 'train' then f.size else 0 end, s.c2 + case when p.pick = 'val' then f.size else 0 end, s.c3 + case when p.pick = 'test' then f.size else 0 end
      from steps s join free f on f.i = s.i + 1 cross join tot cross join lateral (select [x.s for x in list_sort([{'d': s.c1 - 0.7 * tot.n, 'h': sha256('split-1:train:' || f.size), 's': 'train'}, {'d': s.c2 - 0.15 * tot.n, 'h': sha256('split-1:val:' || f.size), 's': 'val'},
        {'d': s.c3 - 0.15 * tot.n, 'h': sha256('split-1:test:' || f.size), 's': 'test'}])][1] as pick) p),
    cnt as (select sz, count(*) filter (pick = 'train') as a, count(*) filter (pick = 'val') as b from steps where i > 0 group by 1),
    dealt as (select family, case when r <= a then 'train' when r <= a + b then 'val' else 'test' end as split from free join cnt on sz = size union all select family, coalesce(pin, 'train') from comp where pin is not null or syn) """
ORACLE = {
    "metric_card": _REC
    + """select "group", count(*) as cases, round(avg(cast(correct as int)), 6) as correct, round(avg(cast(top1 as int)), 6) as top1, round(avg(cast(sibling as int)), 6) as sibling from rec group by rollup ("group")""",
    "gates": _REC
    + """, g as (select count(*) filter (auto and not coalesce(correct, true)) as wrong_auto, round(avg(cast(duplicate_blocked as int)), 6) as blocked_rate, count(*) filter (auto) as autos, count(duplicate_blocked) as dups from rec)
    select wrong_auto, blocked_rate, concat_ws(',', case when wrong_auto > 0 then 'wrong_auto' end, case when blocked_rate < 1 then 'duplicate_blocked' end) as failed, concat_ws(',', case when autos = 0 then 'wrong_auto' end, case when dups = 0 then 'duplicate_blocked' end) as untried from g""",
    "run_diff": _REC + "select case_id, 'correct' as flag from rec where correct and case_id % 11 = 0 union all select case_id, 'top1' from rec where top1 and case_id % 13 = 0",
    "rubric_scores": "select case when case_no % 2 = 0 then 'small' else 'large' end as model, round(100.0 * sum(case_no % 9) / (count(*) * 8), 4) as percent from gold_cases group by 1",
    "coverage": "select split, scenario_family, language, count(*) as cases, cast(grouping_id(split, scenario_family, language) as int) as level from gold_cases group by rollup (split, scenario_family, language)",
    "missing_families": "with f as (select distinct scenario_family from gold_cases where scenario_family is not null), s as (select distinct split from gold_cases), w as (select split, scenario_family from f, s union all select split, scenario_family || '_hard' from f, s) select * from w except select split, scenario_family from gold_cases",
    "pool_sets": """with p as (select case_no, list_distinct(list_transform(setup.students, lambda s: s.id)) as pool, list_distinct(list_transform(expected.allocations, lambda a: a.student_id)) as truth, coalesce(expected.pool_must_include, []) as listed from gold_cases)
    select case_no, list_has_all(pool, truth) as truth_in_pool, list_sort(truth) = list_sort(list_distinct(listed)) as same_as_listed, cast(len(list_distinct(list_concat(pool, listed))) as int) as allowed, list_has_any(pool, listed) as overlap from p""",
    "standardise": "select 'l_quantity' as feature, round(avg(l_quantity), 6) as mean, round(stddev_pop(l_quantity), 6) as deviation from lineitem union all select 'l_discount', round(avg(l_discount), 6), round(stddev_pop(l_discount), 6) from lineitem union all select 'l_tax', round(avg(l_tax), 6), round(stddev_pop(l_tax), 6) from lineitem",
    "confidence_routes": "with s as (select event_id, round(1 / (1 + exp(-(value - 50) / 25)), 8) as score from events) select event_id, score, case when score >= 0.9 then 'auto' when score < 0.65 then 'unmatched' else 'review' end as state from s",
    "threshold_report": "with s as (select round(1 / (1 + exp(-(value - 50) / 25)), 8) as score, event_type = 'purchase' as label from events), w as (select count(*) filter (label) as positives, count(*) filter (not label) as negatives, greatest(0.9, nextafter(max(score) filter (not label), 'infinity'::double)) as threshold from s) select *, threshold <= 1 as enabled, threshold > 0.9 as above_floor from w",
    "case_families": _family_sql("guardian_family", "template_family", "signature") + "select case_no, family from fam",
    "guardian_families": _family_sql("guardian_family", "signature") + "select case_no, family from fam",
    "split_assignment": _SPLIT + "select mem.case_no, mem.family, split, case when comp.pin is not null and syn then 'polluted' end as problem from mem join dealt using (family) join comp using (family)",
    "split_leaks": _family_sql("guardian_family", "signature") + "select family, count(distinct split) as splits from fam join gold_cases using (case_no) group by 1 having count(distinct split) > 1",
    "fit_parts": "select case_no, case when row_number() over (order by case_no) <= cast(floor(n * 2 / 3.0) as bigint) then 'fit' else 'threshold' end as part from gold_cases, (select count(*) as n from gold_cases)",
    "owned_mixture": """with n as (select cast(ceil(round_even(2 * count(*) * 0.2::double / 0.8::double, 0) / 2) as bigint) as n from gold_cases where split = 'train'), r as (select unnest(range((select n from n))) as i),
    t as (select i, lpad(cast(i as varchar), 5, '0') as no, i % 4 + 1 as k, ['a late bus', 'a new desk', 'an audit', 'a lost key', 'a broken printer'][(i + cast('0x' || substr(sha256('owned-1:' || i), 1, 8) as bigint)) % 5 + 1] as topic from r)
    select 'owned-' || ['summary', 'letter', 'plan', 'risk'][k] || '-' || no as id, ['summary', 'letter', 'plan', 'risk'][k] as category,
    replace(replace(['Sum up: {topic} ({no})', 'Write about {topic}, no. {no}', 'Plan {topic} {no}', 'Risks of {topic} {no}'][k], '{topic}', topic), '{no}', no) as prompt, replace(['{topic} in brief', 'Dear all, {topic}', 'First {topic}', 'Check {topic}'][k], '{topic}', topic) as completion from t""",
    "chat_pairs": """with m as (select doc_id as n, lang, trim(coalesce(text, '')) as t from documents where doc_id % 7 <> 0)
    select cast(a.n as varchar) as message_id, md5(q.t) as question, md5(a.t) as answer from m a join m q on q.n = a.n - 1 where a.n % 3 = 0 and q.n % 3 <> 0 and a.n % 2 = 0 and a.lang = 'en' and q.lang = 'en' and length(a.t) between 20 and 2000 and length(q.t) between 20 and 1500""",
    "blind_packet": "with h as (select case_no as output_id, row_number() over (order by sha256('blind-1:' || case_no)) as n from gold_cases) select 'blind-' || case when n < 10000 then lpad(cast(n as varchar), 4, '0') else cast(n as varchar) end as review_id, output_id from h",
    "side_by_side": _REC + "select case_id, correct as a_correct, top1 as a_top1, correct as b_correct, correct as b_top1 from rec where case_id % 3 <> 0",
    "stress_summary": """with c as (select count(*) as inputs, count(*) filter (case_no % 401 <> 0) as valid_json, count(*) filter (case_no % 503 = 0) as unsupported_id, cast(0 as bigint) as thinking_leak, count(*) filter (case_no % 997 = 0) as transport, cast(0 as bigint) as wrong_auto from gold_cases)
    select *, round(valid_json / inputs, 6) as valid_rate, valid_json / inputs >= 0.995 and unsupported_id + transport = 0 as passes from c""",
    "release_decision": """with m as (select round(avg((case_no % 3 <> 0)::int), 6) as zg, round(avg((case_no % 4 <> 0)::int), 6) as g, round(avg((case_no % 9 <> 0)::int), 6) as zp, round(avg((case_no % 7 <> 0)::int), 6) as p, round(avg((case_no % 4 <> 1)::int), 6) as mg,
      round(avg((case_no % 401 <> 0)::int), 6) as vj, count(*) filter (case_no % 503 = 502) as ui from gold_cases),
    f as (select *, concat_ws(',', case when not g > zg then 'gold_improved' end, case when not 100 * (zp - p) <= 2 then 'enterprise_regression' end, case when not vj >= 0.995 then 'valid_json' end, case when ui <> 0 then 'unsupported_ids' end, case when not 100 * (mg - g) <= 3 then 'merged_loss' end) as failed from m)
    select case when 100 * (mg - g) > 3 then 'finer_quantisation' when failed = '' then 'fine_tuned' else 'zero_shot' end as ship, 100 * (zp - p) > 2 as retry, failed, round(100 * (zp - p), 6) as points from f""",
    "authored_problems": """with c as (select language, scenario_family, len(expected.allocations) = 0 as a from gold_cases),
    r as (select 'total' as rule, cast(140 as bigint) as expected, count(*) as found from c union all select 'abstentions', 42, count(*) filter (a) from c union all select 'language ' || l, e, (select count(*) from c where language = l) from (values ('en', 77), ('pcm', 39), ('yo', 24)) v(l, e)
      union all select 'family ' || scenario_family, 11, count(*) from c where scenario_family is not null group by scenario_family) select * from r where expected <> found""",
    "verify_artifact": "with f as (select case_no, "
    + " + ".join(f"{w} * (((case_no * {k + 3}) % 11 / 5.0) - {m}) / {d}" for k, (m, d, w) in enumerate(zip(ARTEFACT.means, ARTEFACT.scales, ARTEFACT.coefficients)))
    + f" + {ARTEFACT.intercept} as z from gold_cases where case_no % 5 = 0) select case_no, round(1 / (1 + exp(-z)), 8) as score from f where round(1 / (1 + exp(-z)), 8) >= 0.95",
    "choice_scoring": r"""select source, count(*) filter (regexp_extract(upper(coalesce(text, '')), '(?:^|[^\p{L}\p{N}_])([ABCD])(?:$|[^\p{L}\p{N}_])', 1) = ['A', 'B', 'C', 'D'][doc_id % 4 + 1]) as right, count(*) as texts from documents where source is not null group by 1""",
    "chat_examples": """with l as (select case_no, txn, expected, list_transform(setup.students, lambda s: '- ' || s.id || ' ' || coalesce(s.name, '') || case when len(coalesce(s.aliases, [])) > 0 then ' (aka ' || array_to_string(s.aliases, ', ') || ')' else '' end || ': ' || array_to_string(list_transform(s.charges, lambda c: c.fee_id || ' ' || c.amount_naira), ', ')) as ls from gold_cases where expected.outcome <> 'duplicate_blocked')
    select case_no, md5('A bank transfer of NGN ' || coalesce(txn.amount_naira, '') || ' arrived (payer: ' || coalesce(txn.payer_name, '') || ', narration: "' || coalesce(txn.narration, '') || '").' || chr(10) || 'Students and balances:' || chr(10) || array_to_string(ls, chr(10)) || chr(10) || 'Who is it for, and how is it divided? Say so if it needs review.') as prompt,
    md5(coalesce(expected.rationale, '') || ' Recommended action: ' || expected.outcome || '.') as completion from l""",
    "stream_import": ingest_queries._OUTCOMES + "select dedup_hash, amount_minor from outcomes where outcome in ('accepted', 'near_duplicate')",
    "stream_balances": ledger_queries._WITH + """select student_id, cast(sum(case event_type when 'charge_created' then amount_minor when 'allocation' then -amount_minor else 0 end) as bigint) as owed, any_value(n) as events from live join (select student_id, count(*) as n from ledger where student_id is not null group by 1) using (student_id) where student_id is not null group by 1""",
    "case_signatures": _SIG + "select case_no, md5(signature) as signature from sig",
    "signature_groups": _SIG + "select min(case_no) as first, count(*) as cases from sig group by signature having count(*) > 1",
    "leakage": "select guardian_family as family, count(distinct split) as splits from gold_cases where guardian_family is not null group by 1 having count(distinct split) > 1",
    "seeded_order": r"""with d as (select doc_id, sha256('general-1:' || cast(doc_id as varchar)) as h, row_number() over (partition by sha256(trim(regexp_replace(lower(coalesce(text, '')), '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g'))) order by sha256('general-1:' || cast(doc_id as varchar))) as n from documents)
    select doc_id, substr(h, 1, 12) as h from d where n = 1""",
    "seeded_top_per_source": "with r as (select doc_id, source, cast(row_number() over (partition by source order by sha256('proxy-1:' || cast(doc_id as varchar))) as int) as rank from documents where source is not null) select * from r where rank <= 50",
    "prompt_budget": r"""with t as (select doc_id, coalesce(text, '') as t from documents), v as (select doc_id, t, t || ' ' || t as a, array_to_string(list_slice(string_split(t, '.'), 1, 3), '.') as c from t),
    e as (select *, cast(ceil(length(a) / 3.0) as bigint) + length(regexp_replace(a, '[\x00-\x7F]', '', 'g')) + 8 as ea, cast(ceil(length(t) / 3.0) as bigint) + length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) + 8 as et, cast(ceil(length(c) / 3.0) as bigint) + length(regexp_replace(c, '[\x00-\x7F]', '', 'g')) + 8 as ec from v)
    select doc_id, md5(case when ea <= 120 then a when et <= 120 then t when ec <= 120 then c end) as chosen, least(512, 1984 - et) as answer from e""",
    "output_schema_check": """with p as (select case when case_no % 31 = 0 then 'invalid_json' when case_no % 23 = 0 then 'transaction_id_mismatch' when case_no % 29 = 0 then 'bad_action'
      when len(expected.allocations) > 0 and (case_no % 17 = 0 or not list_has_all(list_transform(setup.students, lambda s: s.id), list_transform(expected.allocations, lambda a: a.student_id))) then 'unknown_student_id'
      when len(expected.allocations) > 0 and case_no % 19 = 0 then 'bad_amount' end as problem from gold_cases) select problem, count(*) as cases from p where problem is not null group by problem""",
}
