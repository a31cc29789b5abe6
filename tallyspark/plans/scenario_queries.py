"""Scenario cases and generation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import scenarios
from tallyspark.session import ship_package
from tallyspark.tables import table

_TEMPLATES = [("name_match", "school fees for {name}"), ("instalment", "{name} second part"), ("known_payer", "term payment {name}")]
_FIRST, _LAST = ["Ada", "Bayo", "Chidi", "Dayo", "Efe", "Funmi", "Gozie"], ["Abu", "Bello", "Chukwu", "Danjuma", "Eze"]


def _cases(spark, folder):
    return table(spark, folder, "gold_cases", "case_no", "setup", "txn", "expected")


def case_allocations(spark, folder):
    return scenarios.expected_allocations(_cases(spark, folder))


def case_worlds(spark, folder):
    return scenarios.case_charges(_cases(spark, folder)).groupBy("case_no").agg(F.count("*").alias("charges"), F.countDistinct("student_id").alias("students"), F.sum("amount_minor").alias("amount_minor"))


def case_validity(spark, folder):
    return scenarios.invalid_cases(_cases(spark, folder))


def synthetic_cases(spark, folder):
    ship_package(spark)
    return scenarios.synthetic(spark, 2_000, "synth-1", _TEMPLATES, _FIRST, _LAST)


def draft_plan(spark, folder):
    families = table(spark, folder, "gold_cases", "scenario_family").where("scenario_family is not null").select(F.col("scenario_family").alias("family")).distinct()
    return scenarios.draft_plan(families, 10, {"en": 60, "pcm": 30, "yo": 10, "ha": 0}, "plan-1")


def model_choice(spark, folder):
    cases = table(spark, folder, "gold_cases", "case_no", "scenario_family").where("scenario_family is not null")
    score = lambda name, k: cases.groupBy("scenario_family").agg(F.round(100 * F.avg((F.col("case_no") % k != 0).cast("double")), 6).alias("score")).select(F.col("scenario_family").alias("suite"), F.lit(name).alias("model"), "score", F.lit(15.0).alias("speed"))
    return scenarios.model_choice(score("small", 5).unionByName(score("large", 7)))


_MINOR = """case when regexp_matches(trim(replace(trim({c}), '₦', '')), '^[+]?([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)?([.][0-9]{{0,2}})?$') and regexp_matches({c}, '[0-9]') then cast(try_cast(replace(trim(replace(trim({c}), '₦', '')), ',', '') as decimal(36,2)) * 100 as bigint) end"""
_WORLD = f"""with s as (select case_no, unnest(setup.students) as s from gold_cases), k as (select case_no, s.id as student_id, unnest(s.charges) as c from s),
charges as (select case_no, student_id, c.fee_id as fee_id, {_MINOR.format(c='c.amount_naira')} as minor from k),
a as (select case_no, unnest(expected.allocations) as a, unnest(range(len(expected.allocations))) as pos from gold_cases),
one as (select case_no, student_id, min(fee_id) as sole from charges group by 1, 2 having count(*) = 1),
alloc as (select a.case_no, cast(pos as int) as pos, a.a.student_id as student_id, coalesce(a.a.fee_id, sole) as fee_id, {_MINOR.format(c='a.a.amount_naira')} as amount_minor from a left join one on one.case_no = a.case_no and one.student_id = a.a.student_id) """


def _draw(n, part):
    return f"cast(cast('0x' || substr(sha256('synth-1:{part}:' || cast(i as varchar)), 1, 8) as bigint) % {n} as int)"


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


QUERIES = {f.__name__: f for f in (case_allocations, case_worlds, case_validity, synthetic_cases, draft_plan, model_choice)}
ORACLE = {
    "case_allocations": _WORLD + "select * from alloc",
    "case_worlds": _WORLD + "select case_no, count(*) as charges, count(distinct student_id) as students, cast(sum(minor) as bigint) as amount_minor from charges group by case_no",
    "case_validity": _WORLD
    + f""", o as (select case_no, student_id, sum(minor) as owed from charges group by 1, 2), p as (select case_no, student_id, sum(amount_minor) as paid from alloc group by 1, 2),
    x as (select p.case_no, bool_or(owed is null) as unknown, bool_or(paid > owed) as over, sum(paid) as total from p left join o on o.case_no = p.case_no and o.student_id = p.student_id group by 1),
    y as (select x.case_no, concat_ws(',', case when unknown then 'unknown_student' end, case when over then 'overpaid_student' end, case when total > {_MINOR.format(c='txn.amount_naira')} then 'overspent_payment' end) as problems from x join gold_cases g on g.case_no = x.case_no)
    select * from y where problems <> ''""",
    "synthetic_cases": f"""with d as (select i as case_no, {_list(t[0] for t in _TEMPLATES)}[{_draw(3, 'template')} + 1] as family, {_list(t[1] for t in _TEMPLATES)}[{_draw(3, 'template')} + 1] as frame,
      {_list(_FIRST)}[{_draw(7, 'first')} + 1] || ' ' || {_list(_LAST)}[{_draw(5, 'last')} + 1] as name, cast(({_draw(200, 'amount')} + 1) * 50000 as bigint) as amount_minor from range(8000) r(i)),
    t as (select *, replace(frame, '{{name}}', name) as text from d), n as (select *, row_number() over (partition by family, text, amount_minor // 1000000 order by case_no) as nth from t)
    select case_no, family, text, amount_minor from n where nth = 1 order by case_no limit 2000""",
    "draft_plan": """with f as (select distinct scenario_family as family from gold_cases where scenario_family is not null), s as (select family, cast(v as int) as variant from f, range(10) r(v)),
    n as (select *, row_number() over (order by sha256('plan-1:' || family || ':' || cast(variant as varchar))) as n from s) select family, variant, case when n <= 60 then 'en' when n <= 90 then 'pcm' when n <= 100 then 'yo' else 'ha' end as language from n""",
    "model_choice": """with s as (select scenario_family, round(100 * avg(cast(case_no % 5 <> 0 as int)), 6) as small, round(100 * avg(cast(case_no % 7 <> 0 as int)), 6) as large from gold_cases where scenario_family is not null group by 1)
    select case when max(large - small) <= 5 then 'small' else 'large' end as chosen, case when max(large - small) <= 5 then 'within_margin' else 'better' end as reason from s""",
}
