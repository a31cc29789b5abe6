"""Queries of the training-data operators, over whole tables and with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import encoding, entity_links, format_duplicates, grouped_split, history, mixing, page_spam, split_overlap
from tallyspark.operators.instants import feed_rules
from tallyspark.session import ensure_checkpoint_dir
from tallyspark.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id_a, row_id_b): first row of a payment and each later row of it."""
    rules = feed_rules(table(spark, folder, "feed_zones"))
    found = history.payments(table(spark, folder, "canonical_transactions"), rules)
    return found.select(F.col("first").alias("row_id_a"), F.col("row_id").alias("row_id_b"))


def p1_increment(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id_a, row_id_b): the rows of the newest batch of rows, a tenth, against the history of all earlier ones, which lies in the
    shared folder with its segment index."""
    rules = feed_rules(table(spark, folder, "feed_zones"))
    rows = table(spark, folder, "canonical_transactions")
    newest = rows.agg(F.max("row_id").alias("n")).first().n or 0
    accepted = history.AcceptedHistory(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}", rules)
    accepted.append(rows.where(F.col("row_id") <= newest * 9 // 10))
    found = accepted.match(rows.where(F.col("row_id") > newest * 9 // 10))
    return found.select(F.col("a").alias("row_id_a"), F.col("b").alias("row_id_b"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id_a, row_id_b): first row of a record and each further copy."""
    rows = table(spark, folder, "bank_statement", "row_id", "reference", "date", "amount", "payer", "narration", "direction")
    return format_duplicates.copies(rows).select(F.col("first").alias("row_id_a"), F.col("copy").alias("row_id_b"))


def p2_records(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, copies): one row per record with its number of copies."""
    rows = table(spark, folder, "bank_statement", "row_id", "reference", "date", "amount", "payer", "narration", "direction")
    return format_duplicates.records(rows).select(F.col("first").alias("row_id"), "copies")


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "gold_cases", "case_no", "split", "provenance", "setup", "txn")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """(case_no_a, case_no_b): pairs of a training and an evaluation case that are the same record."""
    return split_overlap.overlaps(_labelled(spark, folder))


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """(split, provenance, cases, in_train, pairs, covered): overlaps per evaluation split and source."""
    return split_overlap.report(_labelled(spark, folder))


def _matches(spark: SparkSession, folder: str) -> DataFrame:
    return entity_links.matches(
        table(spark, folder, "bank_statement", "row_id", "payer", "narration", "amount"),
        table(spark, folder, "students", "student_id", "name", "class", "aliases"),
        table(spark, folder, "guardians", "guardian_id", "name"),
        table(spark, folder, "student_guardians", "student_id", "guardian_id"),
        table(spark, folder, "fees", "student_id", "fee_id", "term_id", "amount"),
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, student_id): statement rows and the students they pay for."""
    return _matches(spark, folder).select("row_id", "student_id")


def p4_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, student_id, confidence): the same with the label model's posterior."""
    return _matches(spark, folder).select("row_id", "student_id", F.round("confidence", 6).alias("confidence"))


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "gold_cases", "case_no", "scenario_family", "setup", "txn")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """(case_no_a, case_no_b): smallest case of a group that must stay together and each other case of it."""
    found = grouped_split.related(_cases(spark, folder))
    return found.select(F.col("root").alias("case_no_a"), F.col("node").alias("case_no_b"))


def p6_splits(spark: SparkSession, folder: str) -> DataFrame:
    """(case_no, group_case_no, split): every case in its split."""
    cases = _cases(spark, folder)
    out = grouped_split.assign(cases, grouped_split.related(cases))
    return out.select("case_no", F.col("group").alias("group_case_no"), "split")


def p6_deviations(spark: SparkSession, folder: str) -> DataFrame:
    """(label, split, cases, share, target): how close sizes and labels come to the wanted shares."""
    cases = _cases(spark, folder)
    return grouped_split.deviations(grouped_split.assign(cases, grouped_split.related(cases)), cases)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ids): the token ids of every document."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    return docs.select("doc_id", encoding.token_ids(spark, F.col("text")).alias("ids"))


def p8_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, n_ids, same): whether decoding gives the text back."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    encoded = docs.withColumn("ids", encoding.token_ids(spark, F.col("text")))
    back = encoding.texts_of(spark, F.col("ids"))
    return encoded.select("doc_id", F.size("ids").alias("n_ids"), (back == F.coalesce("text", F.lit(""))).alias("same"))


def _mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "source").where("source is not null")
    sized = docs.select("doc_id", "source", encoding.token_counts(spark, F.col("text")).alias("n_tokens"))
    return mixing.mix(sized, table(spark, folder, "mix_targets"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, pass, n_tokens, finish): the mix in the order in which it is to be read."""
    return mixing.in_order(_mix(spark, folder))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """(source, target_share, actual_share, ...): the shares reached."""
    return mixing.report(_mix(spark, folder), table(spark, folder, "mix_targets"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id): pages of repeated keywords, links or tags."""
    return page_spam.spam_pages(table(spark, folder, "documents", "doc_id", "text"))


QUERIES = {
    "p1_found": p1_found,
    "p1_increment": p1_increment,
    "p2_found": p2_found,
    "p2_records": p2_records,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p4_confidence": p4_confidence,
    "p6_found": p6_found,
    "p6_splits": p6_splits,
    "p6_deviations": p6_deviations,
    "p8_ids": p8_ids,
    "p8_roundtrip": p8_roundtrip,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
}
_FORMS = r"""with n as (select row_id, coalesce(date, '') as d, coalesce(amount, '') as a, lower(regexp_replace(coalesce(direction, ''), '[\s\p{Z}]+', '', 'g')) as k,
  lower(regexp_replace(coalesce(reference, ''), '[^\p{L}\p{N}]+', '', 'g')) as r,
  list_sort(list_filter(regexp_split_to_array(lower(coalesce(payer, '') || ' ' || coalesce(narration, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')) as w from bank_statement),
g as (select row_id, min(row_id) over (partition by d, a, k, r, w) as first, count(*) over (partition by d, a, k, r, w) as copies from n) """
ORACLE: dict[str, str] = {
    "p2_found": _FORMS + "select first as row_id_a, row_id as row_id_b from g where row_id <> first",
    "p2_records": _FORMS + "select row_id, copies from g where row_id = first",
    "p6_found": r"""with recursive s as (select case_no, unnest(setup.students) as x from gold_cases), i as (select case_no, unnest(x.guardians) as g from s),
    m as (select distinct case_no, 'g:' || upper(trim(g)) as k from i where trim(g) <> ''
      union select distinct case_no, 'c:' || upper(regexp_replace(unnest(regexp_extract_all(txn.narration, '(?:^|[^\p{L}\p{N}])([A-Za-z]{3}[\s\p{Z}./_-]?[0-9]{4})(?:$|[^\p{L}\p{N}])', 1)), '[^A-Za-z0-9]', '', 'g')) from gold_cases where txn.narration is not null),
    e as (select distinct a.case_no as u, b.case_no as v from m a join m b on a.k = b.k and a.case_no <> b.case_no),
    t as (select u as a, v as b from e union select t.a, e.v from t join e on t.b = e.u)
    select min(b) as case_no_a, a as case_no_b from t group by a having min(b) < a""",
}
