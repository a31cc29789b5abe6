"""Text functions, imports and joins over the domain tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import money, similarity, text
from tallyspark.operators import ingest, relations
from tallyspark.tables import table


def money_parse(spark, folder):
    rows = table(spark, folder, "bank_statement", "row_id", "amount")
    m = money.parse_money(F.col("amount"))
    return rows.select("row_id", m.alias("minor"), money.format_money(m).alias("shown"), money.format_money_plain(m).alias("plain"))


def name_normalise(spark, folder):
    parts = [table(spark, folder, t, k, "name").select(F.col(k).alias("id"), text.normalize_name(F.col("name")).alias("normalized")) for t, k in (("students", "student_id"), ("guardians", "guardian_id"))]
    return parts[0].unionByName(parts[1])


def reference_canonical(spark, folder):
    rows = table(spark, folder, "bank_statement", "row_id", "reference")
    return rows.select("row_id", text.canonical_reference(F.col("reference")).alias("canonical"))


def token_lists(spark, folder):
    rows = table(spark, folder, "bank_statement", "row_id", "narration")
    t = text.tokens(F.col("narration"))
    return rows.select("row_id", F.array_join(t, " ").alias("words"), F.size(t).alias("n"), F.array_join(text.identifier_tokens(F.col("narration")), " ").alias("identifiers"), F.array_join(text.digit_runs(F.col("narration")), " ").alias("runs"))


def alias_lists(spark, folder):
    rows = table(spark, folder, "students", "student_id", "aliases")
    return rows.select("student_id", F.array_join(text.alias_list(F.col("aliases")), "|").alias("aliases"))


def text_measures(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    t = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", text.token_estimate(t).alias("estimate"), text.choice_letter(t).alias("choice"), text.has_marker(t, ("<think", "</think>", "receipt")).alias("marked"),
        F.md5(text.squeezed(t)).alias("digest"), text.contains_all(t, F.lit("The  BANK")).alias("bank"),
    )


def stable_seeds(spark, folder):
    return table(spark, folder, "students", "student_id").select("student_id", text.stable_seed(F.col("student_id")).cast("string").alias("seed"), F.substring(text.seeded_hash("s1", F.col("student_id")), 1, 16).alias("hash"))


def _statement(spark, folder):
    rows = table(spark, folder, "bank_statement", "row_id", "batch_id", "reference", "date", "amount", "payer", "narration", "direction")
    return rows.withColumnsRenamed({"batch_id": "file", "row_id": "row_no"})


def statement_import_outcomes(spark, folder):
    return ingest.statement_outcomes(_statement(spark, folder))


def import_batch_summary(spark, folder):
    return ingest.batch_summary(ingest.statement_outcomes(_statement(spark, folder)))


def student_import(spark, folder):
    rows = table(spark, folder, "students", "student_id", "name", "class", "term_id", "aliases").withColumn("row_no", F.col("student_id"))
    out = ingest.student_register(rows)
    return out.select("student_id", "normalized_name", F.size("aliases").alias("aliases"), "outcome")


def fee_import(spark, folder):
    rows = table(spark, folder, "fees", "student_id", "fee_id", "term_id", "amount", "priority").withColumn("row_no", F.struct("amount", "priority"))
    return ingest.fee_register(rows).groupBy("fee_id", "outcome").agg(F.count("*").alias("rows"), F.sum("amount_minor").alias("amount_minor"), F.sum("priority").alias("priorities"))


def mapped_columns(spark, folder):
    rows = table(spark, folder, "canonical_transactions", "row_id", "payer_name", "raw_reference")
    out = ingest.mapped(rows, {"payer": "payer_name", "reference": "raw_reference", "fee_name": "missing"})
    return out.select("row_id", "payer", "reference", "fee_name")


def sibling_counts(spark, folder):
    return relations.sibling_counts(table(spark, folder, "student_guardians", "student_id", "guardian_id"))


def phone_suffix_join(spark, folder):
    texts = table(spark, folder, "bank_statement", "row_id", "narration").select(F.col("row_id").alias("text_id"), F.col("narration").alias("text"))
    phones = table(spark, folder, "guardians", "guardian_id", "phone_suffix").select(F.col("guardian_id").alias("phone_id"), F.col("phone_suffix").alias("suffix"))
    return relations.phone_matches(texts, phones).groupBy("phone_id").agg(F.count("*").alias("texts"))


def exact_balance_join(spark, folder):
    fees = table(spark, folder, "fees", "student_id", "fee_id", "term_id", "amount")
    balances = fees.select(F.col("student_id").alias("account"), money.parse_money(F.col("amount")).alias("balance"))
    payments = table(spark, folder, "bank_statement", "row_id", "amount").select(F.col("row_id").alias("payment_id"), money.parse_money(F.col("amount")).alias("amount"))
    return relations.amount_matches(payments, balances)


def jaro_winkler_scores(spark, folder):
    names = table(spark, folder, "guardians", "guardian_id", "normalized_name")
    other = names.select((F.substring("guardian_id", 3, 8).cast("bigint") - 1).alias("n"), F.col("normalized_name").alias("next"))
    joined = names.withColumn("n", F.substring("guardian_id", 3, 8).cast("bigint")).join(other, "n")
    ascii_ = joined.where("normalized_name rlike '^[a-z ]+$' and next rlike '^[a-z ]+$'")
    return ascii_.select("guardian_id", F.round(similarity.jaro_winkler(F.col("normalized_name"), F.col("next")), 9).alias("score"))


def fuzzy_candidates(spark, folder):
    """(token, target, score): tokens of guardians' names that are like a student's whole name or alias."""
    probes = table(spark, folder, "guardians", "normalized_name").select(F.explode(text.tokens(F.col("normalized_name"))).alias("a"))
    students = table(spark, folder, "students", "normalized_name", "aliases")
    aliases = students.select(F.explode(text.alias_list(F.col("aliases"))).alias("b")).select(text.normalize_name(F.col("b")).alias("b"))
    targets = students.select(F.col("normalized_name").alias("b")).unionByName(aliases).where("b <> ''")
    return relations.alike_names(probes, targets).select(F.col("a").alias("token"), F.col("b").alias("target"), F.round("score", 9).alias("score"))


def token_overlap(spark, folder):
    """(text_id, names, most): how many students share a name token with a guardian, and the most tokens shared."""
    texts = table(spark, folder, "guardians", "guardian_id", "normalized_name").select(F.col("guardian_id").alias("text_id"), F.col("normalized_name").alias("text"))
    names = table(spark, folder, "students", "student_id", "normalized_name").select(F.col("student_id").alias("name_id"), F.col("normalized_name").alias("name"))
    return relations.token_overlap(texts, names).groupBy("text_id").agg(F.count("*").alias("names"), F.max("common").alias("most"))


def import_errors(spark, folder):
    """(file, row_no, field, reason, raw): the refused rows of all statements."""
    rows = _statement(spark, folder)
    out = ingest.import_errors(rows, ingest.statement_outcomes(rows))
    return out.select("file", "row_no", "field", "reason", F.get_json_object("raw", "$.payer").alias("payer"))


def statement_reimport(spark, folder):
    """(outcome, rows): statements imported over what is stored already, the accepted rows of the other table."""
    stored = table(spark, folder, "canonical_transactions", "dedup_hash", "posted_at", "amount_minor", "payer_name", "narration").withColumnRenamed("payer_name", "payer")
    rows = _statement(spark, folder)
    mine = ingest.keyed_rows(rows).where("row_no % 2 = 0").select("dedup_hash", F.col("date").alias("posted_at"), "amount_minor", "payer", "narration")
    return ingest.statement_outcomes(rows, stored.unionByName(mine)).groupBy("outcome").agg(F.count("*").alias("rows"))


def setup_imports(spark, folder):
    """(kind, outcome, error, rows) of the registers of terms, guardians and relationships."""
    terms = table(spark, folder, "fees", "term_id", "fee_id").select(F.monotonically_increasing_id().alias("row_no"), "term_id", F.when(F.col("term_id") != "T2", F.lit(" 2025/2026 ")).alias("session"), F.col("term_id").alias("term_name"))
    terms = terms.groupBy("term_id", "session", "term_name").agg(F.min("row_no").alias("row_no"))
    guardians = table(spark, folder, "guardians", "guardian_id", "name", "phone_suffix").withColumn("row_no", F.col("guardian_id"))
    guardians = guardians.unionByName(guardians.withColumn("row_no", F.concat(F.lit("z"), "row_no")).withColumn("name", F.when(F.length("name") > 12, F.col("name"))))
    links = table(spark, folder, "student_guardians", "student_id", "guardian_id").withColumn("row_no", F.concat_ws("-", "student_id", "guardian_id", F.monotonically_increasing_id().cast("string")))
    done = (
        ("terms", ingest.setup_register(terms, ("term_id",), ("term_id", "session", "term_name"))),
        ("guardians", ingest.setup_register(guardians, ("guardian_id",), ("guardian_id", "name"))),
        ("relationships", ingest.setup_register(links, ("student_id", "guardian_id"), ("student_id", "guardian_id"))),
    )
    out = [df.groupBy("outcome", "error").agg(F.count("*").alias("rows")).select(F.lit(kind).alias("kind"), "outcome", "error", "rows") for kind, df in done]
    return out[0].unionByName(out[1]).unionByName(out[2])


def new_links(spark, folder):
    """(student_id, guardian_id): insert-or-ignore of all links over those of every other student."""
    links = table(spark, folder, "student_guardians", "student_id", "guardian_id")
    there = links.where("cast(substr(student_id, 5) as int) % 2 = 0")
    return ingest.first_wins(links.withColumn("n", F.lit(1)), there, ["student_id", "guardian_id"], "n").select("student_id", "guardian_id")


def current_states(spark, folder):
    """(reference, state, row_id): the latest routing state per canonical reference."""
    log = table(spark, folder, "canonical_transactions", "row_id", "reference", "routing_state").select("row_id", text.canonical_reference(F.col("reference")).alias("reference"), F.coalesce("routing_state", F.lit("new")).alias("state"))
    return ingest.latest_state(log.where("reference is not null").withColumn("at", F.col("row_id")), "reference", "row_id", "state", "at")


def recent_imports(spark, folder):
    """The twelve latest batches."""
    batches = table(spark, folder, "import_batches", "batch_id", "kind", "imported_at", "accepted", "rejected", "duplicate")
    return batches.orderBy(F.desc("imported_at"), "batch_id").limit(12).select("batch_id", "kind", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("accepted", "rejected", "duplicate")))


def review_queue(spark, folder):
    """Payments that wait for review, latest first."""
    rows = table(spark, folder, "canonical_transactions", "row_id", "transaction_id", "amount_minor", "routing_state").where("routing_state = 'review'")
    return rows.select("row_id", "transaction_id", money.format_money(F.col("amount_minor")).alias("shown")).orderBy(F.desc("row_id"))


def batch_states(spark, folder):
    """(status, kind, batches, accepted, mapped): import batches by state, with how many have a column mapping."""
    batches = table(spark, folder, "import_batches", "status", "kind", "accepted", "mapping")
    return batches.groupBy("status", "kind").agg(F.count("*").alias("batches"), F.coalesce(F.sum("accepted"), F.lit(0)).alias("accepted"), F.count_if(F.size("mapping") > 0).alias("mapped"))


def keyed_lookup(spark, folder):
    """(row_id, batch_row): many keys looked up at once: every statement row with the first accepted row of its reference's
    channel and last three digits."""
    short = lambda c: F.concat(F.substring(c, 1, 3), F.right(c, F.lit(3)))
    rows = table(spark, folder, "bank_statement", "row_id", "reference").select("row_id", short(text.canonical_reference(F.col("reference"))).alias("k"))
    known = table(spark, folder, "canonical_transactions", "row_id", "reference").select("row_id", short(text.canonical_reference(F.col("reference"))).alias("k")).groupBy("k").agg(F.min("row_id").alias("batch_row"))
    return rows.join(known, "k").select("row_id", "batch_row")


def dedup_hashes(spark, folder):
    """(row_id, dedup_hash, occurrence) of every credit with an amount."""
    return ingest.keyed_rows(_statement(spark, folder)).select(F.col("row_no").alias("row_id"), "dedup_hash", F.col("occurrence").cast("bigint").alias("occurrence"))


def text_variants(spark, folder):
    """(student_id, scanned, initials, nickname, variant, pidgin): names as they are damaged for synthetic cases."""
    name = F.trim(F.coalesce("name", F.lit("")))
    return table(spark, folder, "students", "student_id", "name").select(
        "student_id", text.lookalikes(name).alias("scanned"), text.initials(name).alias("initials"), text.nickname(name).alias("nickname"), text.name_variant("variant", F.col("student_id"), name).alias("variant"), text.pidgin(name).alias("pidgin")
    )


def word_flags(spark, folder):
    """(row_id, truthy, shown, choice): flags, percentages and choice letters."""
    rows = table(spark, folder, "bank_statement", "row_id", "direction", "amount")
    return rows.select(
        "row_id", (ingest.truthy(F.col("direction")) | F.coalesce(F.lower(F.trim("direction")) == "credit", F.lit(False))).alias("truthy"),
        text.percent(F.when(F.col("amount").isNotNull(), F.col("row_id") % 1000 / 1000)).alias("shown"), text.choice_label((F.col("row_id") % 4).cast("string")).alias("choice"),
    )


_DUCK_MONEY = """case when regexp_matches(trim(replace(trim(amount), '₦', '')), '^[+]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)?([.][0-9]{0,2})?$') and regexp_matches(trim(replace(trim(amount), '₦', '')), '[0-9]')
  then cast(try_cast(replace(trim(replace(trim(amount), '₦', '')), ',', '') as decimal(36,2)) * 100 as bigint) end"""
_NAME = """array_to_string(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^a-z]+'), lambda t: t <> '' and t not in ('mr','mrs','ms','miss','dr','prof','chief','alhaji','mallam')), ' ')"""
_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda t: t <> '')"
_KEYED = f"""with base as (select batch_id as file, row_id as row_no, nullif(upper(regexp_replace(reference, '[^A-Za-z0-9]', '', 'g')), '') as ref, coalesce(date, '') as date, coalesce(amount, '') as amount, payer as raw_payer,
  {_NAME.format(c='payer')} as payer, array_to_string({_TOKENS.format(c='narration')}, ' ') as words, lower(coalesce(nullif(direction, ''), 'credit')) = 'credit' as credit, {_DUCK_MONEY} as amount_minor from bank_statement),
good as (select *, row_number() over (partition by file, date, amount, payer, words order by row_no) - 1 as occ from base where credit and amount_minor is not null),
h as (select *, substr(sha256(case when ref is not null then 'REF:' || ref else array_to_string(['ROW', coalesce(file, ''), cast(occ as varchar), date, amount, payer, words], '|') end), 1, 24) as dedup_hash from good) """
_OUTCOMES = _KEYED + """, n as (select *, row_number() over (partition by dedup_hash order by file, row_no) = 1 as first from h),
m as (select *, sum(cast(first as int)) over (partition by substr(date, 1, 10), amount_minor, payer, words order by file, row_no) as near from n),
outcomes as (select file, row_no, 'skipped' as outcome, cast(null as varchar) as dedup_hash, cast(null as bigint) as amount_minor from base where not credit
  union all select file, row_no, 'rejected', null, null from base where credit and amount_minor is null
  union all select file, row_no, case when not first then 'duplicate' when ref is null and near > 1 then 'near_duplicate' else 'accepted' end, dedup_hash, amount_minor from m) """

QUERIES = {
    f.__name__: f
    for f in (
        money_parse, name_normalise, reference_canonical, token_lists, alias_lists, text_measures, stable_seeds, statement_import_outcomes, import_batch_summary, student_import, fee_import,
        mapped_columns, sibling_counts, phone_suffix_join, exact_balance_join, jaro_winkler_scores, fuzzy_candidates, token_overlap, import_errors, statement_reimport, setup_imports, new_links,
        current_states, recent_imports, review_queue, batch_states, keyed_lookup, dedup_hashes, text_variants, word_flags,
    )
}
ORACLE = {
    "money_parse": f"""with m as (select row_id, {_DUCK_MONEY} as minor from bank_statement)
    select row_id, minor, case when minor is not null then '₦' || format('{{:,}}', minor // 100) || '.' || lpad(cast(minor % 100 as varchar), 2, '0') end as shown,
    case when minor is not null then cast(minor // 100 as varchar) || '.' || lpad(cast(minor % 100 as varchar), 2, '0') end as plain from m""",
    "name_normalise": f"select student_id as id, {_NAME.format(c='name')} as normalized from students union all select guardian_id, {_NAME.format(c='name')} from guardians",
    "reference_canonical": "select row_id, nullif(upper(regexp_replace(reference, '[^A-Za-z0-9]', '', 'g')), '') as canonical from bank_statement",
    "token_lists": f"""select row_id, array_to_string({_TOKENS.format(c='narration')}, ' ') as words, cast(len({_TOKENS.format(c='narration')}) as int) as n,
    array_to_string(list_transform(regexp_extract_all(coalesce(narration, ''), '[A-Za-z]+-?[0-9]+'), lambda t: upper(t)), ' ') as identifiers,
    array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(narration, ''), '[0-9]{{3,}}'))), ' ') as runs from bank_statement""",
    "alias_lists": "select student_id, array_to_string(list_filter(list_transform(string_split(coalesce(aliases, ''), ';'), lambda a: trim(a)), lambda a: a <> ''), '|') as aliases from students",
    "text_measures": r"""with t as (select doc_id, coalesce(text, '') as t from documents)
    select doc_id, cast(ceil(length(t) / 3.0) as bigint) + length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) + 8 as estimate, regexp_extract(upper(t), '(?:^|[^\p{L}\p{N}_])([ABCD])(?:$|[^\p{L}\p{N}_])', 1) as choice,
    contains(lower(t), '<think') or contains(lower(t), '</think>') or contains(lower(t), 'receipt') as marked, md5(trim(regexp_replace(lower(t), '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g'))) as digest,
    contains(trim(regexp_replace(lower(t), '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g')), 'the bank') as bank from t""",
    "stable_seeds": "select student_id, cast(cast('0x' || substr(sha256(student_id), 1, 16) as ubigint) as varchar) as seed, substr(sha256('s1:' || student_id), 1, 16) as hash from students",
    "statement_import_outcomes": _OUTCOMES + "select * from outcomes",
    "import_batch_summary": _OUTCOMES
    + "select file, count(*) filter (outcome in ('accepted', 'near_duplicate')) as accepted, count(*) filter (outcome = 'rejected') as rejected, count(*) filter (outcome = 'duplicate') as duplicate, count(*) filter (outcome = 'skipped') as skipped from outcomes group by file",
    "student_import": f"""select student_id, {_NAME.format(c='name')} as normalized_name, cast(len(list_filter(list_transform(string_split(coalesce(aliases, ''), ';'), lambda a: trim(a)), lambda a: a <> '')) as int) as aliases,
    case when trim(coalesce(student_id, '')) = '' or trim(coalesce(name, '')) = '' then 'rejected' else 'accepted' end as outcome from students""",
    "fee_import": f"""with p0 as (select fee_id, {_DUCK_MONEY} as minor, try_cast(trim(priority) as int) as priority, amount as raw, priority as raw_priority, student_id, term_id from fees),
    p as (select *, row_number() over (partition by student_id, fee_id, term_id, minor is null or priority is null order by raw nulls first, raw_priority nulls first) as n from p0)
    select fee_id, case when minor is null or priority is null then 'rejected' when n > 1 then 'duplicate' else 'accepted' end as outcome, count(*) as rows, cast(sum(minor) as bigint) as amount_minor, cast(sum(priority) as bigint) as priorities from p group by 1, 2""",
    "mapped_columns": "select row_id, coalesce(payer_name, '') as payer, coalesce(raw_reference, '') as reference, '' as fee_name from canonical_transactions",
    "sibling_counts": """with l as (select distinct student_id, guardian_id from student_guardians) select student_id, count(distinct sibling) as siblings from
    (select a.student_id, b.student_id as sibling from l a join l b on a.guardian_id = b.guardian_id and a.student_id <> b.student_id) group by student_id""",
    "phone_suffix_join": """with r as (select distinct row_id, unnest(regexp_extract_all(coalesce(narration, ''), '[0-9]{3,}')) as run from bank_statement),
    e as (select distinct row_id, right(run, cast(n as int)) as suffix from r, (select distinct length(phone_suffix) as n from guardians where phone_suffix <> '') where length(run) >= n)
    select guardian_id as phone_id, count(*) as texts from e join guardians on phone_suffix = suffix where phone_suffix <> '' group by guardian_id""",
    "exact_balance_join": f"""with b as (select distinct student_id, {_DUCK_MONEY} as balance from fees), c as (select balance as amount, count(*) as matching from b where balance > 0 group by 1),
    p as (select row_id as payment_id, {_DUCK_MONEY} as amount from bank_statement) select payment_id, matching from p join c using (amount)""",
    "jaro_winkler_scores": """with a as (select guardian_id, cast(substr(guardian_id, 3, 8) as bigint) as n, normalized_name as x from guardians), j as (select a.guardian_id, a.x, b.x as y from a join a b on b.n = a.n + 1
      where regexp_full_match(a.x, '[a-z ]+') and regexp_full_match(b.x, '[a-z ]+')),
    s as (select *, jaro_similarity(x, y) as s, case when substr(x,1,4) = substr(y,1,4) and length(x) >= 4 and length(y) >= 4 then 4 when substr(x,1,3) = substr(y,1,3) and length(x) >= 3 and length(y) >= 3 then 3
      when substr(x,1,2) = substr(y,1,2) and length(x) >= 2 and length(y) >= 2 then 2 when substr(x,1,1) = substr(y,1,1) then 1 else 0 end as p from j)
    select guardian_id, round(s + 0.1 * p * (1 - s), 9) as score from s""",
    "fuzzy_candidates": f"""with p as (select distinct unnest({_TOKENS.format(c='normalized_name')}) as x from guardians),
    t as (select normalized_name as y from students union select {_NAME.format(c='y')} from (select unnest(string_split(coalesce(aliases, ''), ';')) as y from students)),
    s as (select x, y, jaro_similarity(x, y) as s, case when substr(x,1,4) = substr(y,1,4) and length(x) >= 4 and length(y) >= 4 then 4 when substr(x,1,3) = substr(y,1,3) and length(x) >= 3 and length(y) >= 3 then 3
      when substr(x,1,2) = substr(y,1,2) and length(x) >= 2 and length(y) >= 2 then 2 when substr(x,1,1) = substr(y,1,1) then 1 else 0 end as p from p, t where y <> '')
    select x as token, y as target, round(s + 0.1 * p * (1 - s), 9) as score from s where s + 0.1 * p * (1 - s) >= 0.88""",
    "token_overlap": """with g as (select distinct guardian_id as text_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(normalized_name, '')), '[^a-z0-9]+'), lambda t: t <> '')) as token from guardians),
    s as (select distinct student_id as name_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(normalized_name, '')), '[^a-z0-9]+'), lambda t: t <> '')) as token from students),
    o as (select text_id, name_id, count(*) as common from g join s using (token) group by 1, 2) select text_id, count(*) as names, max(common) as most from o group by 1""",
    "import_errors": _OUTCOMES + "select file, row_no, 'amount' as field, case when trim(b.amount) = '' then 'missing' else 'no amount' end as reason, raw_payer as payer from outcomes join base b using (file, row_no) where outcome = 'rejected'",
    "statement_reimport": _KEYED
    + f""", stored as (select dedup_hash, substr(coalesce(posted_at, ''), 1, 10) as day, amount_minor, {_NAME.format(c='payer_name')} as payer, array_to_string({_TOKENS.format(c='narration')}, ' ') as words from canonical_transactions
      union all select dedup_hash, substr(date, 1, 10), amount_minor, payer, words from h where row_no % 2 = 0),
    n as (select *, row_number() over (partition by dedup_hash order by file, row_no) = 1 and dedup_hash not in (select dedup_hash from stored where dedup_hash is not null) as first from h),
    m as (select *, sum(cast(first as int)) over (partition by substr(date, 1, 10), amount_minor, payer, words order by file, row_no) as near, (substr(date, 1, 10), amount_minor, payer, words) in (select day, amount_minor, payer, words from stored) as old from n),
    o as (select 'skipped' as outcome from base where not credit union all select 'rejected' from base where credit and amount_minor is null
      union all select case when not first then 'duplicate' when ref is null and (near > 1 or old) then 'near_duplicate' else 'accepted' end from m) select outcome, count(*) as rows from o group by 1""",
    "setup_imports": """with t as (select distinct term_id, case when term_id <> 'T2' then '2025/2026' else '' end as session from fees where term_id is not null),
    g as (select guardian_id, trim(coalesce(name, '')) as name, 1 as n from guardians union all select guardian_id, case when length(name) > 12 then trim(name) else '' end, 2 from guardians),
    gg as (select *, row_number() over (partition by guardian_id order by n) as k from g where guardian_id <> '' and name <> ''),
    l as (select row_number() over (partition by trim(student_id), trim(guardian_id)) as k from student_guardians where trim(coalesce(student_id, '')) <> '' and trim(coalesce(guardian_id, '')) <> '')
    select 'terms' as kind, case when session = '' then 'rejected' else 'accepted' end as outcome, case when session = '' then 'term_id/session/term_name' end as error, count(*) as rows from t group by 2, 3
    union all select 'guardians', case when k = 1 then 'accepted' else 'duplicate' end, null, count(*) from gg group by 2 union all select 'guardians', 'rejected', 'guardian_id/name', count(*) from g where guardian_id = '' or name = '' having count(*) > 0
    union all select 'relationships', case when k = 1 then 'accepted' else 'duplicate' end, null, count(*) from l group by 2""",
    "new_links": "select distinct student_id, guardian_id from student_guardians where cast(substr(student_id, 5) as int) % 2 <> 0",
    "current_states": "select nullif(upper(regexp_replace(reference, '[^A-Za-z0-9]', '', 'g')), '') as reference, max_by(coalesce(routing_state, 'new'), row_id) as state, max(row_id) as at from canonical_transactions where nullif(upper(regexp_replace(reference, '[^A-Za-z0-9]', '', 'g')), '') is not null group by 1",
    "recent_imports": "select batch_id, kind, coalesce(accepted, 0) as accepted, coalesce(rejected, 0) as rejected, coalesce(duplicate, 0) as duplicate from import_batches order by imported_at desc nulls last, batch_id limit 12",
    "review_queue": "select row_id, transaction_id, case when amount_minor < 0 then '-' else '' end || '₦' || format('{:,}', abs(amount_minor) // 100) || '.' || lpad(cast(abs(amount_minor) % 100 as varchar), 2, '0') as shown from canonical_transactions where routing_state = 'review' order by row_id desc",
    "batch_states": "select status, kind, count(*) as batches, cast(coalesce(sum(accepted), 0) as bigint) as accepted, count(*) filter (cardinality(mapping) > 0) as mapped from import_batches group by 1, 2",
    "keyed_lookup": """with a as (select row_id, nullif(upper(regexp_replace(reference, '[^A-Za-z0-9]', '', 'g')), '') as r from bank_statement), b as (select row_id, nullif(upper(regexp_replace(reference, '[^A-Za-z0-9]', '', 'g')), '') as r from canonical_transactions)
    select a.row_id, batch_row from a join (select substr(r, 1, 3) || right(r, 3) as k, min(row_id) as batch_row from b where r is not null group by 1) on k = substr(a.r, 1, 3) || right(a.r, 3)""",
    "dedup_hashes": _KEYED + "select row_no as row_id, dedup_hash, occ as occurrence from h",
    "text_variants": """with n as (select student_id, trim(coalesce(name, '')) as name from students), w as (select *, list_filter(string_split(name, ' '), lambda x: x <> '') as ws, cast('0x' || substr(sha256('variant:' || student_id), 1, 8) as bigint) % 3 as pick from n)
    select student_id, translate(name, 'oOiIsSbB', '00115588') as scanned, array_to_string(list_concat(list_transform(ws[1:greatest(len(ws) - 1, 0)], lambda x: substr(x, 1, 1) || '.'), ws[-1:]), ' ') as initials, substr(coalesce(ws[1], ''), 1, 3) as nickname,
    case when pick = 0 then array_to_string(list_transform(ws, lambda x: substr(x, 1, 1)), '.') when pick = 1 and length(name) > 4 then substr(name, 1, 2) || substr(name, 4, 1) || substr(name, 3, 1) || substr(name, 5) else coalesce(ws[1], '') end as variant,
    'abeg na ' || name || ' school fee be dis' as pidgin from w""",
    "word_flags": """select row_id, lower(trim(coalesce(direction, ''))) in ('1', 'true', 'yes', 'credit') as truthy, case when amount is null then '—' else printf('%.1f%%', row_id % 1000 / 10.0) end as shown, ['A', 'B', 'C', 'D'][row_id % 4 + 1] as choice from bank_statement""",
}
