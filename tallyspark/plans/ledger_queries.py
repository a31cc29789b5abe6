"""Ledger projections, allocation and checks over the star-schema tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import tables
from tallyspark.operators import allocation, ledger
from tallyspark.tables import table


def _parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return tables.ledger(spark, folder), tables.transactions(spark, folder)


def live_events_by_kind(spark, folder):
    live = ledger.live_events(tables.ledger(spark, folder))
    return live.groupBy("event_type").agg(F.count("*").alias("events"), F.sum("amount_minor").alias("amount_minor"))


def charge_balance(spark, folder):
    return ledger.charge_balances(tables.ledger(spark, folder))


def student_status(spark, folder):
    students = table(spark, folder, "customer", "c_custkey").select(F.col("c_custkey").alias("student_id"))
    return ledger.student_status(tables.ledger(spark, folder), students)


def dashboard_totals(spark, folder):
    return ledger.totals(*_parts(spark, folder))


def holder_credit(spark, folder):
    return ledger.holder_credit(tables.ledger(spark, folder))


def txn_unapplied(spark, folder):
    return ledger.transaction_use(*_parts(spark, folder))


def payer_history(spark, folder):
    return ledger.payer_history(*_parts(spark, folder))


def audit_trail(spark, folder):
    return ledger.audit_trail(tables.ledger(spark, folder)).groupBy("event_type", "is_reversed").agg(F.count("*").alias("events"), F.sum("amount_minor").alias("amount_minor"))


def charges_by_priority(spark, folder):
    balances = ledger.charge_balances(tables.ledger(spark, folder)).select("charge_id", "balance")
    return tables.charges(spark, folder).join(balances, "charge_id").orderBy("priority", "charge_id")


def _balances(spark, folder):
    orders = table(spark, folder, "orders", "o_orderkey", "o_totalprice")
    owed = orders.select(F.col("o_orderkey").alias("charge_id"), tables.kobo("o_totalprice").alias("balance"))
    return tables.charges(spark, folder).join(owed, "charge_id")


def _money(spark, folder):
    customers = table(spark, folder, "customer", "c_custkey", "c_acctbal")
    return customers.select(F.col("c_custkey").alias("student_id"), (tables.kobo("c_acctbal") * 30).alias("amount")).where("amount > 0")


def waterfall_allocation(spark, folder):
    return allocation.waterfall(_balances(spark, folder), _money(spark, folder))


def waterfall_surplus(spark, folder):
    return allocation.surplus(_balances(spark, folder), _money(spark, folder))


def sequential_posting(spark, folder):
    limits = table(spark, folder, "customer", "c_custkey", "c_acctbal").select(F.col("c_custkey").alias("key"), F.greatest(F.lit(0), tables.kobo("c_acctbal")).alias("limit"))
    payments = tables.transactions(spark, folder).select(F.col("payer").alias("key"), F.col("posted_at").alias("at"), F.col("transaction_id").alias("id"), F.col("amount_minor").alias("amount"))
    return allocation.post_in_order(limits, payments)


def _proposals(spark, folder):
    """(proposals, events): one proposal per order, of its lines; some break a rule: line 7 names an unknown charge, line 6 is a
    credit application, line 5 a grant, and quantities decide on missing provenance, unknown students and bad amounts."""
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supplier"), F.sum("l_quantity").alias("q"))
    lines = lines.join(table(spark, folder, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    q, n = F.round("q").cast("bigint"), F.col("l_linenumber")
    kind = F.when(n == 6, "credit_application").when(n == 5, "credit_grant").otherwise("allocation")
    events = lines.select(
        F.col("l_orderkey").alias("proposal_id"), (F.col("l_orderkey") * 10 + n).alias("event_id"), kind.alias("event_type"), F.when(n == 4, F.col("part")).when(n != 6, F.col("l_orderkey") * 7 % 9973 + 1).alias("transaction_id"),
        F.when(n == 7, -F.col("l_orderkey")).when(n != 5, F.col("l_orderkey")).alias("charge_id"), F.when(q % 41 == 0, F.lit(-1)).otherwise(F.col("o_custkey")).alias("student_id"),
        F.when(n.isin(5, 6), F.when(q % 3 == 0, F.col("o_custkey")).otherwise(F.col("supplier") + 100_000_000)).alias("holder"), F.when(q % 43 == 0, -q).otherwise(q).alias("amount_minor"),
        F.lit("desk").alias("actor"), F.lit("import").alias("source"), F.when(q % 37 == 0, F.lit("")).otherwise(F.col("l_orderkey").cast("string")).alias("evidence_ref"), F.lit("rule").alias("decision_path"),
    )
    return events.where("event_type <> 'credit_application'").groupBy("proposal_id").agg(F.min("transaction_id").alias("transaction_id")).unionByName(
        events.groupBy("proposal_id").agg(F.min("event_type").alias("e"), F.max("event_type").alias("f")).where("e = 'credit_application' and f = e").select("proposal_id", F.lit(None).cast("bigint").alias("transaction_id"))
    ), events


def _judged(spark, folder):
    log, txns = _parts(spark, folder)
    proposals, events = _proposals(spark, folder)
    students = table(spark, folder, "customer", "c_custkey").select(F.col("c_custkey").alias("student_id"))
    return events, ledger.verdicts(proposals, events, log, txns, tables.charges(spark, folder), students, students.withColumnRenamed("student_id", "holder"))


def constraint_violations(spark, folder):
    return _judged(spark, folder)[1].select("proposal_id", F.array_join("violations", ",").alias("violations"))


def posted_events(spark, folder):
    """What is appended, per kind: proposals without violations, as a whole."""
    events, judged = _judged(spark, folder)
    kept = ledger.posted(events, judged, {"actor": "engine", "source": "batch", "evidence_ref": "none", "decision_path": "auto"})
    return kept.groupBy("event_type").agg(F.count("*").alias("events"), F.sum("amount_minor").alias("amount_minor"), F.countDistinct("proposal_id").alias("proposals"))


def credit_sufficiency(spark, folder):
    wanted = _proposals(spark, folder)[1].where("event_type = 'credit_application'").select((F.col("student_id")).alias("holder"), (F.col("amount_minor") * 1000).alias("amount_minor"))
    return ledger.credit_shortfalls(wanted, tables.ledger(spark, folder))


def emptied_transactions(spark, folder):
    """One payment per charge."""
    return ledger.emptied_transactions(tables.ledger(spark, folder).withColumn("transaction_id", F.col("charge_id")))


def transaction_audit(spark, folder):
    return ledger.transaction_audit(tables.ledger(spark, folder))


def student_events(spark, folder):
    return ledger.student_events(tables.ledger(spark, folder)).groupBy("about", "event_type").agg(F.count("*").alias("events"), F.sum("amount_minor").alias("amount_minor"), F.max("event_id").alias("last"))


def reversal_events(spark, folder):
    """The reversals of all allocations of first lines: the events that a correction appends."""
    asked = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber").where("l_linenumber = 1").select((F.col("l_orderkey") * 100 + 1).alias("event_id")).distinct()
    return ledger.reversals(asked, tables.ledger(spark, folder)).select("event_type", "charge_id", "student_id", "amount_minor", "reverses_event_id")


def reversal_requests(spark, folder):
    """Requests for real events of all lines: every allocation, that of a first line twice, every reversal, and an
    unknown event for each seventh line."""
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    key = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    ids = F.array(key, F.when(F.col("l_linenumber") == 1, key), F.when(F.col("l_returnflag") == "R", key + 50), F.when(F.col("l_linenumber") == 7, key + 20))
    asked = lines.select(F.explode(F.array_compact(ids)).alias("event_id"))
    return ledger.reversal_problems(asked, tables.ledger(spark, folder))


def orphan_links(spark, folder):
    from tallyspark.operators.ingest import orphans

    links = table(spark, folder, "student_guardians", "student_id", "guardian_id")
    fees = table(spark, folder, "fees", "student_id")
    students, guardians = table(spark, folder, "students", "student_id"), table(spark, folder, "guardians", "guardian_id")
    found = [orphans(links, students, "student_id"), orphans(fees, students, "student_id")]
    named = [f.select(F.lit(n).alias("relation"), F.col("student_id").alias("id"), "rows") for n, f in zip(("link_student", "fee_student"), found)]
    named.append(orphans(links, guardians, "guardian_id").select(F.lit("link_guardian").alias("relation"), F.col("guardian_id").alias("id"), "rows"))
    return named[0].unionByName(named[1]).unionByName(named[2])


_LEDGER = """
lines as (select l_orderkey, l_linenumber, sum(cast(round(l_extendedprice * 100) as bigint)) as amount_minor, max(l_returnflag) as flag, min(l_partkey) as part
  from lineitem group by l_orderkey, l_linenumber),
ledger as (
  select o_orderkey * 100 as event_id, 'charge_created' as event_type, cast(null as bigint) as transaction_id, o_orderkey as charge_id, o_custkey as student_id, cast(null as bigint) as holder,
    cast(round(o_totalprice * 100) as bigint) as amount_minor, cast(null as bigint) as reverses_event_id from orders
  union all
  select l_orderkey * 100 + l_linenumber, 'allocation', part, l_orderkey, o_custkey, null, amount_minor, null from lines join orders on l_orderkey = o_orderkey
  union all
  select l_orderkey * 100 + l_linenumber + 50, 'reversal', part, l_orderkey, o_custkey, null, amount_minor, l_orderkey * 100 + l_linenumber from lines join orders on l_orderkey = o_orderkey where flag = 'R'
  union all
  select event_id + 10000000000, case event_type when 'purchase' then 'credit_grant' else 'credit_application' end, event_id, null, null, user_id, cast(round(value * 100) as bigint), null
  from events where event_type in ('purchase', 'error')),
live as (select * from ledger l where event_type <> 'reversal' and not exists (select 1 from ledger r where r.event_type = 'reversal' and r.reverses_event_id = l.event_id)),
txns as (select event_id as transaction_id, user_id as payer, cast(round(value * 100) as bigint) as amount_minor, ts as posted_at from events),
balances as (select charge_id, max(student_id) as student_id, cast(sum(case when event_type = 'charge_created' then amount_minor else 0 end) as bigint) as billed,
  cast(sum(case when event_type in ('allocation', 'credit_application') then amount_minor else 0 end) as bigint) as paid from live where charge_id is not null group by charge_id),
used as (select transaction_id, cast(sum(case when event_type in ('allocation', 'credit_grant') then amount_minor else 0 end) as bigint) as used from live where transaction_id is not null group by transaction_id),
credit as (select holder, cast(sum(case event_type when 'credit_grant' then amount_minor when 'credit_application' then -amount_minor else 0 end) as bigint) as credit from live where holder is not null group by holder)
"""
_WITH = f"with {_LEDGER} "
_PROPOSED = _WITH + """
, q as (select l_orderkey, l_linenumber as n, min(l_partkey) as part, min(l_suppkey) as supplier, cast(round(sum(l_quantity)) as bigint) as q from lineitem group by 1, 2),
ev as (select l_orderkey as proposal_id, case n when 6 then 'credit_application' when 5 then 'credit_grant' else 'allocation' end as event_type, case n when 4 then part when 6 then null else l_orderkey * 7 % 9973 + 1 end as transaction_id,
  case when n = 7 then -l_orderkey when n <> 5 then l_orderkey end as charge_id, case when q % 41 = 0 then -1 else o_custkey end as student_id,
  case when n in (5, 6) then case when q % 3 = 0 then o_custkey else supplier + 100000000 end end as holder, case when q % 43 = 0 then -q else q end as amount_minor, q % 37 = 0 as blank
  from q join orders on o_orderkey = l_orderkey),
pr as (select proposal_id, min(transaction_id) as own from ev group by 1),
inv as (select proposal_id, bool_or(amount_minor < 0) as i3, bool_or(blank) as i9,
  bool_or((charge_id is not null and charge_id not in (select o_orderkey from orders)) or student_id not in (select c_custkey from customer) or (event_type = 'credit_grant' and holder not in (select c_custkey from customer))) as i4,
  coalesce(sum(amount_minor) filter (event_type in ('allocation', 'credit_grant') and transaction_id = own), 0) as spends, any_value(own) as own from ev join pr using (proposal_id) group by 1),
pc as (select proposal_id, charge_id, sum(amount_minor) as add from ev where event_type <> 'credit_grant' and charge_id in (select o_orderkey from orders) group by 1, 2),
i5 as (select proposal_id, bool_or(coalesce(paid, 0) + add > coalesce(billed, 0)) as over from pc left join balances using (charge_id) group by 1),
ph as (select proposal_id, holder, sum(amount_minor) as add from ev where event_type = 'credit_application' group by 1, 2),
i6 as (select proposal_id, bool_or(add > coalesce(credit, 0)) as short from ph left join credit using (holder) group by 1),
judged as (select i.proposal_id, concat_ws(',', case when i3 then 'INV-03' end, case when i9 then 'INV-09' end, case when i4 then 'INV-04' end,
  case when own is not null and spends > coalesce(t.amount_minor - coalesce(u.used, 0), 0) then 'INV-01' end, case when over then 'INV-05' end, case when short then 'INV-05' end) as violations
  from inv i left join txns t on t.transaction_id = own left join used u on u.transaction_id = own left join i5 on i5.proposal_id = i.proposal_id left join i6 on i6.proposal_id = i.proposal_id) """
_OPEN = """with owed as (select o_custkey as student_id, o_orderkey as charge_id, cast(substr(o_orderpriority, 1, 1) as int) as priority, cast(round(o_totalprice * 100) as bigint) as balance from orders),
money as (select c_custkey as student_id, cast(round(c_acctbal * 100) as bigint) * 30 as amount from customer where cast(round(c_acctbal * 100) as bigint) > 0) """

QUERIES = {
    f.__name__: f
    for f in (
        student_status, live_events_by_kind, charge_balance, dashboard_totals, holder_credit, txn_unapplied, payer_history, audit_trail, charges_by_priority, waterfall_allocation,
        waterfall_surplus, sequential_posting, constraint_violations, posted_events, credit_sufficiency, emptied_transactions,
        transaction_audit, student_events, reversal_events, reversal_requests, orphan_links,
    )
}
ORACLE = {
    "live_events_by_kind": _WITH + "select event_type, count(*) as events, cast(sum(amount_minor) as bigint) as amount_minor from live group by event_type",
    "charge_balance": _WITH + "select charge_id, student_id, billed, paid, billed - paid as balance from balances",
    "student_status": _WITH
    + """, per as (select c_custkey as student_id, cast(coalesce(sum(billed), 0) as bigint) as billed, cast(coalesce(sum(paid), 0) as bigint) as paid from customer left join balances on student_id = c_custkey group by c_custkey)
    select per.student_id, billed, paid, coalesce(credit, 0) as credit, case when coalesce(credit, 0) > 0 and paid >= billed then 'credit' when paid <= 0 then 'outstanding' when paid < billed then 'part_paid' else 'cleared' end as status
    from per left join credit on holder = per.student_id""",
    "dashboard_totals": _WITH
    + """, s as (select cast(sum(case when event_type = 'charge_created' then amount_minor else 0 end) as bigint) as billed, cast(sum(case when event_type = 'allocation' then amount_minor else 0 end) as bigint) as allocated,
    cast(sum(case when event_type = 'credit_application' then amount_minor else 0 end) as bigint) as applied, cast(sum(case when event_type = 'credit_grant' then amount_minor else 0 end) as bigint) as granted, count(*) as events from live),
    r as (select cast(coalesce(sum(amount_minor), 0) as bigint) as received from txns)
    select billed, allocated, applied, granted, received, events, greatest(0, billed - allocated - applied) as outstanding, granted - applied as credited, greatest(0, received - allocated - granted) as unapplied from s, r""",
    "holder_credit": _WITH + "select holder, credit from credit",
    "txn_unapplied": _WITH + "select transaction_id, amount_minor, coalesce(used, 0) as used, amount_minor - coalesce(used, 0) as unapplied from txns left join used using (transaction_id)",
    "payer_history": _WITH + "select payer, student_id, count(*) as payments from live join txns using (transaction_id) where event_type = 'allocation' group by payer, student_id",
    "audit_trail": _WITH
    + """select event_type, event_id in (select reverses_event_id from ledger where event_type = 'reversal') as is_reversed, count(*) as events, cast(sum(amount_minor) as bigint) as amount_minor from ledger group by 1, 2""",
    "charges_by_priority": _WITH + "select o_orderkey as charge_id, o_custkey as student_id, cast(substr(o_orderpriority, 1, 1) as int) as priority, billed - paid as balance from orders join balances on charge_id = o_orderkey order by priority, charge_id",
    "waterfall_allocation": _OPEN
    + """, w as (select owed.*, amount, coalesce(sum(balance) over (partition by student_id order by priority, charge_id rows between unbounded preceding and 1 preceding), 0) as before from owed join money using (student_id) where balance > 0)
    select student_id, charge_id, cast(least(balance, amount - before) as bigint) as take from w where least(balance, amount - before) > 0""",
    "waterfall_surplus": _OPEN
    + "select student_id, cast(amount - coalesce(o, 0) as bigint) as surplus from money left join (select student_id, sum(balance) as o from owed where balance > 0 group by student_id) using (student_id) where amount - coalesce(o, 0) > 0",
    "sequential_posting": """with recursive p as (select user_id as key, cast(round(value * 100) as bigint) as amount, row_number() over (partition by user_id order by ts, event_id) as n from events),
    lim as (select c_custkey as key, greatest(0, cast(round(c_acctbal * 100) as bigint)) as l from customer where c_custkey in (select user_id from events)),
    f as (select key, cast(0 as bigint) as n, l as remaining, 0 as posted, 0 as skipped from lim
      union all select f.key, f.n + 1, case when amount <= remaining then remaining - amount else remaining end, posted + case when amount <= remaining then 1 else 0 end, skipped + case when amount <= remaining then 0 else 1 end
      from f join p on p.key = f.key and p.n = f.n + 1)
    select key, max_by(remaining, n) as remaining, max_by(posted, n) as posted, max_by(skipped, n) as skipped from f group by key""",
    "constraint_violations": _PROPOSED + "select proposal_id, violations from judged",
    "posted_events": _PROPOSED + "select event_type, count(*) as events, cast(sum(amount_minor) as bigint) as amount_minor, count(distinct proposal_id) as proposals from ev join judged using (proposal_id) where violations = '' group by 1",
    "credit_sufficiency": _PROPOSED
    + """select w.holder, coalesce(credit, 0) as credit, wanted, wanted - coalesce(credit, 0) as missing from (select student_id as holder, cast(sum(amount_minor * 1000) as bigint) as wanted from ev where event_type = 'credit_application' group by 1) w
    left join credit c on c.holder = w.holder where wanted > coalesce(credit, 0)""",
    "emptied_transactions": _WITH + "select distinct charge_id as transaction_id from ledger where event_type = 'reversal' and charge_id not in (select charge_id from live where event_type = 'allocation' and charge_id is not null)",
    "transaction_audit": _WITH
    + """, back as (select reverses_event_id as target, event_id, event_type, amount_minor from ledger where reverses_event_id is not null),
    a as (select transaction_id as about, event_id, event_type, amount_minor from ledger where transaction_id is not null
      union select l.transaction_id, b.event_id, b.event_type, b.amount_minor from back b join ledger l on l.event_id = b.target where l.transaction_id is not null)
    select a.*, exists (select 1 from back where target = a.event_id) as is_reversed from a""",
    "student_events": _WITH
    + """, n as (select student_id as about, event_id, event_type, amount_minor from ledger where student_id is not null union all select holder, event_id, event_type, amount_minor from ledger where holder is not null and holder is distinct from student_id)
    select about, event_type, count(*) as events, cast(sum(amount_minor) as bigint) as amount_minor, max(event_id) as last from n group by 1, 2""",
    "reversal_events": _WITH
    + """select 'reversal' as event_type, charge_id, student_id, amount_minor, event_id as reverses_event_id from ledger l where event_type = 'allocation' and event_id % 100 = 1
    and not exists (select 1 from ledger r where r.reverses_event_id = l.event_id)""",
    "reversal_requests": _WITH
    + """, wanted as (select l_orderkey * 100 + l_linenumber as event_id from lineitem union all select l_orderkey * 100 + 1 from lineitem where l_linenumber = 1
      union all select l_orderkey * 100 + l_linenumber + 50 from lineitem where l_returnflag = 'R' union all select l_orderkey * 100 + 27 from lineitem where l_linenumber = 7),
    asked as (select event_id, count(*) as times from wanted group by 1), undone as (select distinct reverses_event_id as event_id from ledger where event_type = 'reversal'),
    j as (select a.event_id, case when l.event_id is null then 'unknown' when l.event_type = 'reversal' then 'is_reversal' when u.event_id is not null then 'already_reversed' when times > 1 then 'requested_twice' end as problem
      from asked a left join ledger l using (event_id) left join undone u using (event_id)) select event_id, problem from j where problem is not null""",
    "orphan_links": """select 'link_student' as relation, student_id as id, count(*) as rows from student_guardians where student_id is not null and student_id not in (select student_id from students) group by 2
    union all select 'fee_student', student_id, count(*) from fees where student_id is not null and student_id not in (select student_id from students) group by 2
    union all select 'link_guardian', guardian_id, count(*) from student_guardians where guardian_id is not null and guardian_id not in (select guardian_id from guardians) group by 2""",
}
