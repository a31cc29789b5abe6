"""Projections of an append-only event log, always net of reversals, and checks on proposed events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.session import cut

#: The kinds of ledger events.
KINDS = ("charge_created", "allocation", "reversal", "credit_grant", "credit_application")


def live_events(ledger: DataFrame, **equals) -> DataFrame:
    """Events that neither are reversals nor were reversed, with optional equality filters. An anti-join
    (not NOT IN), so that large logs may be shuffled."""
    undone = ledger.where("event_type = 'reversal' and reverses_event_id is not null").select(F.col("reverses_event_id").alias("event_id"))
    live = ledger.where("event_type <> 'reversal'").join(undone, "event_id", "left_anti")
    return reduce(lambda df, x: df.where(F.col(x[0]) == F.lit(x[1])), equals.items(), live)


def _sum_of(*kinds: str) -> Column:
    return F.sum(F.when(F.col("event_type").isin(*kinds), F.col("amount_minor")).otherwise(0))


def charge_balances(ledger: DataFrame) -> DataFrame:
    """(charge_id, student_id, billed, paid, balance) of every charge: one aggregation with two conditional sums."""
    sums = live_events(ledger).where("charge_id is not null").groupBy("charge_id").agg(
        F.max("student_id").alias("student_id"), _sum_of("charge_created").alias("billed"), _sum_of("allocation", "credit_application").alias("paid")
    )
    return sums.withColumn("balance", F.col("billed") - F.col("paid"))


def transaction_use(ledger: DataFrame, transactions: DataFrame) -> DataFrame:
    """(transaction_id, amount_minor, used, unapplied): what of each payment is allocated or granted."""
    used = live_events(ledger).where("transaction_id is not null").groupBy("transaction_id").agg(_sum_of("allocation", "credit_grant").alias("used"))
    joined = transactions.select("transaction_id", "amount_minor").join(used, "transaction_id", "left")
    return joined.select("transaction_id", "amount_minor", F.coalesce("used", F.lit(0)).alias("used"), (F.col("amount_minor") - F.coalesce("used", F.lit(0))).alias("unapplied"))


def holder_credit(ledger: DataFrame) -> DataFrame:
    """(holder, credit): grants less applications."""
    signed = F.when(F.col("event_type") == "credit_grant", F.col("amount_minor")).when(F.col("event_type") == "credit_application", -F.col("amount_minor"))
    return live_events(ledger).where("holder is not null").groupBy("holder").agg(F.coalesce(F.sum(signed), F.lit(0)).alias("credit"))


def student_status(ledger: DataFrame, students: DataFrame) -> DataFrame:
    """(student_id, billed, paid, credit, status) of every student; the order of the cases matters."""
    sums = charge_balances(ledger).groupBy("student_id").agg(F.sum("billed").alias("billed"), F.sum("paid").alias("paid"))
    credit = holder_credit(ledger).withColumnRenamed("holder", "student_id")
    joined = students.select("student_id").join(sums, "student_id", "left").join(credit, "student_id", "left").fillna(0, ["billed", "paid", "credit"])
    status = (
        F.when((F.col("credit") > 0) & (F.col("paid") >= F.col("billed")), "credit")
        .when(F.col("paid") <= 0, "outstanding")
        .when(F.col("paid") < F.col("billed"), "part_paid")
        .otherwise("cleared")
    )
    return joined.select("student_id", "billed", "paid", "credit", status.alias("status"))


def totals(ledger: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row of sums over the whole log; differences never fall below zero."""
    live = live_events(ledger).agg(
        _sum_of("charge_created").alias("billed"), _sum_of("allocation").alias("allocated"), _sum_of("credit_application").alias("applied"),
        _sum_of("credit_grant").alias("granted"), F.count("*").alias("events"),
    )
    received = transactions.agg(F.coalesce(F.sum("amount_minor"), F.lit(0)).alias("received"))
    zero = F.lit(0).cast("bigint")
    return live.crossJoin(F.broadcast(received)).select(  # one row each
        "billed", "allocated", "applied", "granted", "received", "events",
        F.greatest(zero, F.col("billed") - F.col("allocated") - F.col("applied")).alias("outstanding"),
        (F.col("granted") - F.col("applied")).alias("credited"),
        F.greatest(zero, F.col("received") - F.col("allocated") - F.col("granted")).alias("unapplied"),
    )


def payer_history(ledger: DataFrame, transactions: DataFrame) -> DataFrame:
    """(payer, student_id, payments): which students a payer has paid for before."""
    paid = live_events(ledger, event_type="allocation").select("transaction_id", "student_id")
    return paid.join(transactions.select("transaction_id", "payer"), "transaction_id").groupBy("payer", "student_id").agg(F.count("*").alias("payments"))


def projected_sums(ledger: DataFrame) -> DataFrame:
    """(kind, key, billed, paid, spent, credit) of every charge, transaction and holder: live events are read once and
    summed in one aggregation with partial sums. kind: charge, transaction or holder."""
    keys = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("key")) for kind, c in (("charge", "charge_id"), ("transaction", "transaction_id"), ("holder", "holder"))))
    live = live_events(ledger).select("event_type", "amount_minor", F.explode(keys).alias("x")).where("x.key is not null")
    grants = F.when(F.col("event_type") == "credit_grant", F.col("amount_minor")).when(F.col("event_type") == "credit_application", -F.col("amount_minor")).otherwise(0)
    return live.groupBy("x.kind", "x.key").agg(
        _sum_of("charge_created").alias("billed"), _sum_of("allocation", "credit_application").alias("paid"), _sum_of("allocation", "credit_grant").alias("spent"), F.sum(grants).alias("credit")
    )


#: What a posted event must say of itself.
PROVENANCE = ("actor", "source", "evidence_ref", "decision_path")


def verdicts(proposals: DataFrame, events: DataFrame, ledger: DataFrame, transactions: DataFrame, charges: DataFrame, students: DataFrame, holders: DataFrame) -> DataFrame:
    """(proposal_id, violations): the rules each proposal breaks as a whole, in the order of the checks; an empty array if none.

    proposals: (proposal_id, transaction_id); events: the proposed events, with proposal_id and the columns of ``PROVENANCE``;
    charges, students, holders: what is known, by identity. INV-03: an amount is missing or negative. INV-09: provenance is
    missing. INV-04: a charge, a student or the holder of a grant is unknown. INV-01: more than the transaction has left is
    allocated or granted from it. INV-05: a known charge is paid beyond what is billed for it; and again if a holder's
    applications exceed the holder's credit.
    """
    sums = cut(projected_sums(ledger))
    of = lambda kind, name, *columns: sums.where(F.col("kind") == kind).select(F.col("key").alias(name), *columns)
    key = lambda c: F.col(c).cast("string")
    told = lambda name, df, c: df.select(key(c).alias(name)).distinct().withColumn(f"{name}_known", F.lit(True))
    each = events.select(
        "proposal_id", "event_type", "amount_minor", key("transaction_id").alias("_t"), key("charge_id").alias("_c"), key("student_id").alias("_s"), key("holder").alias("_h"),
        F.greatest(F.lit(False), *(F.coalesce(F.col(c), F.lit("")) == "" for c in PROVENANCE)).alias("blank"),
    )
    each = each.join(told("_c", charges, "charge_id"), "_c", "left").join(told("_s", students, "student_id"), "_s", "left").join(told("_h", holders, "holder"), "_h", "left")
    unknown = (
        (F.col("_c").isNotNull() & F.col("_c_known").isNull())
        | (F.col("_s").isNotNull() & F.col("_s_known").isNull())
        | ((F.col("event_type") == "credit_grant") & ((F.coalesce("_h", F.lit("")) == "") | F.col("_h_known").isNull()))
    )
    each = cut(each.join(proposals.select("proposal_id", key("transaction_id").alias("_own")), "proposal_id").withColumn("unknown", unknown))
    spends = F.col("event_type").isin("allocation", "credit_grant") & (F.col("_t") == F.col("_own"))
    whole = each.groupBy("proposal_id").agg(
        F.max(F.col("amount_minor").isNull() | (F.col("amount_minor") < 0)).alias("amount"), F.max("blank").alias("blank"), F.max("unknown").alias("unknown"),
        F.coalesce(F.sum(F.when(spends, F.col("amount_minor"))), F.lit(0)).alias("spends"),
    )
    paid = each.where("_c is not null and event_type in ('allocation', 'credit_application')").groupBy("proposal_id", "_c").agg(F.sum("amount_minor").alias("add"), F.max("_c_known").alias("known"))
    paid = paid.where("known").join(of("charge", "_c", "billed", "paid"), "_c", "left")
    over = paid.groupBy("proposal_id").agg(F.max(F.coalesce("paid", F.lit(0)) + F.col("add") > F.coalesce("billed", F.lit(0))).alias("over"))
    applied = each.where("coalesce(_h, '') <> '' and event_type = 'credit_application'").groupBy("proposal_id", "_h").agg(F.sum("amount_minor").alias("add")).join(of("holder", "_h", "credit"), "_h", "left")
    short = applied.groupBy("proposal_id").agg(F.max(F.col("add") > F.coalesce("credit", F.lit(0))).alias("short"))
    money = transactions.select(key("transaction_id").alias("_own"), "amount_minor").join(of("transaction", "_own", "spent"), "_own", "left")
    money = money.select("_own", (F.col("amount_minor") - F.coalesce("spent", F.lit(0))).alias("left"))
    joined = proposals.select("proposal_id", key("transaction_id").alias("_own")).join(whole, "proposal_id").join(over, "proposal_id", "left").join(short, "proposal_id", "left").join(money, "_own", "left")
    beyond = F.col("_own").isNotNull() & (F.col("spends") > F.coalesce("left", F.lit(0)))
    broken = F.array(F.when(F.col("amount"), "INV-03"), F.when(F.col("blank"), "INV-09"), F.when(F.col("unknown"), "INV-04"), F.when(beyond, "INV-01"), F.when(F.col("over"), "INV-05"), F.when(F.col("short"), "INV-05"))
    return joined.select("proposal_id", F.array_compact(broken).alias("violations"))


def posted(events: DataFrame, judged: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """The events to append: those of proposals that break no rule, all of a proposal or none; blank provenance is
    filled from ``defaults``. judged: as from ``verdicts``."""
    good = judged.where(F.size("violations") == 0).select("proposal_id")
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)) for c, v in defaults.items()}
    return events.join(good, "proposal_id", "left_semi").withColumns(filled)


def credit_shortfalls(applications: DataFrame, ledger: DataFrame) -> DataFrame:
    """(holder, credit, wanted, missing) of holders whose wanted applications exceed their credit. applications: (holder, amount_minor)."""
    wanted = applications.where("holder is not null").groupBy("holder").agg(F.sum("amount_minor").alias("wanted"))
    joined = wanted.join(holder_credit(ledger), "holder", "left").select("holder", F.coalesce("credit", F.lit(0)).alias("credit"), "wanted")
    return joined.where("wanted > credit").withColumn("missing", F.col("wanted") - F.col("credit"))


def emptied_transactions(ledger: DataFrame) -> DataFrame:
    """(transaction_id) of payments of which something was reversed and nothing is used any more."""
    undone = ledger.where("event_type = 'reversal' and transaction_id is not null").select("transaction_id").distinct()
    used = live_events(ledger).where("event_type in ('allocation', 'credit_grant') and amount_minor > 0").select("transaction_id").distinct()
    return undone.join(used, "transaction_id", "left_anti")


def reversal_problems(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """(event_id, problem) of reversal requests that may not be carried out: the event is unknown, is itself a
    reversal, was reversed before, or is requested twice."""
    known = ledger.select(F.col("event_id").alias("_known"), F.col("event_type").alias("_kind"))
    undone = ledger.where("event_type = 'reversal'").select(F.col("reverses_event_id").alias("_undone")).distinct()
    asked = requests.groupBy("event_id").agg(F.count("*").alias("_times"))
    joined = asked.join(known, F.col("event_id") == F.col("_known"), "left").join(undone, F.col("event_id") == F.col("_undone"), "left")
    problem = (
        F.when(F.col("_known").isNull(), "unknown").when(F.col("_kind") == "reversal", "is_reversal").when(F.col("_undone").isNotNull(), "already_reversed").when(F.col("_times") > 1, "requested_twice")
    )
    return joined.select("event_id", problem.alias("problem")).where("problem is not null")


def reversals(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """The reversal events of requests without problems; they carry the amount and ids of what they undo."""
    good = requests.select("event_id").distinct().join(reversal_problems(requests, ledger).select("event_id"), "event_id", "left_anti")
    kept = [c for c in ledger.columns if c not in ("event_id", "event_type", "reverses_event_id")]
    return ledger.join(good, "event_id", "left_semi").select(
        F.xxhash64(F.lit("reversal"), "event_id").alias("event_id"), F.lit("reversal").alias("event_type"), *kept, F.col("event_id").alias("reverses_event_id")
    )


def audit_trail(ledger: DataFrame) -> DataFrame:
    """Every event with whether it was reversed."""
    undone = ledger.where("event_type = 'reversal'").select(F.col("reverses_event_id").alias("event_id")).distinct().withColumn("_undone", F.lit(True))
    return ledger.join(undone, "event_id", "left").select("event_id", "event_type", "amount_minor", F.coalesce("_undone", F.lit(False)).alias("is_reversed"))


def transaction_audit(ledger: DataFrame) -> DataFrame:
    """(about, event_id, event_type, amount_minor, is_reversed): of every transaction its events and the reversals of
    them, whichever transaction those name."""
    own = ledger.where("transaction_id is not null").select(F.col("transaction_id").alias("about"), "event_id", "event_type", "amount_minor")
    back = ledger.where("reverses_event_id is not null").select(F.col("event_id").alias("by"), "event_type", "amount_minor", F.col("reverses_event_id").alias("event_id"))
    others = back.join(own.select("about", "event_id"), "event_id").select("about", F.col("by").alias("event_id"), "event_type", "amount_minor")
    undone = back.select("event_id").distinct().withColumn("_undone", F.lit(True))
    every = own.unionByName(others).distinct().join(undone, "event_id", "left")
    return every.select("about", "event_id", "event_type", "amount_minor", F.coalesce("_undone", F.lit(False)).alias("is_reversed"))


def student_events(ledger: DataFrame) -> DataFrame:
    """(about, event_id, event_type, amount_minor): the events that name somebody as student or as holder, each once."""
    names = F.array_distinct(F.array_compact(F.array("student_id", "holder")))
    return ledger.select(F.explode(names).alias("about"), "event_id", "event_type", "amount_minor")
