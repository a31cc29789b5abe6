"""Deciding on payments in one pass: distribution over charges, a model's answers, final states, reviews, and evaluation.

Every function works row by row on what the candidate operators give; nothing is moved but where a payment's
candidates are gathered, of which there are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import token_estimate
from tallyspark.operators.modelpath import PROMPT_BUDGET

#: Why a payment is in its state.
OVERPAYMENT, UNAVAILABLE, INVALID, BUDGET, RANKED = "OVERPAYMENT_REQUIRES_REVIEW", "INFERENCE_UNAVAILABLE", "SCHEMA_INVALID", "PROMPT_BUDGET_EXCEEDED", "MODEL_RANKED"
_TAKES = "struct<left:bigint,takes:array<struct<charge_id:string,amount:bigint>>>"


def distributed(balances: Column, amount: Column) -> Column:
    """(left, takes): an amount fills the positive balances in their order; what each charge takes, and what is left."""
    none = F.struct(F.coalesce(amount, F.lit(0)).cast("bigint").alias("left"), F.array().cast("array<struct<charge_id:string,amount:bigint>>").alias("takes"))

    def step(at: Column, b: Column) -> Column:
        take = F.greatest(F.lit(0).cast("bigint"), F.least(at["left"], b["balance"]))
        return F.struct((at["left"] - take).alias("left"), F.when(take > 0, F.concat(at["takes"], F.array(F.struct(b["charge_id"].alias("charge_id"), take.alias("amount"))))).otherwise(at["takes"]).alias("takes")).cast(_TAKES)

    return F.aggregate(F.coalesce(balances, F.array().cast("array<struct<charge_id:string,balance:bigint>>")), none, step)


def triples(student: Column, takes: Column, credit: Column) -> Column:
    """The postings of one student as texts 'student|charge|amount'; a credit has no charge."""
    each = F.transform(takes["takes"], lambda t: F.concat_ws("|", student, t["charge_id"], t["amount"].cast("string")))
    return F.concat(each, F.when(credit & (takes["left"] > 0), F.array(F.concat(student, F.lit("||"), takes["left"].cast("string")))).otherwise(F.array().cast("array<string>")))


def candidate_line(c: Column, aliases: bool, history: bool) -> Column:
    """How a candidate stands in a prompt. Aliases stay where one was evidence; so does the mark of a known payer."""
    mark = F.when(F.lit(history), F.concat(F.lit("prior_payer="), F.initcap(c["prior"].cast("string")))).when(c["prior"], F.lit("prior_payer=true"))
    parts = F.array(
        F.concat(F.lit("id="), c["student_id"], F.lit(" name="), F.coalesce(c["name"], F.lit(""))),
        F.when((F.size(c["aliases"]) > 0) & (F.lit(aliases) | c["alias_told"]), F.concat(F.lit("aliases="), F.array_join(c["aliases"], ","))),
        F.when(F.size(c["guardians"]) > 0, F.concat(F.lit("guardian="), F.array_join(c["guardians"], ","))),
        F.when(F.size(c["balances"]) > 0, F.concat(F.lit("outstanding="), F.array_join(F.transform(c["balances"], lambda b: F.concat_ws(":", b["charge_id"], b["balance"].cast("string"))), ","))),
        mark,
    )
    return F.concat(F.lit("  - "), F.array_join(F.array_compact(parts), " "))


def prompt_ladder(head: Column, candidates: Column, budget: int = PROMPT_BUDGET, least: int = 3) -> Column:
    """(prompt, kept): the fullest text within the budget. First all, then without history, then without aliases that
    are no evidence, then without the lowest candidates down to ``least``; null and 0 if nothing fits."""
    text = lambda n, aliases, history: F.concat_ws("\n", head, F.transform(F.slice(candidates, 1, n), lambda c: candidate_line(c, aliases, history)))
    most = F.size(candidates)
    steps = [(text(5, True, True), most), (text(5, True, False), most), (text(5, False, False), most)]
    steps += [(F.when(most > k, text(k, False, False)), F.lit(k)) for k in (4, 3) if k >= least]
    return F.coalesce(*(F.when(token_estimate(t) <= budget, F.struct(t.alias("prompt"), n.alias("kept"))) for t, n in steps), F.struct(F.lit(None).cast("string").alias("prompt"), F.lit(0).alias("kept")))


def grammar(transaction: Column, students: Column, codes: tuple[str, ...]) -> Column:
    """The choices an answer is restricted to, as grammar rules: the transaction's id, the students that are left and the
    reason codes, each list bounded in length."""
    quoted = lambda c: F.concat(F.lit('"\\"'), c, F.lit('\\""'))
    either = F.array_join(F.transform(students, quoted), " | ")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("transaction ::= "), quoted(transaction)),
        F.concat(F.lit("student ::= "), F.when(F.size(students) > 0, either).otherwise(F.lit('"\\"\\""'))),
        F.concat(F.lit("allocations ::= "), F.when(F.size(students) > 0, F.concat(F.lit("allocation ("), F.lit('"," allocation){0,'), (F.size(students) - 1).cast("string"), F.lit("}"))).otherwise(F.lit(""))),
        F.lit("code ::= " + " | ".join(f'"\\"{c}\\""' for c in codes)),
    )


def final_states(payments: DataFrame) -> DataFrame:
    """Adds ``state`` and ``reason`` of every payment, in the order in which a payment is decided on.

    payments: used_minor, state_before, amount_minor, exact_student, exact_open (the positive balances of that student), candidates
    (their number), failure (null, prompt_budget, transport or schema), action (auto, review or unmatched by confidence),
    dry_ok, shed, allocated_minor, remainder.
    """
    exact = F.col("exact_student").isNotNull()
    safe = (F.col("action") == "auto") & F.col("dry_ok") & ~F.col("shed") & (F.col("allocated_minor") == F.col("amount_minor")) & (F.col("remainder") == 0)
    cases = (
        (F.coalesce("used_minor", F.lit(0)) > 0, F.col("state_before"), F.lit(None).cast("string")),
        (exact & (F.col("amount_minor") > F.col("exact_open")), F.lit("review"), F.lit(OVERPAYMENT)),
        (exact, F.lit("auto"), F.lit("EXACT_STUDENT_ID")),
        (F.col("candidates") == 0, F.lit("unmatched"), F.lit(None).cast("string")),
        (F.col("failure") == "prompt_budget", F.lit("review"), F.lit(BUDGET)),
        (F.col("failure") == "transport", F.lit("review"), F.lit(UNAVAILABLE)),
        (F.col("failure") == "schema", F.lit("review"), F.lit(INVALID)),
        (F.col("action") == "unmatched", F.lit("unmatched"), F.lit(RANKED)),
        (F.coalesce(safe, F.lit(False)), F.lit("auto"), F.lit(RANKED)),
    )
    state, reason = F, F
    for test, s, r in cases:
        state, reason = state.when(test, s), reason.when(test, r)
    return payments.withColumns({"state": state.otherwise(F.lit("review")), "reason": reason.otherwise(F.lit(RANKED))})


def reviewed(decisions: DataFrame) -> DataFrame:
    """(proposal_id, outcome, allocations, allocated_minor, unapplied_minor, credit_minor) of reviewers' decisions on proposals.

    decisions: (proposal_id, status, decision, amount_minor, edits array<struct<student_id, amount_minor>>, allowed array, known
    array of students with their balances array<struct<student_id, balances>>, credit_holder, holders array). The first rule that an
    approval breaks is its outcome; it then posts nothing. Amounts of one student are added up, zero amounts dropped; they
    fill the student's charges in order; what is left stays unapplied, or becomes the named holder's credit as a whole.
    """
    edits = F.coalesce("edits", F.array().cast("array<struct<student_id:string,amount_minor:bigint>>"))
    bad = F.exists(edits, lambda e: (F.trim(F.coalesce(e["student_id"], F.lit(""))) == "") | e["amount_minor"].isNull() | (e["amount_minor"] < 0))
    named = F.array_sort(F.array_distinct(F.transform(F.filter(edits, lambda e: e["amount_minor"] > 0), lambda e: F.trim(e["student_id"]))))
    zero = F.lit(0).cast("bigint")
    total = lambda s: F.aggregate(F.filter(edits, lambda e: F.trim(e["student_id"]) == s), zero, lambda a, e: a + F.coalesce(e["amount_minor"], zero))
    combined = F.transform(named, lambda s: F.struct(s.alias("student_id"), total(s).alias("amount_minor")))
    out = decisions.withColumns({"_c": combined, "_bad": bad})
    whole = F.aggregate("_c", zero, lambda a, c: a + c["amount_minor"])
    stranger = F.col("credit_holder").isNotNull() & ~F.array_contains("holders", F.col("credit_holder"))
    alien = F.size(F.array_except(F.transform("_c", lambda c: c["student_id"]), F.col("allowed"))) > 0
    outcome = (
        F.when(F.col("status") != "pending", "PROPOSAL_ALREADY_DECIDED").when(F.col("decision") == "reject", "rejected").when(F.col("_bad"), "INV-03").when(alien, "INV-04")
        .when(whole > F.col("amount_minor"), "INV-01").when(stranger, "INV-04").otherwise("approved")
    )
    open_ = lambda s: F.get(F.filter("known", lambda k: k["student_id"] == s), F.lit(0))["balances"]
    takes = F.transform("_c", lambda c: triples(c["student_id"], distributed(open_(c["student_id"]), c["amount_minor"]), F.lit(False)))
    out = out.withColumn("outcome", outcome).withColumn("allocations", F.when(F.col("outcome") == "approved", F.array_sort(F.flatten(takes))).otherwise(F.array().cast("array<string>")))
    posted = F.aggregate("allocations", zero, lambda a, t: a + F.substring_index(t, "|", -1).cast("bigint"))
    left = F.when(F.col("outcome").isin("approved", "rejected"), F.col("amount_minor") - posted)
    credit = F.when((F.col("outcome") == "approved") & F.col("credit_holder").isNotNull(), left).otherwise(zero)
    return out.select("proposal_id", "outcome", "allocations", posted.alias("allocated_minor"), (left - credit).alias("unapplied_minor"), credit.alias("credit_minor"))
