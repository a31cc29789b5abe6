import pytest
from pyspark.sql import functions as F

from tallyspark.operators import allocation, components, datasets, evaluation, ingest, ledger, modelpath, relations, skew

EVENT = "event_id bigint, event_type string, transaction_id bigint, charge_id bigint, student_id bigint, holder bigint, amount_minor bigint, reverses_event_id bigint"


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        (1, "charge_created", None, 10, 1, None, 100, None), (2, "allocation", 7, 10, 1, None, 60, None), (3, "allocation", 8, 10, 1, None, 30, None), (4, "reversal", 8, 10, 1, None, 30, 3),
        (5, "credit_grant", 7, None, None, 1, 20, None), (6, "charge_created", None, 11, 2, None, 50, None),
    ]
    return spark.createDataFrame(rows, EVENT)


def test_projections_are_net_of_reversals(spark, log):
    assert {(r.charge_id, r.billed, r.paid, r.balance) for r in ledger.charge_balances(log).collect()} == {(10, 100, 60, 40), (11, 50, 0, 50)}
    txns = spark.createDataFrame([(7, 100, 1), (8, 30, 1), (9, 5, 2)], "transaction_id bigint, amount_minor bigint, payer bigint")
    assert {(r.transaction_id, r.used, r.unapplied) for r in ledger.transaction_use(log, txns).collect()} == {(7, 80, 20), (8, 0, 30), (9, 0, 5)}
    students = spark.createDataFrame([(1,), (2,), (3,)], "student_id bigint")
    assert {(r.student_id, r.status) for r in ledger.student_status(log, students).collect()} == {(1, "part_paid"), (2, "outstanding"), (3, "outstanding")}
    assert ledger.payer_history(log, txns).collect()[0].payments == 1


def test_empty_log(spark, log):
    assert ledger.charge_balances(log.limit(0)).count() == 0
    assert ledger.totals(log.limit(0), spark.createDataFrame([], "transaction_id bigint, amount_minor bigint")).first().received == 0


PROPOSED = "proposal_id int, event_id int, event_type string, transaction_id bigint, charge_id bigint, student_id bigint, holder bigint, amount_minor bigint, actor string, source string, evidence_ref string, decision_path string"


def judged(spark, log, *events, own=9):
    full = [(p, k, *e, "a", "s", "e", "d") if len(e) == 6 else (p, k, *e) for k, (p, *e) in enumerate(events)]
    make = spark.createDataFrame
    proposals = make([(p, own) for p in sorted({e[0] for e in events})], "proposal_id int, transaction_id bigint")
    txns = make([(7, 100), (9, 15)], "transaction_id bigint, amount_minor bigint")
    charges, students, holders = make([(10,), (11,), (12,)], "charge_id bigint"), make([(1,), (2,)], "student_id bigint"), make([(1,), (2,), (50,)], "holder bigint")
    out = ledger.verdicts(proposals, make(full, PROPOSED), log, txns, charges, students, holders)
    return {r.proposal_id: r.violations for r in out.collect()}


def test_verdicts_on_whole_proposals(spark, log):
    got = judged(
        spark, log,
        (1, "allocation", 9, 11, 2, None, 10), (1, "allocation", 9, 11, 2, None, 10),  # together beyond the payment
        (2, "allocation", 9, 11, 2, None, 15),
        (3, "allocation", 9, 99, 2, None, 1), (4, "allocation", 9, 11, 77, None, 1), (5, "credit_grant", 9, None, None, 60, 1), (6, "credit_grant", 9, None, None, 50, 1), (7, "credit_grant", 9, None, None, None, 1),
        (8, "allocation", 9, 11, 2, None, -1), (9, "allocation", 9, 11, 2, None, 1, "a", "s", "", "d"),
        (10, "credit_application", None, 11, 2, 1, 51), (11, "credit_application", None, 11, 2, 1, 21), (12, "allocation", 9, 12, 2, None, 1), (13, "allocation", 7, 11, 2, None, 50),
        (14, "allocation", 9, 11, 2, None, None),
    )
    assert got == {
        1: ["INV-01"], 2: [], 3: ["INV-04"], 4: ["INV-04"], 5: ["INV-04"], 6: [], 7: ["INV-04"], 8: ["INV-03"], 9: ["INV-09"], 10: ["INV-05", "INV-05"], 11: ["INV-05"], 12: ["INV-05"],
        13: [], 14: ["INV-03"],
    }


def test_posting_is_all_or_nothing_and_fills_provenance(spark, log):
    events = spark.createDataFrame([(1, 1, "allocation", 9, 11, 2, None, 5, "", None, "x", "d"), (2, 2, "allocation", 9, 11, 2, None, 5, "a", "s", "e", "d"), (2, 3, "allocation", 9, 99, 2, None, 5, "a", "s", "e", "d")], PROPOSED)
    verdicts = spark.createDataFrame([(1, []), (2, ["INV-04"])], "proposal_id int, violations array<string>")
    assert [(r.event_id, r.actor, r.source) for r in ledger.posted(events, verdicts, {"actor": "engine", "source": "batch"}).collect()] == [(1, "engine", "batch")]
    assert [(r.holder, r.missing) for r in ledger.credit_shortfalls(spark.createDataFrame([(1, 15), (1, 10), (2, 0)], "holder bigint, amount_minor bigint"), log).collect()] == [(1, 5)]
    assert [r.transaction_id for r in ledger.emptied_transactions(log).collect()] == [8]
    assert {(r.about, r.event_id, r.is_reversed) for r in ledger.transaction_audit(log).collect()} == {(7, 2, False), (7, 5, False), (8, 3, True), (8, 4, False)}
    assert {(r.about, r.event_id) for r in ledger.student_events(log).where("about = 1").collect()} == {(1, k) for k in range(1, 6)}


def test_reversals_are_guarded(spark, log):
    asked = spark.createDataFrame([(2,), (3,), (4,), (5,), (5,), (77,)], "event_id bigint")
    assert {(r.event_id, r.problem) for r in ledger.reversal_problems(asked, log).collect()} == {(3, "already_reversed"), (4, "is_reversal"), (5, "requested_twice"), (77, "unknown")}
    made = ledger.reversals(asked, log).collect()
    assert [(r.reverses_event_id, r.amount_minor, r.event_type) for r in made] == [(2, 60, "reversal")]


def test_waterfall_and_surplus(spark):
    balances = spark.createDataFrame([(1, 1, 2, 50), (1, 2, 1, 30), (1, 3, 1, 0), (2, 4, 1, 10)], "student_id int, charge_id int, priority int, balance bigint")
    amounts = spark.createDataFrame([(1, 60), (2, 25)], "student_id int, amount bigint")
    assert {(r.charge_id, r.take) for r in allocation.waterfall(balances, amounts).collect()} == {(2, 30), (1, 30), (4, 10)}
    assert [(r.student_id, r.surplus) for r in allocation.surplus(balances, amounts).collect()] == [(2, 15)]


def test_posting_skips_what_does_not_fit(spark):
    limits = spark.createDataFrame([(1, 100)], "key int, limit bigint")
    payments = spark.createDataFrame([(1, 1, 1, 60), (1, 2, 2, 50), (1, 3, 3, 40)], "key int, at int, id int, amount bigint")
    r = allocation.post_in_order(limits, payments).first()
    assert (r.remaining, r.posted, r.skipped) == (0, 2, 1)


def test_statement_outcomes(spark):
    schema = "file string, row_no bigint, reference string, date string, amount string, payer string, narration string, direction string"
    rows = [
        ("a", 1, "R1", "2025-01-01", "10", "p", "x", "credit"), ("a", 2, "r-1", "2025-01-01", "10", "p", "x", None), ("a", 3, None, "2025-01-01", "5", "p", "y", ""), ("a", 4, None, "2025-01-01", "5", "p", "y", "credit"),
        ("b", 1, "", "2025-01-01", "5", "p", "y", "CREDIT"), ("b", 2, "R2", "2025-01-01", "abc", "p", "x", "credit"), ("b", 3, "R3", "2025-01-01", "abc", "p", "x", "debit"), ("b", 4, "R9", "d", "1", "p", "x", "credit"),
    ]
    df = spark.createDataFrame(rows, schema)
    keyed = ingest.keyed_rows(df)
    accepted = keyed.where("ref = 'R9'").select("dedup_hash", F.lit(None).cast("string").alias("posted_at"), "amount_minor", "payer", "narration")
    got = {(r.file, r.row_no): r.outcome for r in ingest.statement_outcomes(df, accepted).collect()}
    assert got == {("a", 1): "accepted", ("a", 2): "duplicate", ("a", 3): "accepted", ("a", 4): "near_duplicate", ("b", 1): "near_duplicate", ("b", 2): "rejected", ("b", 3): "skipped", ("b", 4): "duplicate"}
    summary = {r.file: (r.accepted, r.rejected, r.duplicate, r.skipped) for r in ingest.batch_summary(ingest.statement_outcomes(df)).collect()}
    assert summary == {"a": (3, 0, 1, 0), "b": (2, 1, 0, 1)}
    # stored content makes a near duplicate, whatever the title and spelling of the payer and the time of day
    old = spark.createDataFrame([("h", "2025-01-01T10:00", 500, "Mallam P.", "Y")], "dedup_hash string, posted_at string, amount_minor bigint, payer string, narration string")
    assert {(r.file, r.row_no): r.outcome for r in ingest.statement_outcomes(df, old).collect()}[("a", 3)] == "near_duplicate"
    one = {r.dedup_hash for r in ingest.keyed_rows(df.where("file = 'a' and row_no = 3").withColumn("payer", F.lit("Mr P"))).collect()}
    assert one == {r.dedup_hash for r in keyed.where("file = 'a' and row_no = 3").collect()}
    assert [(r.file, r.row_no, r.reason) for r in ingest.import_errors(df, ingest.statement_outcomes(df)).collect()] == [("b", 2, "no amount")]


def test_registers_mapping_and_states(spark):
    rows = spark.createDataFrame([(1, "S1", "Dr Ada", "P1", "T", "a;b"), (2, "S1", "Ada again", None, None, None), (3, " ", "x", None, None, None), (4, "S2", "Bo", None, None, None)], "row_no int, student_id string, name string, class string, term_id string, aliases string")
    existing = spark.createDataFrame([("S2",)], "student_id string")
    assert [r.outcome for r in ingest.student_register(rows, existing).orderBy("row_no").collect()] == ["accepted", "duplicate", "rejected", "duplicate"]
    m = ingest.mapped(spark.createDataFrame([("x", None)], "a string, b string"), {"payer": "a", "ref": "b", "no": "c"}).first()
    assert (m.payer, m.ref, m.no, m.a) == ("x", "", "", "x")
    states = spark.createDataFrame([("t", 1, "new"), ("t", 2, "auto")], "id string, seq int, state string")
    assert ingest.latest_state(states, "id", "seq", "state").first().state == "auto"
    assert ingest.first_wins(rows.select("student_id", "row_no"), existing, ["student_id"], "row_no").count() == 2
    fees = spark.createDataFrame([("S", "F", "T", 1, "1,000", None), ("S", "F", "T", 2, "5", "1"), ("S", "G", "T", 1, "5", "x")], "student_id string, fee_id string, term_id string, row_no int, amount string, priority string")
    assert sorted((r.outcome, r.priority or 0) for r in ingest.fee_register(fees).collect()) == [("accepted", 1), ("rejected", 0), ("rejected", 0)]
    assert sorted((r.outcome, r.priority) for r in ingest.fee_register(fees.drop("priority")).collect()) == [("accepted", 100), ("accepted", 100), ("duplicate", 100)]
    terms = spark.createDataFrame([(1, " T1 ", "s"), (2, "T1", "s"), (3, "T2", " "), (4, "T3", "s")], "row_no int, term_id string, session string")
    got = ingest.setup_register(terms, ("term_id",), ("term_id", "session"), spark.createDataFrame([("T3",)], "term_id string"))
    assert [(r.outcome, r.error) for r in got.orderBy("row_no").collect()] == [("accepted", None), ("duplicate", None), ("rejected", "term_id/session"), ("duplicate", None)]


def test_phone_and_amount_and_alike(spark):
    texts = spark.createDataFrame([(1, "call 0803123"), (2, None), (3, "12")], "text_id int, text string")
    phones = spark.createDataFrame([("a", "123"), ("b", ""), ("c", None), ("d", "9999")], "phone_id string, suffix string")
    assert [(r.text_id, r.phone_id) for r in relations.phone_matches(texts, phones).collect()] == [(1, "a")]
    assert relations.phone_matches(texts, phones.limit(0)).count() == 0
    pays = spark.createDataFrame([(1, 50), (2, 60)], "payment_id int, amount bigint")
    owed = spark.createDataFrame([("s", 50), ("s", 50), ("t", 50), ("u", 0)], "account string, balance bigint")
    assert [(r.payment_id, r.matching) for r in relations.amount_matches(pays, owed).collect()] == [(1, 2)]
    names = spark.createDataFrame([("chinedu",), ("bola",)], "a string")
    other = spark.createDataFrame([("chinedo",), ("bisi",)], "b string")
    assert [(r.a, r.b) for r in relations.alike_names(names, other).collect()] == [("chinedu", "chinedo")]


@pytest.mark.parametrize("edges, roots", [([], {}), ([(1, 1)], {}), ([(k, k + 1) for k in range(40)], {k: 0 for k in range(1, 41)}), ([(5, 9), (9, 5), (7, 8), (8, 6)], {9: 5, 7: 6, 8: 6}), ([(0, k) for k in range(1, 60)] + [(100, 101)], {**{k: 0 for k in range(1, 60)}, 101: 100})])
def test_components(spark, edges, roots):
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    assert {r.node: r.root for r in components.connected_components(df).collect()} == roots


def test_links_by_key_never_pair_a_hot_key(spark):
    members = spark.range(3000).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 10, "few").alias("k"))
    links = components.links_by_key(members, "n", "k")
    assert links.count() == 999 + 5 and links.where("v not in (0, 1)").count() == 0


def test_join_summaries_handles_hot_and_cold_keys(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 2500, 0).otherwise(F.col("id")).alias("k"))
    groups = rows.groupBy("k").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    out = skew.join_summaries(rows, groups, ["k"], "n")
    assert out.count() == 5000 and out.where("k = 0 and least <> 0").count() == 0
    assert skew.join_summaries(rows, groups.limit(0), ["k"], "n").count() == 0


def test_families_leaks_and_seeded_choice(spark):
    cases = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, None, "x"), (4, None, None)], "case_no bigint, g string, r string")
    assert {r.case_no: r.family for r in datasets.families(cases, "g", "r").collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert [(r.family, r.splits) for r in datasets.leaks(spark.createDataFrame([("f", "a"), ("f", "b"), ("g", "a")], "family string, split string")).collect()] == [("f", 2)]
    docs = spark.createDataFrame([(1, "A  b"), (2, "a B"), (3, None), (4, "")], "id int, t string")
    assert datasets.first_of_digest(docs, "t", "id", "s").count() == 2 and datasets.first_of_digest(docs, "t", "id", "s", 1).count() == 1
    chats = spark.createDataFrame([(1, "q", None, "prompter", "en", "x" * 30, 0, False), (2, "a", "q", "assistant", "en", "y" * 30, 0, False), (3, "b", "q", "assistant", "en", "z" * 30, 1, False), (4, "q", None, "prompter", "en", "w" * 30, 0, False)], "row_no int, message_id string, parent_id string, role string, lang string, text string, rank int, deleted boolean")
    assert [(r.question[0], r.answer[0]) for r in datasets.answer_pairs(chats).collect()] == [("w", "y")]


def test_evaluation_measures(spark):
    rec = spark.createDataFrame([("en", True, None), ("en", None, None), ("yo", False, True)], "group string, a boolean, b boolean")
    got = {r.group: (r.a, r.b) for r in evaluation.metric_card(rec, "a", "b").collect()}
    assert got == {None: (0.5, 1.0), "en": (1.0, None), "yo": (0.0, 1.0)}
    g = evaluation.gates(spark.createDataFrame([(True, False, None)], "auto boolean, correct boolean, duplicate_blocked boolean")).first()
    assert (g.failed, g.untried) == ("wrong_auto", "duplicate_blocked")
    rows = spark.createDataFrame([(float(k), k > 50) for k in range(100)], "x double, y boolean").withColumn("x", F.col("x") / 100)
    bias, w = evaluation.fit_logistic(rows, ["x"], "y", steps=3000)
    right = rows.withColumn("p", evaluation.score(bias, {"x": w[0]})).where("(p >= 0.5) = y").count()
    assert right >= 90
    cut, possible = evaluation.threshold(spark.createDataFrame([(0.95, False), (0.97, True)], "score double, label boolean"))
    assert 0.95 < cut < 0.951 and possible
    assert evaluation.threshold(spark.createDataFrame([(1.0, False)], "score double, label boolean"))[1] is False
    packet = evaluation.blind_packet(spark.createDataFrame([("a",), ("b",)], "output_id string"), "s")
    assert {r.review_id for r in packet.collect()} == {"blind-0001", "blind-0002"}


def test_model_path(spark):
    def backend():
        def ask(prompt):
            if prompt == "fail":
                raise ConnectionError("down")
            return prompt.upper()

        return ask

    assert modelpath.first_json_object('noise {"a": 1} {"b": {"c": 2}}', "b") == {"b": {"c": 2}} and modelpath.first_json_object("{oops", "a") is None and modelpath.first_json_object(None) is None
    df = spark.createDataFrame([("x" * 3000, "short"), ("tiny", "t")], "long string, short string")
    assert [r.p for r in df.select(modelpath.within_budget([F.col("long"), F.col("short")], 100).alias("p")).collect()] == ["short", "tiny"]
    calls = modelpath.call_model(spark.createDataFrame([(1, "ok"), (2, "fail")], "id int, prompt string"), backend)
    assert {(r.id, r.output, r.failure) for r in calls.collect()} == {(1, "OK", None), (2, None, "transport")}
    raw = spark.createDataFrame([('{"transaction_id":"T","recommended_action":"propose","explanation":"e","candidate_allocations":[{"student_id":"S","amount_minor":true,"reason_codes":[]}]}',), ("[1]",), (None,)], "raw string")
    got = [r.p for r in raw.select(modelpath.output_problem(F.col("raw"), F.lit("T"), F.array(F.lit("S")), ("A",), ("propose",)).alias("p")).collect()]
    assert got == ["bad_amount", "invalid_json", "invalid_json"]


def test_reversal_requests_meet_every_problem(spark, folder):
    from tallyspark.plans import catalogue

    found = {r.problem for r in catalogue.QUERIES["reversal_requests"](spark, folder).select("problem").distinct().collect()}
    assert found == {"unknown", "is_reversal", "already_reversed", "requested_twice"}


def test_alike_names_lose_no_pair(spark):
    import random

    from tallyspark.functions.similarity import winkler
    from tallyspark.operators import relations

    rng = random.Random(5)
    texts = ["kevin adewale", "cevin adewale", "ab", "ba", "a", "", "ọmọ", "omo"] + ["".join(rng.choices("abcd ", k=rng.randint(1, 9))) for _ in range(300)]
    left, right = spark.createDataFrame([(x,) for x in texts + [None]], "a string"), spark.createDataFrame([(x,) for x in texts + [None]], "b string")
    got = {(r.a, r.b) for r in relations.alike_names(left, right).collect()}
    assert got == {(x, y) for x in texts for y in texts if winkler(x, y) >= relations.ALIKE} and ("kevin adewale", "cevin adewale") in got
