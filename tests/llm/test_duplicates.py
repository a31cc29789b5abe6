import random
import re
from collections import defaultdict

import pytest

from tallyspark.llm import format_duplicates, grouped_split, history, mixing

BANK = "row_id bigint, reference string, date string, amount string, payer string, narration string, direction string"


def test_format_copies(spark):
    rows = [
        (5, "nip/1", "d", "10", "Ada OBI", "fees, JSS2", "Credit "), (2, "NIP1", "d", "10", "obi", "jss2 ada FEES", "credit"), (3, "NIP1", "d", "10.0", "obi", "jss2 ada fees", "credit"), (4, "NIP1", "d", "10", "obi", "jss2 ada ada fees", "credit"),
        (6, None, None, None, None, None, None), (7, "", "", "", "", " !", ""), (8, "-", "", "", "", "", ""), (9, "NIP1", "d", "10", "ada obi jss2 fees", None, "CREDIT"),
    ]
    df = spark.createDataFrame(rows, BANK)
    assert sorted((r.first, r.copy) for r in format_duplicates.copies(df).collect()) == [(2, 5), (2, 9), (6, 7), (6, 8)]
    assert {(r.first, r.copies) for r in format_duplicates.records(df).collect()} == {(2, 3), (3, 1), (4, 1), (6, 3)}
    assert format_duplicates.copies(df.limit(0)).count() == 0


def test_format_copies_against_brute_force_with_a_hot_record(spark):
    rng = random.Random(3)
    rows = []
    for k in range(3000):
        words = ["ada", "obi", "fees"] if k % 3 == 0 else rng.choices(["ada", "bo", "fees", "x1", "ọmọ"], k=rng.randint(0, 3))
        rng.shuffle(words)
        text = rng.choice([" ", ", ", "-"]).join(rng.choice([w, w.upper(), w.title()]) for w in words)
        rows.append((k, rng.choice(["R1", "r-1", None]) if k % 3 else "R1", "d", "1", rng.choice([None, "", text]), text, rng.choice(["credit", "CREDIT "])))
    groups = defaultdict(list)
    for k, ref, d, a, p, n, di in rows:
        key = (re.sub(r"\W", "", (ref or "").lower()), d, a, di.strip().lower(), tuple(sorted(re.findall(r"[^\W_]+", ((p or "") + " " + n).lower()))))
        groups[key].append(k)
    expected = {(g[0], x) for g in groups.values() for x in g[1:]}
    assert {(r.first, r.copy) for r in format_duplicates.copies(spark.createDataFrame(rows, BANK)).collect()} == expected


TX = "row_id bigint, source string, reference string, raw_reference string, posted_at string, payer_name string, narration string, amount_minor bigint, batch_id string, t string"
RULES = {"f": ("Africa/Lagos", True)}


def payments(spark, *rows):
    df = spark.createDataFrame([(*r, "b", "clash") for r in rows], TX)
    return {(r.first, r.row_id) for r in history.payments(df, RULES).collect()}


def row(n, ref, at, payer="Ada Obi", text="school fees for Chidi Obi", amount=100):
    return (n, "f", ref, ref, at, payer, text, amount)


def test_payments(spark):
    assert payments(spark, row(1, "NIP12345678901", "2025-01-01 10:00"), row(2, "nip-123456/78901", "2025-01-02")) == {(1, 2)}
    assert payments(spark, row(1, "NIP12345678901", "2025-01-01 10:00"), row(2, "NIP12345678091", "2025-01-01 10:00", "A. Obi", "SCHOOL FEES Chidi Obi")) == {(1, 2)}  # exchanged digits
    assert payments(spark, row(1, "NIP12345678901", "2025-01-01 10:00"), row(2, "NIP12345678902", "2025-01-01 10:01", text="school fees for Ngozi Obi")) == set()  # a sibling
    assert payments(spark, row(1, "NIP12345678901", "2025-01-01 10:00"), row(2, "NIP99999000001", "2025-01-02 10:00")) == set()  # a later instalment
    assert payments(spark, row(1, None, "2025-01-01 10:00:30"), row(2, None, "01/01/2025 10:00"), row(3, None, "2025-01-01 10:00:30", "Uche Eze")) == {(1, 2)}
    assert payments(spark, row(1, "NIP12345678901", "2025-01-01 10:00"), row(2, "NIP12345678901", "2025-01-09 10:00")) == set()  # too late
    assert payments(spark, row(1, "NIP12345678901", None), row(2, "NIP12345678901", "pending"), row(3, None, None), row(4, None, None)) == {(1, 2), (3, 4)}
    assert payments(spark, row(1, "NIP12345678901", "2025-01-01", amount=None), row(2, "NIP12345678901", "2025-01-01", amount=None)) == set()
    assert payments(spark, row(1, "NIP12345678901", "2025-01-01 10:00", None, None), row(2, "NIP12345678901", "2025-01-01 10:00", "", "x" * 50_000)) == {(1, 2)}
    assert payments(spark) == set()


def test_hot_payment_is_one_entry(spark):
    rows = [row(k, "NIP12345678901", "2025-01-01 10:00") for k in range(2000)]
    assert payments(spark, *rows) == {(0, k) for k in range(1, 2000)}


@pytest.mark.parametrize("n", range(6, 14))
def test_probes_meet_every_string_within_two_edits(spark, n):
    rng = random.Random(n)
    base = ["".join(rng.choices("0123456789", k=n)) for _ in range(30)]
    rows, pairs = [], []
    for k, d in enumerate(base):
        for m in range(6):
            x = list(d)
            for _ in range(rng.randint(1, 2)):
                at = rng.randrange(len(x))
                kind = rng.choice("sid")
                if kind == "s":
                    x[at] = rng.choice("0123456789")
                elif kind == "i":
                    x.insert(at, rng.choice("0123456789"))
                elif len(x) > 6:
                    x.pop(at)
            pairs.append((2 * len(pairs), 2 * len(pairs) + 1))
            rows += [(pairs[-1][0], d, len(pairs)), (pairs[-1][1], "".join(x), len(pairs))]
    df = spark.createDataFrame([(i, d, a, 1_700_000_000_000_000, False, []) for i, d, a in rows], "row_id bigint, digits string, amount bigint, t bigint, date_only boolean, words array<string>")
    for longer in (True, False):
        met = {(r.a, r.b) for r in history.candidates(history.index_entries(df), history.probe_entries(df, longer)).collect()}
        assert set(pairs) <= met


def test_batches_against_history(spark, tmp_path):
    store = history.AcceptedHistory(spark, str(tmp_path), RULES)
    make = lambda *rows: spark.createDataFrame([(*r, "b", "c") for r in rows], TX)
    first = make(row(1, "NIP12345678901", "2025-01-01 10:00"), row(2, None, "2025-01-05 10:00", text="fees Ngozi Obi"))
    assert store.match(first).count() == 0
    store.append(first)
    second = make(row(3, "NIP1234567890", "2025-01-01 12:00"), row(4, "WEB55555555555", "2025-01-05 10:00", text="fees Ngozi Obi"), row(5, "WEB55555555555", "2025-01-05 10:00", text="fees Ngozi Obi"))
    assert {(r.a, r.b) for r in store.match(second).collect()} == {(1, 3), (2, 4), (2, 5), (4, 5)}
    store.append(second)
    assert spark.read.parquet(store.rows_path).count() == 5


def test_batch_after_batch_equals_all_at_once_and_reads_its_parts_only(spark, tmp_path):
    import shutil

    rng = random.Random(5)
    rows = []
    for k in range(240):
        day, name = rng.choice((1, 2, 3, 150, 151, 300)), rng.choice(("Ngozi Obi", "Chidi Eze", "Musa Sani"))
        when = None if k % 17 == 0 else f"2025-{1 + day // 31:02}-{1 + day % 28:02} {rng.randint(8, 9):02}:00"
        ref = None if k % 5 == 0 else f"NIP{rng.choice((12345678901, 12345678902, 77345678901, 55555555555))}"
        rows.append(row(k, ref, when, text=f"fees {name}"))
    make = lambda some: spark.createDataFrame([(*r, "b", "c") for r in some], TX)
    store, pairs = history.AcceptedHistory(spark, str(tmp_path), RULES), set()
    for k in range(0, 240, 80):
        batch = make(rows[k : k + 80])
        pairs |= {(r.a, r.b) for r in store.match(batch).collect()}
        store.append(batch)
    whole = history.with_words(history.attributes(make(rows), RULES)).persist()
    met = history.candidates(history.index_entries(whole), history.probe_entries(whole))
    assert pairs == {(r.a, r.b) for r in history.verified_pairs(met, whole, whole).collect()} and len(pairs) > 100
    # parts that a batch does not look into may be gone
    late = make([row(900, "NIP12345678901", "2025-01-02 08:00", text="fees Ngozi Obi"), row(901, None, "2025-01-03 09:00", text="fees Musa Sani")])
    before = {(r.a, r.b) for r in store.match(late).collect()}
    new = store.prepared(late)
    kept = {*store._parts(history._parted(new, True), "part"), *store._parts(history._parted(new, False), "part")}
    gone = [p for x in ("index", "probes") for p in (tmp_path / x).glob("part=*") if p.name[5:] not in kept]
    for p in gone:
        shutil.rmtree(p)
    spark.catalog.refreshByPath(str(tmp_path))
    assert gone and before and {(r.a, r.b) for r in store.match(late).collect()} == before


def case(spark, *rows):
    students = "array<struct<id string, name string, guardians array<string>>>"
    schema = f"case_no bigint, scenario_family string, setup struct<students {students}>, txn struct<narration string>, split string"
    return spark.createDataFrame([(n, f, ([("s", "x", g) for g in gs],), (t,), "old") for n, f, gs, t in rows], schema)


def test_related_cases(spark):
    df = case(
        spark, (1, "a", [["G-1", None]], None), (2, "a", [[" g-1 "], ["G-2"]], "x"), (3, "b", [["G-2"]], "pay ABC-1234."), (4, "b", [[]], "abc 1234 now"), (5, "b", [None], "ABC  1234"), (6, "a", [["", " "]], "xABC1234"), (7, "a", [["  "]], "ABC12345")
    )
    assert {(r.root, r.node) for r in grouped_split.related(df).collect()} == {(1, 2), (1, 3), (1, 4)}
    assert grouped_split.related(df.limit(0)).count() == 0


def test_splits_keep_groups_and_shares(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("abc"), [[f"G{k // rng.randint(1, 3)}"]], "") for k in range(3000)]
    df = case(spark, *rows)
    out = grouped_split.assign(df, grouped_split.related(df)).collect()
    assert len(out) == 3000
    home, sizes = {}, defaultdict(int)
    for r in out:
        assert home.setdefault(r.group, r.split) == r.split
        sizes[r.split] += 1
    assert abs(sizes["train"] / 3000 - 0.8) < 0.01 and abs(sizes["test"] / 3000 - 0.1) < 0.01


def test_splits_with_a_giant_group(spark):
    rows = [(k, "a", [["HOT"] if k < 300 else [f"G{k}"]], "") for k in range(900)]
    df = case(spark, *rows)
    out = {r.case_no: r.split for r in grouped_split.assign(df, grouped_split.related(df)).collect()}
    assert len({out[k] for k in range(300)}) == 1
    assert abs(sum(v == "train" for v in out.values()) / 900 - 0.8) < 0.02
    assert grouped_split.assign(df.limit(0), grouped_split.related(df.limit(0))).count() == 0


def test_mix(spark):
    docs = [(k, "big" if k % 10 else "small", 10 + k % 7, "x") for k in range(2000)] + [(9001, None, 5, "x"), (9002, "other", 5, "x"), (9003, "big", 0, "x"), (9004, "big", None, "x")]
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint, finish string").drop("finish")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 3), ("absent", 0.0, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    out = mixing.mix(sized, targets).collect()
    share = sum(r.n_tokens for r in out if r.source == "small") / sum(r.n_tokens for r in out)
    assert abs(share - 0.3) < 0.01 and max(r["pass"] for r in out if r.source == "big") == 1 and max(r["pass"] for r in out if r.source == "small") <= 3
    assert len({(r.doc_id, r["pass"]) for r in out}) == len(out) and all(r.doc_id < 9000 for r in out)
    half = mixing.mix(sized, targets, budget=5000).collect()
    assert abs(sum(r.n_tokens for r in half) - 5000) < 60
    rep = {r.source: r.actual_share for r in mixing.report(mixing.mix(sized, targets), targets).collect()}
    assert abs(rep["big"] - 0.7) < 0.01 and rep["absent"] == 0
    assert mixing.mix(sized.limit(0), targets).count() == 0 and mixing.mix(sized, targets.limit(0)).count() == 0
    order = [r.finish for r in mixing.in_order(mixing.mix(sized, targets)).collect()]
    assert order == sorted(order)
