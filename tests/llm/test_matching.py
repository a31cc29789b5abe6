import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import entity_links, names, page_spam, split_overlap

CASE = "case_no bigint, split string, provenance string, setup struct<students array<struct<name string>>>, txn struct<payer_name string, narration string>, side int"


def cases(spark, *rows):
    return spark.createDataFrame([(n, s, "p", ([(x,) for x in st] if st is not None else None,), (p, t), 9) for n, s, p, st, t in rows], CASE)


def found(spark, *rows):
    return {(r.case_no_a, r.case_no_b) for r in split_overlap.overlaps(cases(spark, *rows)).collect()}


def test_overlaps(spark):
    base = (1, "train", "Mrs Ada Obinna", ["Chidi Obinna", "Ngozi Obinna"], "school fees for Chidi Obinna ABC-1234")
    assert found(spark, base, (2, "test", "A. Obinna", ["OBINNA NGOZI", "Chidi Obina"], "SCHOOL,FEES,FOR,Chidi,Obinna thanks")) == {(1, 2)}
    assert found(spark, base, (2, "val", "Mrs Ada Obinna", ["Chidi Obinna", "Ngozi Obinna"], "library fine Chidi")) == set()
    assert found(spark, base, (2, "val", "Uche Ezeani", ["Chidi Obinna", "Ngozi Obinna"], base[4])) == set()
    assert found(spark, base, (2, "val", "Mrs Ada Obinna", ["Emeka Obinna", "Ngozi Obinna"], base[4])) == set()
    assert found(spark, base, (2, "train", *base[2:])) == set() and found(spark, base, (2, None, *base[2:])) == set()
    assert found(spark, (1, "train", None, None, None), (2, "test", None, None, None), (3, "test", "", [], "x" * 20_000)) == set()
    assert found(spark) == set()


def test_copies_give_all_pairs_of_members(spark):
    same = ("Ada Obinna", ["Chidi Obinna"], "fees Chidi")
    rows = [(k, "train", *same) for k in range(20)] + [(k, "test", *same) for k in range(20, 25)]
    assert found(spark, *rows) == {(a, b) for a in range(20) for b in range(20, 25)}
    rep = split_overlap.report(cases(spark, *rows)).first()
    assert (rep.cases, rep.in_train, rep.pairs, rep.covered) == (5, 5, 100, 1.0)


def test_scan_equals_comparing_all(spark):
    people = ["Chidi Obinna", "Chidi Obina", "Ngozi Obinna", "Zainab Bello", "Zainab Belo", "Bello Zainab", "Musa Danladi"]
    records = [(p, [s], f"fees for {s}") for p, s in itertools.product(people, people)]
    got = set(split_overlap.scan(records, records))
    form = lambda x: (split_overlap.person(x[0]), [split_overlap.person(y) for y in x[1]], split_overlap.purpose(x[2]))
    assert got == {(i, j) for i, a in enumerate(records) for j, b in enumerate(records) if split_overlap.same_record(form(a), form(b))}


def test_overlaps_by_passages_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(split_overlap, "SHARD", 40)
    monkeypatch.setattr(split_overlap, "SIGNED", 7)
    base = ["Chidi Obinna", "Ngozi Adaku Obinna", "Zainab Bello", "Musa Danladi"]
    texts = [(p, [s, *more], f"fees for {s}") for p, s in itertools.product(["K O Obinna", "Amina Bello", "AminaBello", None], base) for more in ([], [base[0]])]
    worse = [(p, [s.replace("b", "bb", 1).replace("Ngozi A", "NgoziA"), *more], n) for p, (s, *more), n in texts]
    rows = [(k, "train", *x) for k, x in enumerate(texts)] + [(100 + k, "test", *x) for k, x in enumerate(worse)]
    form = lambda x: (split_overlap.person(x[0]), [split_overlap.person(y) for y in x[1]], split_overlap.purpose(x[2]))
    same = {(j, 100 + i) for i, a in enumerate(worse) for j, b in enumerate(texts) if split_overlap.same_record(form(a), form(b))}
    assert len(same) >= 24 and found(spark, *rows) == same
    # run together, where neither payer nor student has two undamaged words: no automaton of word halves met these
    assert found(spark, (1, "train", "ChimimimAdeyazo", ["Shumumi Adeyazo"], "fees Adeyazo"), (2, "val", "ChimimimAdeyazo", ["Shuyumi Adeyazo"], "fees Adeyazo")) == {(1, 2)}


def test_signatures_refuse_different_names_only():
    people = [["k", "o", "obinna"], ["obinna"], ["obina", "kachi"], ["kachi", "obinna"], ["kachiobinna"], ["bello"], ["amina", "belo"], [], ["a", "b", "c", "d"], ["obinan", "kahci"], ["x" * 40, "kachi"]]
    words, letters = split_overlap.signatures(pa.array(people, pa.list_(pa.string())))
    i, j = (x.ravel() for x in np.indices((len(people), len(people))))
    may = split_overlap.may_agree(words[i], letters[i], words[j], letters[j])
    assert all(m or not names.same_words(people[a], people[b]) for m, a, b in zip(may, i, j)) and may.sum() < 0.7 * len(may)


@pytest.mark.parametrize("a, b, same", [("Ada Obi", "OBI, ADA", True), ("A. Obi", "Ada Obi", True), ("Ada Obi", "Uche Obi", False), (None, "", True), ("Ada", None, False), ("Dr Ada Obi", "Ada Obbi", True)])
def test_persons(a, b, same):
    assert names.same_person(a, b) is same


@pytest.mark.parametrize("a, b, most", [("abcd", "abdc", 1), ("abcd", "abcde", 1), ("abc", "xyz", 3), ("", "", 0)])
def test_distance(a, b, most):
    assert names.distance(a, b, most) == most and names.distance(a, "q" * 50, 2) == 3


STATEMENTS = "row_id bigint, payer string, narration string, amount string, confidence string"


@pytest.fixture(scope="module")
def school(spark):
    first, last = ["Chidi", "Ngozi", "Emeka", "Zainab", "Tunde", "Amina", "Bisola", "Kelechi"], ["Obinna", "Bello", "Adewale", "Danladi", "Nwosu", "Okafor"]
    pupils = [(f"S{a}{b}", f"{x} {y}", "JSS2" if a % 2 else "Primary 3", "") for (a, x), (b, y) in itertools.product(enumerate(first), enumerate(last))]
    parents = [(f"G{b}", f"Mama {y}") for b, y in enumerate(last)]
    links = [(s, f"G{s[2]}") for s, *_ in pupils] * 2
    fees = [(s, "F", "T", f"{50_000 + 137 * k}") for k, (s, *_) in enumerate(pupils)]
    make = spark.createDataFrame
    return make(pupils, "student_id string, name string, class string, aliases string"), make(parents, "guardian_id string, name string"), make(links, "student_id string, guardian_id string"), make(fees, "student_id string, fee_id string, term_id string, amount string")


def test_links(spark, school):
    pupils = school[0].collect()
    fee = {r.student_id: r.amount for r in school[3].collect()}
    rows = [(k, "Mama " + p.name.split()[1], f"fees for {p.name}", fee[p.student_id], "x") for k, p in enumerate(pupils)]
    n = len(rows)
    rows += [(n, "Mama Bello", "school fees Zainb Bello", fee["S31"], "x"), (n + 1, None, None, None, "x"), (n + 2, "Mama Bello", "diesel supply", "5", "x"), (n + 3, "Mama Nwosu", "fees ChidiNwosu", fee["S04"], "x"), (n + 4, "Mama Nwosu", "Chidi and Ngozi", "99", "x")]
    got = {(r.row_id, r.student_id) for r in entity_links.matches(spark.createDataFrame(rows, STATEMENTS), *school).collect()}
    expected = {(k, p.student_id) for k, p in enumerate(pupils)}
    assert expected <= got and not {x for x in got if x[0] < n} - expected
    assert {x for x in got if x[0] >= n} >= {(n, "S31"), (n + 3, "S04")} and not {x for x in got if x[0] in (n + 1, n + 2)}


def test_links_of_a_guardian_with_a_third_of_the_rows(spark, school):
    make = spark.createDataFrame
    guardians = school[1].union(make([("G9", "Ngozi Adaku")], school[1].schema))
    links = school[2].union(make([("S01", "G9")], school[2].schema))
    pupils = school[0].collect()
    fee = {r.student_id: r.amount for r in school[3].collect()}
    rows = [(k, "Ngozi Adaku", "Chidi fees", fee["S01"], "x") for k in range(60)]
    rows += [(100 + k, "Zumari Agent", f"fees for {p.name}", fee[p.student_id], "x") for k, p in enumerate(pupils * 2)]
    got = {(r.row_id, r.student_id) for r in entity_links.matches(make(rows, STATEMENTS), school[0], guardians, links, school[3]).collect()}
    assert {x for x in got if x[0] < 100} == {(k, "S01") for k in range(60)}
    assert {x for x in got if x[0] >= 100} == {(100 + k, p.student_id) for k, p in enumerate(pupils * 2)}


def test_collective_payers(spark):
    names_ = spark.createDataFrame([(f"name{k}x", True) for k in range(500)] + [("bello", True), ("ngozi", True), ("agent", False)], "token string, name boolean")
    rows = [("agent zumari", [f"name{k % 3}x"]) for k in range(50)] + [("bello ngozi", [f"name{k % 3}x"]) for k in range(5_000)] + [("bello ventures", [f"name{k}x"]) for k in range(500)] + [("rare", ["name1x"])] * 49 + [("", ["name1x"])] * 99
    words = spark.createDataFrame([(who, w, [(t, 0) for t in who.split()]) for who, w in rows], "who string, w array<string>, p array<struct<t string, m int>>")
    assert {r.who for r in entity_links.collective_payers(words, names_).collect()} == {"agent zumari", "bello ventures"}


def test_links_of_a_long_narration(spark, school):
    pupils = school[0].collect()
    fee = {r.student_id: r.amount for r in school[3].collect()}
    rows = [(k, "Mama " + p.name.split()[1], f"fees for {p.name}", fee[p.student_id], "x") for k, p in enumerate(pupils)]
    others = [a + b + "q" for a, b in itertools.product(("wrt", "zxv", "kjh", "qpl", "mfd"), "abcdefghijklmnopqrstuvwxyz")]
    for n, words in ((1000, others[:70]), (1001, others)):
        rows.append((n, "Mama Bello", " ".join(words) + " Chidi Ngozi Emeka Zainab", None, "x"))
    got = {(r.row_id, r.student_id) for r in entity_links.matches(spark.createDataFrame(rows, STATEMENTS), *school).collect()}
    assert {x for x in got if x[0] >= 1000} == {(n, f"S{a}1") for n in (1000, 1001) for a in range(4)}


def test_mentions_of_one_pair_keep_their_positions(spark):
    columns = "row_id bigint, student_id string, bits int, heads0 bigint, covers0 bigint, heads1 bigint, covers1 bigint, level int, total bigint, amount bigint, row_level int, collective boolean"
    pairs = spark.createDataFrame([(1, "S", 1, 5, 5, 2, 2, None, None, None, None, False)], columns)
    assert sorted(r.mention for r in entity_links.votes(pairs, 2).collect()) == [0, 2, 61]


def _votes_one_by_one(pairs):
    """The votes of pairs, (row_id, student_id, bits, heads, covers, level, total, amount, row_level, collective), by the definitions."""
    e, out = entity_links, set()
    near = lambda x, y: x is not None and bool(y) and abs(x / y - 1) < 0.003
    worth = {e.EXACT: 3, e.ALIAS: 2, e.FUZZY: 2, e.SPLIT: 2, e.SURNAME: 3, e.INITIAL: 1, e.OTHER: 1, e.GUARDIAN: 3, e.GIVEN: 1, e.FAMILY: 1, e.OWN: 1}
    first = lambda bits, order, none: next((k for k, mask in enumerate(order) if bits & mask), none)
    for row, group in itertools.groupby(sorted(pairs, key=lambda x: x[0]), key=lambda x: x[0]):
        votes = [(p, m) for p in group for m in range(120) if p[3] >> m & 1]
        rivals = lambda m, votes=votes: sum(x == m for _, x in votes)
        sure = [p[6] for p, m in votes if rivals(m) == 1 and p[6] is not None]
        together = sum(sure) if sure else None
        heads = known = 0
        for p, _ in votes:
            heads, known = heads | p[3], known | p[4]
        many = heads.bit_count() > 1
        judged = []
        for p, m in votes:
            _, student, bits, _, covers, level, total, amount, row_level, collective = p
            lost = known & ~(covers | heads)
            v1 = first(bits, (e.SURNAME, e.INITIAL), 3 if lost else 2)
            v2 = first(bits, (e.GUARDIAN, e.FAMILY | e.OWN | e.GIVEN), 2 if collective else 3)
            if amount is None or total is None:
                v3 = 3
            else:
                v3 = next((k for k in (0, 1) if near(amount * (k + 1), total) or near(amount * (k + 1), together)), 3 if many and amount > total else 2)
            v4 = 2 if level is None or row_level is None else 0 if level == row_level else 2 if many else 1
            strength = {0: 2, 1: 1}.get(v3, 0) + {0: 1, 1: -2}.get(v4, 0) + sum(w for b, w in worth.items() if bits & b)
            judged.append((row, student, m, int(len(votes) == 1), strength, first(bits, (e.EXACT, e.ALIAS, e.FUZZY | e.SPLIT, e.SHORT), 4), v1, v2, v3, v4))
        for x in judged:
            rest = [y[4] for y in judged if y[2] == x[2]]
            out.add((*x, 2 if x[4] < max(rest) else int(rest.count(max(rest)) > 1)))
    return out


def test_votes_of_rows_over_several_batches(spark):
    rng = np.random.default_rng(3)
    some = lambda *x: x[rng.integers(len(x))]
    rows, pairs = {r: (some(None, 1000, 2000, 0), some(None, 1, 2), some(True, False)) for r in range(60)}, []
    for r in rows:
        for s in range(some(1, 1, 2, 3, 17)):
            heads = sum({1 << int(m) for m in rng.choice([0, 1, 59, 60, 61, 100], some(1, 1, 2))})
            pairs.append((r, f"S{s}", int(rng.integers(1, 1 << 12)), heads, heads | 1 << some(2, 3, 70), some(None, 1, 2), some(None, 0, 1000, 2000, 1001), rows[r][0], rows[r][1], rows[r][2]))
    columns = "row_id bigint, student_id string, bits int, heads0 bigint, covers0 bigint, heads1 bigint, covers1 bigint, level int, total bigint, amount bigint, row_level int, collective boolean"
    low = (1 << entity_links.PLACES) - 1
    frame = spark.createDataFrame([(*p[:3], p[3] & low, p[4] & low, p[3] >> 60, p[4] >> 60, *p[5:]) for p in pairs], columns)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        found = entity_links.votes(frame, 2)
        got = [tuple(r) for r in found.select("row_id", "student_id", "mention", "alone", "strength", *(f"v{k}" for k in range(6))).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == len(set(got)) and set(got) == _votes_one_by_one(pairs)
    assert "Window" not in found._jdf.queryExecution().toString()  # groups are found in arrays, not row by row


def test_pairs_of_meetings():
    place = lambda pos, where: (pos << 32) + where + 2
    rows = [
        (1, "S", 7, 900, 1, entity_links.EXACT, place(0, 1)), (1, None, 8, 450, 3, 1, None), (1, "T", None, None, 4, entity_links.FUZZY, place(61, -1)),
        (1, "S", 7, 900, 1, entity_links.SURNAME, place(2, -2)), (2, None, None, 5, 0, 0, None), (3, None, None, None, None, 0, None), (3, "S", 7, 900, 1, entity_links.ALIAS, place(60, 119)),
    ]
    names_ = ["row_id", "student_id", "level", "total", "own", "bits", "place"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    table = lambda rows: pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names_)
    got = entity_links.whole_pairs(table(rows), 2).select(["row_id", "student_id", "bits", "heads0", "heads1", "covers0", "covers1", "level", "total", "amount", "row_level", "collective"]).to_pylist()
    assert [tuple(x.values()) for x in got] == [
        (1, "S", entity_links.EXACT | entity_links.SURNAME | entity_links.INITIAL, 5, 0, 7, 0, 7, 900, 450, 8, True),
        (1, "T", entity_links.FUZZY, 0, 2, 0, 2, None, None, 450, 8, True),
        (3, "S", entity_links.ALIAS, 0, 1, 0, 1 | 1 << 59, 7, 900, None, None, False),
    ]
    assert len(entity_links.vote(entity_links.whole_pairs(table(rows[4:5]), 1), 1)[0]) == 0


def test_links_of_children_whose_fees_are_nothing(spark, school):
    fees = school[3].select("student_id", "fee_id", "term_id", F.lit("0").alias("amount"))
    pupils = school[0].collect()
    rows = [(k, "Mama " + p.name.split()[1], f"fees for {p.name}", str(k), "x") for k, p in enumerate(pupils)]
    rows.append((None, "Mama Bello", "fees for Chidi Bello", "5", "x"))
    got = {(r.row_id, r.student_id) for r in entity_links.matches(spark.createDataFrame(rows, STATEMENTS), *school[:3], fees).collect()}
    assert got == {(k, p.student_id) for k, p in enumerate(pupils)}


def test_words_one_edit_apart(spark):
    pairs = [("zainab", "zainb", True), ("zainab", "zaniab", True), ("zainab", "zainax", True), ("zainab", "zbinaa", False), ("zainab", "aizanb", False), ("chidi", "chdii", True)]
    words, known = (spark.createDataFrame([(x[k],) for x in pairs], "token string").distinct() for k in (1, 0))
    mapped = entity_links.token_map(words, known.selectExpr("token", "true as name", "true as head"))
    assert {(r.known, r.token) for r in mapped.where(f"form = {entity_links.FUZZY}").collect()} == {x[:2] for x in pairs if x[2]}


def test_classes_are_searched_once(spark):
    texts = spark.createDataFrame([("fees Ada JSS2B", 1), ("Primary 3 Bello", 1), ("no class", 1), ("p7", 1), ("x ss.1", 1)], "t string, k int")
    code = entity_links.class_code(texts.t)
    assert [r[0] for r in texts.select(code).collect()] == [ord("j") * 10 + 2, ord("p") * 10 + 3, None, None, ord("s") * 10 + 1]
    assert str(code).count("nursery") == 1


def test_links_of_empty_tables(spark, school):
    none = spark.createDataFrame([], STATEMENTS)
    assert entity_links.matches(none, *school).count() == 0
    assert entity_links.matches(spark.createDataFrame([(1, "a", "Chidi Bello", "5", "x")], STATEMENTS), *(t.limit(0) for t in school)).count() == 0


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.4
    votes = np.stack([np.where(rng.random(20_000) < a, ~truth, ~truth == False).astype(int) * (k - 1) for a, k in zip((0.9, 0.85, 0.8, 0.9, 0.8, 0.85), entity_links.OUTCOMES)], 1)  # noqa: E712
    votes = np.where(votes > 0, np.array(entity_links.OUTCOMES) - 1, 0)
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior = entity_links.fit_label_model(patterns, counts.astype(float))[back.ravel()]
    right = max(((posterior > 0.5) == truth).mean(), ((posterior > 0.5) != truth).mean())
    assert right > 0.9 and len(entity_links.fit_label_model(np.zeros((0, 6), int), np.zeros(0))) == 0


PROSE = "Please credit the money I sent on Monday to the account of my child, who is in the third class. The desk closes at four, so calls after that are answered on the next day. "


@pytest.mark.parametrize(
    "text, spam",
    [
        (None, False), ("", False), (" \n\t", False), (PROSE, False), (PROSE * 40, False),
        ("cheap lamp best lamp lamp online uniform lamp cheap uniform lamp uniform best lamp", True),
        ("Why lamp? Because lamp best lamp. Our lamp beats every other lamp, so choose lamp today. Looking for lamp? Lamp here, lamp there, lamp now!", True),
        ("\n".join(f"[lamp](http://shop{k}.example/lamp)" for k in range(9)), True),
        ("\n".join(f'<li><a href="www.s{k}.test/x">uniform</a></li>' for k in range(9)), True),
        ("Tags: lamp, uniform, lamp (3), bag, uniform, lamp, bag (9), lamp, uniform, bag, lamp", True),
        (PROSE[:90] + " #lamp #bestlamp #cheaplamp #uniform #lamp #topuniform #bag #newbag #lamp #bags", False),
        ("#lamp #bestlamp #cheaplamp #uniform #lamp #topuniform #bag #newbag #lamp #bags", True),
        ("Register\n" + "\n".join(f"{k}. {n}" for k, n in enumerate("Ada Bello,Chidi Nwosu,Zainab Musa,Tunde Ojo,Emeka Eze,Bisi Alabi".split(","))), False),
        ("Fee schedule\nTuition 73,000\nBus 56,000\nBooks 41,250\nExam 37,500\nBoarding 56,250\nLaboratory 33,500", False),
        (PROSE + "The calendar is at shop.school.example/calendar.html and opens at eight each morning.", False),
        ("Q1. Who is the head of the school?\nWho is the head of the school? We are told that it is the bursar.\n", False),
    ],
)
def test_spam(text, spam):
    assert page_spam.is_spam(text) is spam


def test_spam_table(spark):
    df = spark.createDataFrame([(1, "lamp bag lamp bag lamp bag lamp bag lamp bag", True), (2, None, True), (3, PROSE, True), (4, "lamp " * 100_000, True)], "doc_id bigint, text string, _spam boolean")
    assert sorted(r.doc_id for r in page_spam.spam_pages(df).collect()) == [1, 4] and page_spam.spam_pages(df.limit(0)).count() == 0


KEYWORDS = "lamp bag shoe cardigan beret sandal pinafore uniform bottle pencil ruler eraser crayon satchel jersey blazer socks tie whistle globe".split()


@pytest.mark.parametrize(
    "text, spam",
    [
        ("buy cheap school uniforms\n" * 50, True),
        ((" ".join(KEYWORDS[:10]) + "\n") * 50, True),
        (" ".join(KEYWORDS * 6), True),
        ((" ".join(KEYWORDS) + "\n") * 40, True),
        (" ".join(f"{k}{x}" for _ in range(5) for x in KEYWORDS for k in ("best", "cheap", "new")), True),
        (" ".join(f"word{x}" for x in np.random.default_rng(1).permutation(np.repeat(np.arange(2_000), 8))), True),
        (PROSE + "Kind regards\n" + "The desk is open to you on every day of the week.\n" * 50, False),
        ("\n".join(f"{x.title()} {n * 1000 + 10 * k}" for n in range(1, 7) for k, x in enumerate(KEYWORDS)), False),
        (("\n".join(f"{k}. {a} {b}" for k, (a, b) in enumerate(zip("Ada Chidi Zainab Tunde Emeka Bisi Ngozi Musa".split(), "Bello Nwosu Danladi Ojo Eze Alabi Okafor Sani".split()))) + "\n") * 2, False),
    ],
)
def test_spam_repeats_at_any_distance(text, spam):
    assert page_spam.is_spam(text) is spam


GOODS = "\n".join(f"{a.title()} {b} ₦{n},{n * 7 % 9}50 {c}" for n, (a, b, c) in enumerate(zip(KEYWORDS[:10], KEYWORDS[10:], itertools.cycle(("Buy", "SALE", "In stock", "SKU5519", "Add to cart", "SKU921"))), 1))
PEOPLE = "Ada Bello,Chidi Nwosu,Zainab Musa,Tunde Ojo,Emeka Eze,Bisi Alabi,Ngozi Okafor,Amina Danladi,Kelechi Obi,Sani Garba".split(",")


@pytest.mark.parametrize(
    "text, spam",
    [
        (GOODS, True), (GOODS.replace("\n", " | "), True), (GOODS.replace("\n", ", "), True),
        (GOODS + "\nThat transfer belongs to Ada, whose guardian confirmed it by phone on 12 July.", True),
        (", ".join(KEYWORDS) + ", lunch box", True), ("\n".join(KEYWORDS) + "\nlunch box", True), ("tags: " + ", ".join(f"{k} ({n})" for n, k in enumerate(KEYWORDS)), True),
        ("Register\n" + "\n".join(PEOPLE), False), ("Register\n" + "\n".join(f"{k}. {x.lower()}" for k, x in enumerate(PEOPLE)), False),
        ("Fees\n" + "\n".join(f"{k.title()} ₦{n},500" for n, k in enumerate(KEYWORDS, 1)), False),
        ("Fees\n" + "\n".join(f"{k.title()} ₦{n},500 from {PEOPLE[n % 10]}" for n, k in enumerate(KEYWORDS[:9])), False),
        ("Extract\n" + "\n".join(f"{n:02}/08 NIP95{n}0927 {x} fees SS1 6{n},500" for n, x in enumerate(PEOPLE)), False),
        ("Extract\n" + "\n".join(f"{n:02}/08 6{n},500 order {x} SKU{n}AB{n}" for n, x in enumerate(PEOPLE)), False),
        ("Agenda\n" + "\n".join(f"{n}. {k}" for n, k in enumerate(KEYWORDS, 1)), False),
        ("abeg make una check my payment wey i don send since monday because alert don land but e never show for your side till now", False),
    ],
)
def test_spam_of_distinct_nouns(text, spam):
    assert page_spam.is_spam(text) is spam


REGISTERS = {
    "numbered": lambda r, name, k: f"{k + 1}. {name()} {r.choice(['JSS 1', 'SS 3'])}",
    "class": lambda r, name, k: f"{name()}, {r.choice(['JSS 1', 'SS 3'])}",
    "names": lambda r, name, k: name(),
    "present": lambda r, name, k: f"{name()} present",
    "extract": lambda r, name, k: f"2024-0{r.randint(1, 9)}-{r.randint(10, 28)} {name()} school fees {r.randint(5, 90)},000.00 CR",
    "schedule": lambda r, name, k: f"{r.choice(['Tuition', 'Books', 'Uniform', 'Exam'])} {r.choice(['JSS 1', 'SS 3'])}: ₦{r.randint(5, 90)},{r.randint(1, 9)}00",
    "timetable": lambda r, name, k: f"{8 + k % 6}:00 {r.choice(['Maths', 'English', 'Civic'])} Mr {name().split()[1]}",
}


@pytest.mark.parametrize("lines", [6, 12, 25, 50, 100, 300])
@pytest.mark.parametrize("kind", sorted(REGISTERS))
def test_registers_of_any_length_are_no_spam(kind, lines):
    import random

    r = random.Random(lines)
    first, last = "Ada Chidi Ngozi Emeka Zainab Tunde Amina Bisola Kelechi Musa Uche Ife Sade Bola Hauwa Garba Obi Nneka Femi Yusuf Halima Dayo Eze Ify Tope".split(), "Obinna Bello Adewale Danladi Nwosu Okafor Balogun Sani Ibrahim Ojo Ademola Nnamdi Lawal Umar".split()
    text = "Office copy\n" + "\n".join(REGISTERS[kind](r, lambda: f"{r.choice(first)} {r.choice(last)}", k) for k in range(lines))
    assert page_spam.is_spam(text) is False


def test_equal_texts_get_equal_results_in_any_batch():
    texts = [GOODS, PROSE, None, "", "Register\n" + "\n".join(PEOPLE), " ".join(KEYWORDS * 6)]
    alone = [page_spam.is_spam(x) for x in texts]
    together = page_spam.decide(page_spam.figures(pa.array(texts * 3, pa.string())))
    assert list(together) == alone * 3 and len(page_spam.decide(page_spam.figures(pa.array([], pa.string())))) == 0


@pytest.mark.parametrize(
    "narration, payer, w, letters, p",
    [
        (None, None, [], "", {}), ("fees for Chidi Chidi O. Bello_ada", "Mr A. Obi Ada", ["chidi", "bello", "ada"], "o", {"obi": "a", "ada": "ao"}),
        ("Obi Ada", "school fees for Zainab", ["zainab"], "", {"obi": "a", "ada": "o"}), ("fees ch1di", "Ada Ada", ["chidi"], "", {"ada": "a"}), ("", "É. Ọlá", [], "", {"ola": "e"}),
    ],
)
def test_words_of_rows(narration, payer, w, letters, p):
    bits = lambda x: sum(1 << (ord(c) - 97) for c in x)
    got = entity_links.row_words(pa.array([narration, "x"], pa.string()), pa.array([payer, None], pa.string())).to_pylist()[0]
    assert (got["w"], got["i"], {x["t"]: x["m"] for x in got["p"]}) == (w, bits(letters), {t: bits(m) for t, m in p.items()})
    assert len(entity_links.row_words(pa.array([], pa.string()), pa.array([], pa.string()))) == 0
