import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.functions import money, similarity, text


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.select("k", expression(F.col("v")).alias("x")).orderBy("k").collect()]


def test_money_accepts_and_rejects(spark):
    good = {"40000": 4_000_000, "5,000": 500_000, "₦75,000.00": 7_500_000, " 12.5 ": 1_250, "0": 0, "+5": 500, ".5": 50, "5.": 500}
    bad = ["", "1e3", "1.234", "1,00", "12,34,567", "-5", "abc", "1_000", "nan", "1.2,3", None]
    assert column(spark, list(good), money.parse_money) == list(good.values())
    assert column(spark, bad, money.parse_money) == [None] * len(bad)


def test_money_is_shown_with_sign_and_groups(spark):
    values = [0, 5, 123_456, -123_456, 100_000_000_000]
    assert column(spark, values, money.format_money, "bigint") == ["₦0.00", "₦0.05", "₦1,234.56", "-₦1,234.56", "₦1,000,000,000.00"]
    assert column(spark, values, money.format_money_plain, "bigint") == ["0.00", "0.05", "1234.56", "-1234.56", "1000000000.00"]


def test_names_references_and_tokens(spark):
    assert column(spark, ["Dr. Ada  OBI", "Alhaji Musa-Bello", "", None], text.normalize_name) == ["ada obi", "musa bello", "", ""]
    assert column(spark, ["nip/12-3", "--", "", None], text.canonical_reference) == ["NIP123", None, None, None]
    assert column(spark, ["Fees: STU-12, ada 2x", None], text.tokens) == [["fees", "stu", "12", "ada", "2x"], []]
    assert column(spark, ["pay stu-7 and AB12", None], text.identifier_tokens) == [["STU-7", "AB12"], []]
    assert column(spark, ["12 345 67890 345", None], text.digit_runs) == [["345", "67890"], []]
    assert column(spark, ["a; b ;;c", None], text.alias_list) == [["a", "b", "c"], []]


def test_small_text_functions(spark):
    assert column(spark, ["the answer is b.", "", "ẸD", "x C y"], text.choice_letter) == ["B", "", "", "C"]
    assert column(spark, ["abc", "é" * 3, ""], text.token_estimate) == [9, 12, 8]
    assert column(spark, ["Ada Ngozi Obi", "Ada", ""], text.initials) == ["A. N. Obi", "Ada", ""]
    assert column(spark, [0.1234, None], text.percent, "double") == ["12.3%", "—"]
    got = column(spark, [0.0, 800.0, -800.0], text.sigmoid, "double")
    assert got == [0.5, 1.0, 0.0]


def test_dedup_hash_keeps_equal_rows_of_a_file_apart(spark):
    df = spark.createDataFrame([(None, 0), (None, 1), ("REF1", 0), ("REF1", 1)], "ref string, n int")
    h = [r.h for r in df.select(text.dedup_hash(F.col("ref"), F.lit("f"), F.col("n"), F.lit("d"), F.lit("1"), F.lit(None).cast("string"), F.lit("a b")).alias("h")).collect()]
    assert h[0] != h[1] and h[2] == h[3] and all(len(x) == 24 for x in h)


def test_jaro_winkler_bounds(spark):
    df = spark.createDataFrame([("martha", "marhta"), ("", ""), ("a", ""), (None, "a"), ("same", "same")], "a string, b string")
    got = [r.s for r in df.select(similarity.jaro_winkler(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[0] == pytest.approx(0.9611, abs=1e-4) and got[1] == 1 and got[2] == 0 and got[3] is None and got[4] == 1


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=8), st.text("abcd", max_size=8))
def test_jaro_is_bounded_and_one_for_equal_texts(a, b):
    score = similarity.winkler(a, b)
    assert 0 <= score <= 1 and similarity.winkler(a, a) == 1 and similarity.jaro(a, b) == pytest.approx(similarity.jaro(b, a), abs=0.2)
