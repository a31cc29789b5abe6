import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.llm import bpe, encoding


@pytest.fixture(scope="module")
def pair():
    data = open(encoding.vocabulary_path(), "rb").read()
    ours = bpe.Transducer(bpe.read_ranks(data))
    return ours, tiktoken.Encoding("check", pat_str=bpe.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80) | st.text("ab =-\n'é😀", max_size=200))
def test_equals_another_implementation_and_decodes(pair, text):
    ours, other = pair
    text = text.encode("utf-8", "ignore").decode()
    ids = ours.encode(text)
    assert ids == other.encode_ordinary(text) and ours.decode(ids) == text


@pytest.mark.parametrize("text", ["a" * 30_000, " " * 20_000 + "x", "ab" * 9_000, "=-" * 9_000, "ọ̀" * 5_000, "<|endoftext|>"])
def test_long_pieces_are_whole(pair, text):
    ours, other = pair
    assert ours.encode(text) == other.encode_ordinary(text)


def test_small_stores_give_the_same(pair, monkeypatch):
    ours, _ = pair
    text = "Small stores are emptied and filled again, naïvely. " * 5
    expected = ours.encode(text)
    monkeypatch.setattr(bpe, "MAX_STATES", 10)
    monkeypatch.setattr(bpe, "MAX_PIECES", 3)
    monkeypatch.setattr(bpe, "_CHUNK", 4)
    small = bpe.Transducer(ours.ranks)
    assert small.encode(text) == expected and small.encode("x" * 999) == ours.encode("x" * 999)


@settings(max_examples=300, deadline=None)
@given(data=st.binary(max_size=40), cut=st.integers(0, 40))
def test_incremental_utf8(data, cut):
    machine = bpe.Utf8Machine()
    assert machine.feed(data[:cut]) + machine.feed(data[cut:]) + machine.close() == data.decode("utf-8", "replace")


def test_columns(spark):
    df = spark.createDataFrame([(1, "Hello hello", [1]), (2, "", [2]), (3, None, [3]), (4, "  \n", None)], "doc_id bigint, text string, ids array<int>")
    out = df.select("doc_id", encoding.token_ids(spark, F.col("text")).alias("t"), encoding.token_counts(spark, F.col("text")).alias("n"))
    got = {r.doc_id: (r.t, r.n) for r in out.collect()}
    assert got[2] == got[3] == ([], 0) and len(got[1][0]) == got[1][1] > 0 and got[4][1] > 0
    back = out.select("doc_id", encoding.texts_of(spark, F.col("t")).alias("x")).collect()
    assert {r.doc_id: r.x for r in back} == {1: "Hello hello", 2: "", 3: "", 4: "  \n"}
    assert df.limit(0).select(encoding.token_ids(spark, F.col("text"))).count() == 0
