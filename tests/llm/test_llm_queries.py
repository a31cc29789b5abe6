import pytest
from oracle import connect, same

from tallyspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    keys = df.columns
    rows = df.collect()
    assert rows and len(keys) == len(set(keys))
    if name.endswith("_found"):
        assert len({tuple(r) for r in rows}) == len(rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, folder, name):
    same(queries.QUERIES[name](spark, folder), connect(folder), queries.ORACLE[name])


def test_shares_of_splits_and_mix_come_close(spark):
    """Tolerances: two points of a split's size, ten of a label with at least 100 cases, two of a source's share of tokens."""
    folder = "/root/testdata/sf0.01"
    for r in queries.QUERIES["p6_deviations"](spark, folder).collect():
        total = r.cases / r.share
        assert r.label is not None or abs(r.share - r.target) <= 0.02, r
        assert r.label is None or total < 100 or abs(r.share - r.target) <= 0.10, r
    for r in queries.QUERIES["p9_shares"](spark, folder).collect():
        assert abs(r.actual_share - r.target_share) <= 0.02, r


def test_report_counts_what_is_found(spark):
    folder = "/root/testdata/sf0.01"
    found, rows = queries.QUERIES["p3_found"](spark, folder).count(), queries.QUERIES["p3_report"](spark, folder).collect()
    assert sum(r.pairs for r in rows) == found and all(r.in_train <= r.cases and (r.covered is None or 0.5 <= r.covered <= 1) for r in rows)
