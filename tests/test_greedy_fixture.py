"""Three-document corpus of FIXTURES.md §3: objectives and greedy picks."""

import pytest

from corpuslens.functions import objectives as O
from corpuslens.operators.greedi import greedi_select
from corpuslens.operators.greedy import greedy_select, lazy_greedy_select
from corpuslens.operators.local_greedy import lazy_greedy_local


@pytest.fixture(scope="module")
def postings(spark):
    rows = [(1, "a", 0.8), (1, "b", 0.6), (2, "b", 1.0), (3, "c", 0.6), (3, "d", 0.8)]
    return spark.createDataFrame(rows, "doc_id long, term string, weight double")


@pytest.fixture(scope="module")
def df_counts(spark):
    return spark.createDataFrame([("a", 1), ("b", 2), ("c", 1), ("d", 1)], "term string, df long")


@pytest.fixture(scope="module")
def buckets(spark):
    rows = [(0, 1, 1), (0, 1, 2), (0, 2, 3), (1, 3, 1), (1, 3, 2), (1, 3, 3)]
    return spark.createDataFrame(rows, "band int, bucket long, doc_id long")


def _score(spark, cells, ids):
    sel = spark.createDataFrame([(i,) for i in ids] or [(-1,)], "doc_id long")
    if not ids:
        sel = sel.filter("false")
    return O.score(cells, sel).first()["score"]


def _picks(df):
    return [(r["doc_id"], round(r["gain"], 6), round(r["score"], 6)) for r in df.orderBy("rank").collect()]


def test_word_coverage_scores(spark, postings):
    cells = O.word_coverage_cells(postings, 4)
    assert [round(_score(spark, cells, [d]), 6) for d in (1, 2, 3)] == [0.35, 0.25, 0.35]
    assert _score(spark, cells, []) == 0.0


def test_greedy_word_coverage(spark, postings):
    cells = O.word_coverage_cells(postings, 4)
    expected = [(1, 0.35, 0.35), (3, 0.35, 0.7), (2, 0.1, 0.8)]
    assert _picks(greedy_select(cells, 3)) == expected
    assert _picks(lazy_greedy_select(cells, 3, batch=1)) == expected
    assert _picks(greedi_select(cells, 3, partitions=1)) == expected
    local = lazy_greedy_local(cells.toPandas(), 3)
    assert [(d, round(g, 6)) for d, g in local] == [(1, 0.35), (3, 0.35), (2, 0.1)]
    # k larger than the corpus returns every document
    assert len(greedy_select(cells, 10).collect()) == 3


def test_weighted_coverage(spark, postings, df_counts):
    cells = O.weighted_word_coverage_cells(postings, df_counts, "df")
    got = [round(_score(spark, cells, [d]), 6) for d in (1, 2, 3)]
    assert got == [0.373459, 0.320377, 0.317157]
    assert [p[2] for p in _picks(greedy_select(cells, 3))] == [0.373459, 0.690616, 0.818767]


def test_lsh_bucket_coverage(spark, buckets):
    cells = O.lsh_bucket_cells(buckets)
    got = [round(_score(spark, cells, ids), 6) for ids in ([1], [2], [3], [1, 3], [1, 2, 3])]
    assert got == [0.524377, 0.524377, 0.455342, 0.810617, 1.0]


def test_combination(spark, postings, df_counts, buckets):
    cells = O.combine_cells({"wwc": (O.weighted_word_coverage_cells(postings, df_counts, "df"), 1.0),
                             "lsh": (O.lsh_bucket_cells(buckets), 1.0)})
    assert [p[2] for p in _picks(greedy_select(cells, 3))] == [0.897836, 1.501234, 1.818767]
    assert [p[2] for p in _picks(lazy_greedy_select(cells, 3, batch=1))] == [0.897836, 1.501234, 1.818767]
