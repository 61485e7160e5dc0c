"""With every join key forced 'hot', salted joins must not change results."""

import pytest

import corpuslens.session as S
from corpuslens.functions import objectives as O
from corpuslens.operators.baseline import score_sets
from corpuslens.operators.greedy import greedy_select
from corpuslens.operators.lsh import earliest_mates, first_past_neighbor
from corpuslens.operators.neighbors import past_neighbor_exact, past_neighbor_lsh
from corpuslens.operators.novelty import novelty, word_spread


@pytest.fixture
def all_hot():
    old = S.MAX_GROUP_ROWS
    S.MAX_GROUP_ROWS = 1
    yield
    S.MAX_GROUP_ROWS = old


def _rows(df, cols):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())


def test_fixture_influence_with_salting(spark, all_hot):
    post = spark.createDataFrame([(1, "a", 0.8), (1, "b", 0.6), (2, "b", 1.0), (3, "c", 0.6), (3, "d", 0.8)],
                                 "doc_id long, term string, weight double")
    dates = spark.createDataFrame([(1, 2000), (2, 2001), (3, 2001)], "doc_id long, period int")
    nb = past_neighbor_exact(post, dates)
    assert {r.doc_id: (r.neighbor_id, round(r.dot, 6)) for r in nb.collect()} == {2: (1, 0.6), 3: (1, 0.0)}
    nv = novelty(post, nb)
    cells = O.influence_cells(nv, dates, word_spread(post, dates))
    sets = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 1), (3, 3)], "trial int, doc_id long")
    assert {r.trial: round(r.score, 6) for r in score_sets(cells, sets).collect()} == {0: 1.6, 1: 0.4, 2: 1.0, 3: 2.6}
    assert [r.doc_id for r in greedy_select(cells, 3).orderBy("rank").collect()] == [1, 3, 2]


def test_copies_share_one_neighbour(spark):
    """Six exact copies and a few others: copies all pick the earliest copy."""
    rows = [(d, t, w) for d in range(6) for t, w in (("x", 0.6), ("y", 0.8))]
    rows += [(10 + d, f"z{d}", 1.0) for d in range(4)]
    post = spark.createDataFrame(rows, "doc_id long, term string, weight double")
    dates = spark.createDataFrame([(d, 0) for d in list(range(6)) + [10, 11, 12, 13]], "doc_id long, period int")
    buckets = spark.createDataFrame([(0, 7, d) for d in list(range(6)) + [10, 11, 12, 13]], "band int, bucket long, doc_id long")
    plain = {(r.doc_id, r.neighbor_id, round(r.dot, 9)) for r in past_neighbor_lsh(post, buckets, dates).collect()}
    old = S.MAX_GROUP_ROWS
    S.MAX_GROUP_ROWS = 1
    try:
        salted = {(r.doc_id, r.neighbor_id, round(r.dot, 9)) for r in past_neighbor_lsh(post, buckets, dates).collect()}
        mates = _rows(earliest_mates(buckets, dates), ["doc_id", "band", "min_mate"])
        first = _rows(first_past_neighbor(buckets, dates), ["doc_id", "neighbor_id"])
        nv = _rows(novelty(post, past_neighbor_lsh(post, buckets, dates)), ["doc_id", "term", "weight"])
    finally:
        S.MAX_GROUP_ROWS = old
    assert salted == plain
    assert {(d, n) for d, n, _ in plain if d < 6} == {(d, 0) for d in range(1, 6)}
    assert mates == _rows(earliest_mates(buckets, dates), ["doc_id", "band", "min_mate"])
    assert first == _rows(first_past_neighbor(buckets, dates), ["doc_id", "neighbor_id"])
    assert nv == _rows(novelty(post, past_neighbor_lsh(post, buckets, dates)), ["doc_id", "term", "weight"])
