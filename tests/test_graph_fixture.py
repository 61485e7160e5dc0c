"""FIXTURES.md §3-§4: graphs, categories, boosts, revisions, neighbours."""

import pytest

from corpuslens.functions import objectives as O
from corpuslens.operators import graph as G
from corpuslens.operators.baseline import score_sets
from corpuslens.operators.greedi import greedi_select
from corpuslens.operators.greedy import greedy_select
from corpuslens.operators.neighbors import past_neighbor_exact
from corpuslens.operators.similarity import cosine_similarity
from corpuslens.operators.report import score_variants

LINES = [(10, 1), (10, 2), (10, 3), (10, 3), (11, 3), (11, 4), (12, 10), (12, 11), (12, 1), (12, 2)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(LINES, "doc_id long, src_id long")


def _sets(spark, groups):
    return spark.createDataFrame([(i, d) for i, g in enumerate(groups) for d in g], "trial int, doc_id long")


def _scores(df):
    return {r.trial: round(r.score, 6) for r in df.collect()}


def test_adjacency_and_counts(edges):
    assert {(r.doc_id, r.inlinks) for r in G.inlink_counts(edges).collect()} == {(10, 3), (11, 2), (12, 4)}
    assert G.build_adjacency(edges).count() == 9


def test_graph_coverage_and_greedi(spark, edges):
    cells = O.graph_coverage_cells(edges)
    assert _scores(score_sets(cells, _sets(spark, [[10], [11], [12]]))) == {0: 4.0, 1: 3.0, 2: 5.0}
    sel = [(r.doc_id, r.gain, r.score) for r in greedi_select(cells, 3, partitions=1).orderBy("rank").collect()]
    assert sel == [(12, 5.0, 5.0), (11, 2.0, 7.0), (10, 0.0, 7.0)]


def test_cut(spark):
    und = G.symmetrize_edges(spark.createDataFrame([(0, 1), (1, 2), (3, 1), (2, 4), (4, 3), (1, 0)], "src long, dst long"))
    assert und.count() == 5
    sel = greedy_select(O.cut_cells(und), 3).orderBy("rank").collect()
    assert [(r.doc_id, r.gain, r.score) for r in sel] == [(1, 3.0, 3.0), (4, 2.0, 5.0), (0, -1.0, 4.0)]


def test_categories(spark):
    links = spark.createDataFrame([("R", "X"), ("R", "Y"), ("X", "Z"), ("Z", "R")], "parent string, child string")
    pages = spark.createDataFrame([(1, "R"), (2, "X"), (3, "Z"), (3, "Y"), (4, "other")], "doc_id long, category string")
    assert sorted(r.doc_id for r in G.category_extract(links, pages, ["R"]).collect()) == [1, 2, 3]
    assert sorted(r.doc_id for r in G.category_extract(links, pages, ["R"], max_depth=1).collect()) == [1, 2, 3]
    assert G.largest_category(pages).first().category in {"R", "X", "Y", "Z", "other"}


@pytest.fixture(scope="module")
def small(spark):
    post = spark.createDataFrame([(1, "a", 0.8), (1, "b", 0.6), (2, "b", 1.0), (3, "c", 0.6), (3, "d", 0.8)],
                                 "doc_id long, term string, weight double")
    counts = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1), ("d", 1)], "term string, df long")
    edges = spark.createDataFrame([(1, 7), (1, 8), (1, 9)], "doc_id long, src_id long")
    rev = spark.createDataFrame([(1, 2, 100), (3, 0, 1)], "doc_id long, rev_count long, rev_volume long")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    return post, counts, edges, rev, docs


def test_document_boost_flags(small):
    post, counts, edges, rev, docs = small
    want = {"000": 1.0, "001": 5.60517, "010": 3.0, "011": 16.815511, "100": 4.0, "101": 22.420681,
            "110": 12.0, "111": 67.262042}
    for flags, value in want.items():
        inl, cnt, vol = (c == "1" for c in flags)
        b = {r.doc_id: round(r.boost, 6) for r in G.document_boost(docs, edges, rev, inl, cnt, vol).collect()}
        assert b[1] == value and b[2] == 1.0


def test_score_variants(spark, small):
    post, counts, edges, rev, docs = small
    sel = spark.createDataFrame([(1,), (3,)], "doc_id long")
    got = [round(r.score, 6) for r in score_variants(post, counts, sel, edges, rev).orderBy("flags").collect()]
    assert got == [0.690616, 2.410459, 1.437535, 6.597062, 1.810994, 8.690364, 4.798666, 25.436778]


def test_revisions_sum(spark, small):
    rev = small[3]
    assert _scores(score_sets(O.revisions_cells(rev), _sets(spark, [[1], [2], [1, 2, 3]]))) == {0: 1.0, 1: 0.0, 2: 1.0}


def test_neighbours_and_cosine(spark, small):
    post = small[0]
    dates = spark.createDataFrame([(1, 2000), (2, 2001), (3, 2001)], "doc_id long, period int")
    nb = {r.doc_id: (r.neighbor_id, round(r.dot, 6)) for r in past_neighbor_exact(post, dates).collect()}
    assert nb == {2: (1, 0.6), 3: (1, 0.0)}
    dots = {(r.doc_a, r.doc_b): round(r.dot, 6) for r in cosine_similarity(post, 1e-6).collect()}
    assert dots == {(1, 2): 0.6}


def test_salted_pair_joins_equal_plain(spark):
    """Forcing every key to be 'hot' (max_group_rows=1) must not change results."""
    import random
    rnd = random.Random(11)
    rows = [(d, f"w{t}", rnd.random()) for d in range(25) for t in rnd.sample(range(6), 3)]
    post = spark.createDataFrame(rows, "doc_id long, term string, weight double")
    dates = spark.createDataFrame([(d, d % 4) for d in range(25)], "doc_id long, period int")
    buckets = spark.createDataFrame([(b, d % 3, d) for b in range(2) for d in range(25)], "band int, bucket long, doc_id long")
    from corpuslens.operators.neighbors import past_neighbor_lsh
    rnd6 = lambda df, cols: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())
    assert rnd6(cosine_similarity(post, 1e-6, max_group_rows=1), ["doc_a", "doc_b", "dot"]) == \
        rnd6(cosine_similarity(post, 1e-6), ["doc_a", "doc_b", "dot"])
    assert rnd6(past_neighbor_exact(post, dates, max_group_rows=1), ["doc_id", "neighbor_id", "dot"]) == \
        rnd6(past_neighbor_exact(post, dates), ["doc_id", "neighbor_id", "dot"])
    assert rnd6(past_neighbor_lsh(post, buckets, dates, max_group_rows=2), ["doc_id", "neighbor_id", "dot"]) == \
        rnd6(past_neighbor_lsh(post, buckets, dates), ["doc_id", "neighbor_id", "dot"])
