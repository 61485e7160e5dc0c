"""Document influence on the three-document corpus (FIXTURES.md §3)."""

import pytest

from corpuslens.functions import objectives as O
from corpuslens.operators.baseline import score_sets
from corpuslens.operators.greedi import greedi_select
from corpuslens.operators.greedy import greedy_select, lazy_greedy_select
from corpuslens.operators.local_greedy import lazy_greedy_local
from corpuslens.operators.novelty import novelty, word_spread


@pytest.fixture(scope="module")
def inputs(spark):
    post = spark.createDataFrame([(1, "a", 0.8), (1, "b", 0.6), (2, "b", 1.0), (3, "c", 0.6), (3, "d", 0.8)],
                                 "doc_id long, term string, weight double")
    dates = spark.createDataFrame([(1, 2000), (2, 2001), (3, 2001)], "doc_id long, period int")
    nbr = spark.createDataFrame([(2, 1)], "doc_id long, neighbor_id long")
    return post, dates, nbr


def _sets(spark, groups):
    rows = [(i, d) for i, g in enumerate(groups) for d in g]
    return spark.createDataFrame(rows, "trial int, doc_id long")


def test_spread_and_novelty(spark, inputs):
    post, dates, nbr = inputs
    sp = {(r.period, r.term): round(r.weight, 6) for r in word_spread(post, dates).collect()}
    assert sp == {(2000, "a"): 0.8, (2000, "b"): 0.6, (2001, "b"): 1.0, (2001, "c"): 0.6, (2001, "d"): 0.8}
    nv = {(r.doc_id, r.term): round(r.weight, 6) for r in novelty(post, nbr).collect()}
    assert nv == {(1, "a"): 0.8, (1, "b"): 0.6, (2, "b"): 0.4, (3, "c"): 0.6, (3, "d"): 0.8}
    assert {r.doc_id for r in novelty(post, nbr, ignore_isolated=True).collect()} == {2}


def test_document_influence_scores(spark, inputs):
    post, dates, nbr = inputs
    cells = O.influence_cells(novelty(post, nbr), dates, word_spread(post, dates))
    got = {r.trial: round(r.score, 6) for r in score_sets(cells, _sets(spark, [[1], [2], [3], [1, 3], [1, 2, 3]])).collect()}
    assert got == {0: 1.6, 1: 0.4, 2: 1.0, 3: 2.6, 4: 2.6}
    strict = O.influence_cells(novelty(post, nbr), dates, word_spread(post, dates), strict=True)
    got = {r.trial: round(r.score, 6) for r in score_sets(strict, _sets(spark, [[1], [2], [3]])).collect()}
    assert got == {0: 0.6, 1: 0.0, 2: 0.0}


def test_influence_greedy(spark, inputs):
    post, dates, nbr = inputs
    cells = O.influence_cells(novelty(post, nbr), dates, word_spread(post, dates))
    want = [(1, 1.6), (3, 1.0), (2, 0.0)]
    for sel in (greedy_select(cells, 3), lazy_greedy_select(cells, 3, batch=1), greedi_select(cells, 3, partitions=2)):
        assert [(r.doc_id, round(r.gain, 6)) for r in sel.orderBy("rank").collect()] == want
    assert [(d, round(g, 6)) for d, g in lazy_greedy_local(cells.toPandas(), 3)] == want


def test_influence_doc_dates(spark, inputs):
    post, dates, nbr = inputs
    nv, sp = novelty(post, nbr), word_spread(post, dates)
    got = {r.trial: round(r.score, 6) for r in O.influence_doc_dates_scores(nv, dates, sp, _sets(spark, [[1], [3], [1, 3]])).collect()}
    # {1}: only 2000 counts: a .8*.8 + b .6*.6 = 1.0; {3}: 2001: c .6*.6 + d .8*.8 = 1.0
    # {1,3}: 2000 -> 1.0, 2001 -> b 1.0*.6 + c .36 + d .64 = 1.6; total 2.6
    assert got == {0: 1.0, 1: 1.0, 2: 2.6}
