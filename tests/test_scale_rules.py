"""Faults found by review: uneven parts, isolated nodes, bad lines, 64-bit ids."""

import os

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import objectives as O
from corpuslens.functions.pages import document_date
from corpuslens.operators.greedi import greedi_first, greedi_select, part_of
from corpuslens.operators.greedy import greedy_select, lazy_greedy_select
from corpuslens.operators.ordered import ordered_predecessor
from corpuslens.sources.files import read_edge_list, read_revision_stats


def cells_of(spark, rows, kind="max"):
    return spark.createDataFrame([(d, c, kind, t, v, None) for d, c, t, v in rows],
                                 "doc_id long, cell string, kind string, theta double, value double, t int")


def picks(df):
    return [(r.rank, r.doc_id, round(r.gain, 9)) for r in df.orderBy("rank").collect()]


def test_strided_ids_use_all_parts(spark):
    for stride in (1, 8, 16, 1000, 65536):
        n = spark.range(0, 2000 * stride, stride).groupBy(part_of(F.col("id"), 16).alias("p")).count().collect()
        assert len(n) == 16 and max(r["count"] for r in n) < 250


def test_document_with_a_third_of_all_cells(spark):
    rows = [(0, f"c{i}", 1.0, 0.5) for i in range(100)] + [(d, f"c{(d * 7 + j) % 100}", 1.0, 1.0) for d in range(1, 40) for j in range(5)]
    cells = cells_of(spark, rows)
    assert picks(greedi_select(cells, 4, partitions=1)) == picks(greedy_select(cells, 4))
    first = greedi_first(cells, 3, 4).collect()
    for p in {r.part for r in first}:
        own = greedy_select(cells.filter(part_of(F.col("doc_id"), 4) == p), 3)
        assert [(r.rank, r.doc_id, round(r.gain, 9)) for r in sorted(first, key=lambda r: r.rank) if r.part == p] == picks(own)


def test_node_without_inlinks_covers_itself(spark):
    edges = spark.createDataFrame([(10, 1), (10, 2)], "doc_id long, src_id long")
    docs = spark.createDataFrame([(10,), (99,)], "doc_id long")
    cells = O.graph_coverage_cells(edges, candidates=docs)
    score = lambda *ids: O.score(cells, spark.createDataFrame([(i,) for i in ids], "doc_id long")).first().score
    assert score(99) == 1.0 and score(10, 99) == 4.0


def test_unknown_kind_is_refused(spark):
    cells = cells_of(spark, [(1, "a", 1.0, 1.0)], kind="median")
    for run in (lambda: greedy_select(cells, 1), lambda: greedi_select(cells, 1)):
        with pytest.raises(ValueError, match="unknown kind"):
            run()
    with pytest.raises(Exception, match="unknown kind"):
        O.score(cells, cells.select("doc_id")).collect()


def test_bad_lines_do_not_end_the_job(spark, tmp_path):
    path = os.path.join(tmp_path, "lines.txt")
    with open(path, "w") as f:
        f.write("# comment\n1 2\n3\n\nx y\n4 5 6\n   \n7 8 z\n")
    assert sorted(tuple(r) for r in read_edge_list(spark, path).collect()) == [(1, 2), (4, 5), (7, 8)]
    assert sorted(tuple(r) for r in read_revision_stats(spark, path).collect()) == [(1, 2, None), (4, 5, 6), (7, 8, None)]


def test_bad_dates_are_null(spark):
    df = spark.createDataFrame([("2012-10-01T00:00:00Z",), ("not a date",), (None,)], "ts string")
    assert [r.d for r in df.select(document_date(F.col("ts")).alias("d")).collect()] == [2012275, None, None]


def test_predecessor_of_ids_above_two_to_the_53(spark):
    big = 1 << 53
    df = spark.createDataFrame([(0, big + 1), (0, big + 3), (0, big + 5), (1, big + 7)], "g long, doc_id long")
    for parts in (1, 4):
        got = {r.doc_id - big: r.prev and r.prev - big for r in ordered_predecessor(df, ["g"], ["doc_id"], "doc_id", "prev", parts).collect()}
        assert got == {1: None, 3: 1, 5: 3, 7: None}


def test_lazy_greedy_with_a_term_that_all_documents_share(spark):
    """All bounds fall together after the first pick; only ids of a batch may leave Spark."""
    rows = [(d, "shared", 10.0, 1.0) for d in range(60)] + [(d, f"own{d}", 1.0, 0.1 + 0.001 * d) for d in range(60)]
    cells = cells_of(spark, rows)
    stats = {}
    assert picks(lazy_greedy_select(cells, 4, batch=2, stats=stats)) == picks(greedy_select(cells, 4))
    assert stats["evaluated_per_round"][1] >= 59
    with pytest.raises(ValueError, match="exactly_one"):
        lazy_greedy_select(cells_of(spark, rows, kind="exactly_one"), 2)
