"""Readers/writers round trips, objective dispatch, summarize and k-means."""

import pytest

from corpuslens.functions import objectives as O
from corpuslens.operators.cluster import dense_features, kmeans_docs, sketch_kmeans
from corpuslens.plans.summarize import CellsObjective, choose_objective, summarize
from corpuslens.sources import files as IO


def test_wiki_dump_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "Alpha", "  text with {{stub}} &amp; <b>", "2012-10-01T00:00:00Z"),
                                   (2, "Beta", "Foo may be {{disambiguation}}", None)],
                                  "doc_id long, title string, text string, ts string")
    IO.write_wiki_dump(pages, str(tmp_path / "dump"))
    got = {r.doc_id: r for r in IO.read_wiki_dump(spark, str(tmp_path / "dump")).collect()}
    assert got[1].text == "  text with {{stub}} &amp; <b>" and got[1].is_stub and not got[1].is_disambig
    assert got[2].is_disambig and got[1].ts == "2012-10-01T00:00:00Z" and got[1].is_article


def test_text_dir_selection_and_citations(spark, tmp_path):
    docs = spark.createDataFrame([(3, "line one\nline two"), (5, "x")], "doc_id long, text string")
    IO.write_text_dir(docs, str(tmp_path / "txt"))
    assert {(r.doc_id, r.text) for r in IO.read_text_dir(spark, str(tmp_path / "txt")).collect()} == \
        {(3, "line one\nline two"), (5, "x")}
    sel = spark.createDataFrame([(1, 9, 0.5, 0.5), (2, 4, 0.1, 0.6)], "rank int, doc_id long, gain double, score double")
    IO.write_selection(sel, str(tmp_path / "sel"), as_text=True)
    assert [r.doc_id for r in IO.read_selection(spark, str(tmp_path / "sel"), as_text=True).collect()] == [9, 4]
    (tmp_path / "aan.tsv").write_text("5\tP05-1012\n\n7\t\n2\tQ01-0001\n")
    assert {(r.paper_id, r.cites) for r in IO.read_citations_aan(spark, str(tmp_path / "aan.tsv")).collect()} == \
        {("P05-1012", 5), ("Q01-0001", 2)}
    (tmp_path / "ids").mkdir(), (tmp_path / "cnt").mkdir()
    (tmp_path / "ids" / "part-00000").write_text("file is ../nipsdata/txt/nips12/0345.txt\nfile is ../nipsdata/txt/nips01/0001.txt\n")
    (tmp_path / "cnt" / "part-00000").write_text("a 4 b\nc 9\n")
    got = {r.paper_line[-8:]: r.cites for r in IO.read_citations_nips(spark, str(tmp_path / "ids"), str(tmp_path / "cnt")).collect()}
    assert got == {"0345.txt": 4, "0001.txt": 9}


def test_wiki_tables_csv(spark, tmp_path):
    paths = {}
    for name, rows, schema in [("p", [(1, "A")], "doc_id long, title string"), ("l", [(2, 1)], "src_id long, doc_id long"),
                               ("c", [("R", "X")], "parent string, child string"), ("pc", [(1, "X")], "doc_id long, category string")]:
        paths[name] = str(tmp_path / name)
        spark.createDataFrame(rows, schema).write.option("header", "true").csv(paths[name])
    t = IO.read_wiki_tables(spark, paths["p"], paths["l"], paths["c"], paths["pc"], fmt="csv")
    assert t["page_categories"].collect()[0].category == "X" and t["page_links"].first().src_id == 2


@pytest.fixture(scope="module")
def small(spark):
    post = spark.createDataFrame([(1, "a", 0.8), (1, "b", 0.6), (2, "b", 1.0), (3, "c", 0.6), (3, "d", 0.8)],
                                 "doc_id long, term string, weight double")
    counts = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 1, 1), ("d", 1, 1)], "term string, df long, wc long")
    buckets = spark.createDataFrame([(0, 1, 1), (0, 1, 2), (0, 2, 3), (1, 3, 1), (1, 3, 2), (1, 3, 3)],
                                    "band int, bucket long, doc_id long")
    return post, counts, buckets


def test_dispatch_and_summarize(spark, small):
    post, counts, buckets = small
    assert choose_objective(post, 4).name == "word_coverage"
    assert choose_objective(post, 4, counts=counts).name == "weighted_word_coverage"
    obj = choose_objective(post, 4, counts=counts, buckets=buckets)
    assert obj.name == "word_coverage_lsh"
    rows = summarize(obj, 3, method="greedi", partitions=1).orderBy("rank").collect()
    assert [(r.objective, r.doc_id, round(r.score, 6)) for r in rows] == \
        [("word_coverage_lsh", 1, 0.897836), ("word_coverage_lsh", 3, 1.501234), ("word_coverage_lsh", 2, 1.818767)]
    custom = CellsObjective("mine", O.word_coverage_cells(post, 4))
    assert [r.doc_id for r in summarize(custom, 2, method="lazy").orderBy("rank").collect()] == [1, 3]
    assert [r.doc_id for r in summarize(O.word_coverage_cells(post, 4), 2, method="greedy").orderBy("rank").collect()] == [1, 3]


def test_kmeans(spark):
    rows = [(i, [float(i % 2) * 10 + 0.01 * i, 1.0]) for i in range(40)]
    feats = dense_features(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    for out in (kmeans_docs(feats, k=2), sketch_kmeans(feats, k=2, sketch_size=8, partitions=2)):
        got = {r.doc_id: r.cluster for r in out.collect()}
        assert len(got) == 40
        assert len({got[i] for i in range(0, 40, 2)}) == 1 and len({got[i] for i in range(1, 40, 2)}) == 1
        assert got[0] != got[1]
