"""Counters of the writing pass, category closure over levels, dispatch over all documents."""

from pyspark.sql import functions as F

from corpuslens.functions.pages import PAGE_TYPES, page_type_counts, write_classified
from corpuslens.operators import graph as G
from corpuslens.plans.summarize import choose_objective, summarize
from corpuslens.sources.files import write_counted


def test_page_types_are_counted_while_written(spark, tmp_path):
    kinds = ["ARTICLE"] * 5 + ["STUB"] * 2 + ["REDIRECT"]
    pages = spark.createDataFrame([(i, k) for i, k in enumerate(kinds)], "doc_id long, page_type string").repartition(3)
    got = write_classified(pages, str(tmp_path / "pages"))
    assert got == {"TOTAL": 8, **{t: kinds.count(t) for t in PAGE_TYPES}}
    again = spark.read.parquet(str(tmp_path / "pages"))
    assert {r.page_type: r.pages for r in page_type_counts(again).collect()} == {k: n for k, n in got.items() if n}
    nulls = spark.createDataFrame([(None,), (3,), (-1,)], "x int")
    assert write_counted(nulls, str(tmp_path / "x"), {"positive": F.col("x") > 0}) == {"TOTAL": 3, "positive": 1}
    assert write_counted(nulls.limit(0), str(tmp_path / "y"), {"positive": F.col("x") > 0}) == {"TOTAL": 0, "positive": 0}


def test_closure_of_deep_chains_and_cycles(spark, monkeypatch):
    monkeypatch.setattr(G, "MERGED", 2)
    chain = [(f"c{i}", f"c{i + 1}") for i in range(6)]
    links = spark.createDataFrame(chain + [("c6", "c2"), ("c4", "c0"), ("c5", "side"), ("c5", None), ("other", "far"), ("c5", "side")],
                                  "parent string, child string").coalesce(1).cache()
    everything = {f"c{i}" for i in range(7)} | {"side"}
    got = [r.category for r in G.category_closure(links, ["c0"]).collect()]
    assert len(got) == len(set(got)) and set(got) == everything
    got = [r.category for r in G.category_closure(links, ["c0", "c0"], max_depth=2).collect()]
    assert sorted(got) == [f"c{i}" for i in range(3)]
    assert [r.category for r in G.category_closure(links, ["nowhere"]).collect()] == ["nowhere"]


def test_graph_branch_offers_documents_without_inlinks(spark):
    post = spark.createDataFrame([(i, "a", 1.0) for i in (1, 2, 3, 9)], "doc_id long, term string, weight double")
    edges = spark.createDataFrame([(1, 2), (1, 3)], "doc_id long, src_id long")
    picks = summarize(choose_objective(post, 1, edges=edges), 2, method="greedy").collect()
    assert sorted((r.rank, r.doc_id, r.gain) for r in picks)[:2] == [(1, 1, 3.0), (2, 9, 1.0)]
    docs = spark.createDataFrame([(1,), (5,)], "doc_id long")
    picks = summarize(choose_objective(post, 1, edges=edges, docs=docs), 2, method="greedy").collect()
    assert [r.doc_id for r in sorted(picks, key=lambda r: r.rank)][:2] == [1, 5]


def test_boost_flags_of_the_dispatch(spark):
    post = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0)], "doc_id long, term string, weight double")
    edges = spark.createDataFrame([(1, 2), (1, 3)], "doc_id long, src_id long")
    revisions = spark.createDataFrame([(2, 4, 1)], "doc_id long, rev_count int, rev_volume long")

    def best(**flags):
        objective = choose_objective(post, 2, edges=edges, revisions=revisions, **flags)
        assert objective.name == "boosted_word_coverage"
        return {r.doc_id: round(r.value, 6) for r in objective.cells().select("doc_id", "value").collect()}
    everything, plain = best(), best(use_inlinks=False, use_count=False, use_volume=False)
    assert everything[1] / plain[1] == 3 and everything[2] / plain[2] == 5
    only = best(use_count=False)
    assert only[1] / plain[1] == 3 and only[2] == plain[2]
