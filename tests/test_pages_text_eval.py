"""FIXTURES.md §5-§6: pages, ids, dates, text weights and evaluation."""

import math

from pyspark.sql import functions as F

from corpuslens.functions import pages as P
from corpuslens.operators import tfidf as C
from corpuslens.operators.report import citation_bound, citation_count, cosine_diff, vector_diff
from corpuslens.sources import files as IO


def test_classify_page(spark):
    rows = [("a", "x" * 10, True, False, False, True), ("b", "", False, False, False, True),
            ("Mercury (disambiguation)", "text", False, False, False, True), ("c", "text", False, False, True, True),
            ("List of kings", "x" * 5000, False, False, False, True), ("t" * 10, "x" * 900, False, False, False, True),
            ("t" * 10, "x" * 1000, False, False, False, True), ("n", "text", False, False, False, False)]
    df = spark.createDataFrame(rows, "title string, content string, is_redirect boolean, is_disambig boolean, "
                                     "is_stub boolean, is_article boolean")
    got = [r.page_type for r in P.classify_pages(df).collect()]
    assert got == ["REDIRECT", "EMPTY", "DISAMBIGUATION", "STUB", "LIST", "OTHER", "ARTICLE", "NON_ARTICLE"]


def test_dates_and_keys(spark):
    df = spark.createDataFrame([("2012-10-01T00:00:00Z", 120345, "P05-1012", "file is ../nipsdata/txt/nips12/0345.txt")],
                               "ts string, id long, aan string, nips string")
    r = df.select(P.document_date(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ssX").alias("d"),
                  P.date_from_id("id").alias("p"), P.aan_key(F.col("aan")).alias("a"),
                  P.nips_key(F.col("nips")).alias("n")).first()
    assert (r.d, r.p, r.a, r.n) == (2012275, 12, 80051012, 120345)
    ids = spark.createDataFrame([(-1,), (0,), (10,), (11,)], "doc_id long")
    assert [x.p for x in ids.select(P.partition_of(F.col("doc_id"), 10).alias("p")).collect()] == [9, 0, 0, 1]
    assert spark.createDataFrame([(80051012,)], "id long").select(P.date_from_id("id").alias("p")).first().p == 5


def test_idf_sigma_norm(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "df long")
    got = [round(r.i, 6) for r in df.select(C.idf(F.col("df"), 3).alias("i")).collect()]
    assert got == [1.405465, 1.0, 0.712318]
    stats = spark.createDataFrame([("a", 1, 9), ("b", 2, 9), ("c", 1, 9), ("d", 1, 9)], "term string, df long, wc long")
    assert math.isclose(C.df_sigma(stats), 1.322876, abs_tol=1e-6)
    post = spark.createDataFrame([(1, "a", 3.0), (1, "b", 4.0)], "doc_id long, term string, weight double")
    assert {r.term: round(r.weight, 6) for r in C.l2_normalize(post).collect()} == {"a": 0.6, "b": 0.8}


def test_tokenize_stop_words_only_english(spark):
    docs = spark.createDataFrame([(1, "The cat and the hat", "en"), (2, "The cat and the hat", "fr")],
                                 "doc_id long, text string, lang string")
    toks = {(r.doc_id, r.term) for r in C.tokenize(docs).collect()}
    assert (1, "the") not in toks and (2, "the") in toks and (1, "cat") in toks


def test_citations(spark):
    cites = spark.createDataFrame([(1, 5), (2, 9), (3, 2), (4, 9)], "paper_id long, cites int")
    got = {r.metric: r.citations for r in citation_bound(cites, 2).collect()}
    assert got == {"best": 18, "total": 25}
    sel = spark.createDataFrame([(1,), (3,), (99,)], "doc_id long")
    assert citation_count(sel, cites).first().citations == 7


def test_vector_and_cosine_diff(spark):
    a = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0)], "doc_id long, term string, weight double")
    b = spark.createDataFrame([(1, "a", 1.0), (1, "c", 2.0), (9, "a", 1.0)], "doc_id long, term string, weight double")
    got = {r.doc_id: (round(r.sq_dist, 6), r.status) for r in vector_diff(a, b).collect()}
    assert got == {1: (8.0, "over"), 9: (1.0, "missing_left")}
    ours = spark.createDataFrame([(1, 2, 0.6)], "doc_a long, doc_b long, dot double")
    ref = spark.createDataFrame([(1, 2, 0.4)], "doc_a long, doc_b long, value double")
    assert round(cosine_diff(ours, ref).first().error, 9) == 0.0


def test_dense_matrix_reader(spark, tmp_path):
    m, n = tmp_path / "m", tmp_path / "n"
    m.mkdir(), n.mkdir()
    (m / "part-00000.txt").write_text("0.5 0.000001 0\n0 2 0\n")
    (n / "part-00000.txt").write_text("7\n8\n")
    got = {(r.doc_id, r.term, r.weight) for r in IO.read_dense_matrix(spark, str(m), str(n)).collect()}
    assert got == {(7, "0", 0.5), (8, "1", 2.0)}


def test_edge_and_revision_readers(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# comment\n10 1\n10  2\n\n11 3\n")
    (tmp_path / "r.txt").write_text("1 2 100\n3 0\n")
    e = {(r.doc_id, r.src_id) for r in IO.read_edge_list(spark, str(tmp_path / "e.txt")).collect()}
    assert e == {(10, 1), (10, 2), (11, 3)}
    r = {x.doc_id: (x.rev_count, x.rev_volume) for x in IO.read_revision_stats(spark, str(tmp_path / "r.txt")).collect()}
    assert r == {1: (2, 100), 3: (0, None)}


def test_possessive_stripped_for_english_only(spark):
    docs = spark.createDataFrame([(1, "John's book and Mary’s pen's.", "en"), (2, "John's book", "fr")],
                                 "doc_id long, text string, lang string")
    toks = sorted((r.doc_id, r.term) for r in C.tokenize(docs).collect())
    assert toks == [(1, "book"), (1, "john"), (1, "mary"), (1, "pen"), (2, "book"), (2, "john"), (2, "s")]
