"""Driver contract: flagship query and registry shape (sf0.001)."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["rank", "doc_id", "gain", "score"]
    assert 0 < len(rows) <= 5


def test_registry_shape():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80
    missing = {k for k in set(q) - set(o) if k not in E.LLM_QUERIES}
    assert missing == {"kmeans_docs", "sketch_kmeans"}


def test_some_queries_run(spark, sf_dir):
    q = E.queries()
    for key in ("word_coverage", "greedi_word_coverage", "classify_page", "lsh_buckets", "document_influence"):
        assert q[key](spark, sf_dir).count() >= 0
