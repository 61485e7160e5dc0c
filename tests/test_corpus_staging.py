"""What the corpus keeps on disk and in memory, and what dedup_by_id moves."""

from corpuslens.operators import tfidf as C
from corpuslens.operators.novelty import dedup_by_id


def test_term_counts_are_not_cached(spark):
    """A cached copy of all (doc, term) counts spills several times the text."""
    docs = spark.createDataFrame([(i, f"one two w{i % 3} Two", "en") for i in range(9)] + [(4, "one more", "en"), (None, "two", "en"), (20, None, "en")],
                                 "doc_id long, text string, lang string")
    c = C.build_corpus(docs, min_wc=2, min_df=2, max_df_sigma=None)
    assert c.tf.storageLevel.useMemory is c.tf.storageLevel.useDisk is False
    assert {(r.doc_id, r.term): r.tf for r in c.tf.collect()}[(4, "one")] == 2          # one id, two rows
    assert all(df.inputFiles() and not df.storageLevel.useMemory for df in (c.stats, c.kept, c.postings))
    assert {r.term: (r.df, r.wc) for r in c.stats.collect()}["two"] == (10, 19)
    norms = c.postings.groupBy("doc_id").agg({"weight": "count"}).count()
    assert norms == 10 and abs(sum(r.weight ** 2 for r in c.postings.filter("doc_id = 4").collect()) - 1) < 1e-9


def test_dedup_by_id_leaves_dealt_vectors_in_place(spark):
    rows = [(d, b, f"t{t}", (d or 0) + t / 10) for d in (1, 2, None) for b in (2, 1, None) for t in range(2)]
    rows += [(3, None, "t0", 1.0), (1, 1, "t0", 1.0)]
    vectors = spark.createDataFrame(rows, "doc_id long, band int, term string, weight double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = dedup_by_id(vectors.repartition(4, "doc_id"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.doc_id, r.term, r.weight) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [(1, "t0", 1.0), (1, "t0", 1.0), (1, "t1", 1.1), (2, "t0", 2.0), (2, "t1", 2.1)]
    assert plan.count("Exchange hashpartitioning") == 2                                # the two readings of the dealt table


def test_term_counts_of_a_task_are_bounded(spark, sf_dir, monkeypatch):
    """More text gives more tasks, not larger ones; the counts stay the same."""
    from corpuslens.operators import tfidf as C
    docs = spark.createDataFrame([(d % 90, f"word{d} word{d % 7} other " * 20, "en" if d % 2 else None) for d in range(100)] + [(None, "x y", "en"), (5, None, "en")],
                                 "doc_id long, text string, lang string")
    few = C.build_corpus(docs).tf
    size = sum(len(r["text"] or "") for r in docs.collect())
    monkeypatch.setattr(C, "TASK_TEXT", size // 20)
    many = C.build_corpus(docs).tf
    assert many.rdd.getNumPartitions() >= 20 > few.rdd.getNumPartitions()
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))
    assert C.build_corpus(docs.limit(0)).tf.count() == 0
