"""Headline timings at one scale factor; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Times (seconds, wall clock, each forced to full evaluation):
  postings           C1-C7: tokens -> tf -> stats -> pruned, normalised tf-idf
  greedy_select      G1, word coverage, k=10 (exact, distributed)
  lazy_greedy_select G2, same objective and k (+ share of docs re-evaluated)
  greedi_word_cov    G5, weighted word coverage, k=10, p=8
  lsh_buckets        E2+E3, 9 bands x 13 rows
  novelty            E5 past neighbour over the buckets + E9 novelty
  greedi_influence   G9 on the novelty/spread cells, k=10, p=8
Every query starts from parquet; tf-idf itself is timed (``postings``).  An
untimed warm-up runs the same code paths once on sf0.001 first (JIT and
Python workers), so the numbers are steady-state; BENCH_WARMUP=0 disables it.
``quality_k40`` (not part of the total, only with BENCH_QUALITY=1) mirrors the
relative to the set selected by GreeDi (k=40, p=8) under the same objective.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from corpuslens.session import get_session, materialize
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus))

    from pyspark.sql import functions as F

    from corpuslens.functions import objectives as O
    from corpuslens.operators import tfidf as C
    from corpuslens.operators.greedi import greedi_select
    from corpuslens.operators.greedy import greedy_select, lazy_greedy_select
    from corpuslens.operators.lsh import lsh_buckets
    from corpuslens.operators.neighbors import past_neighbor_lsh
    from corpuslens.operators.novelty import novelty, word_spread
    from corpuslens.sources import tables as TB

    times, extra = {}, {}

    # Untimed warm-up on the smallest scale factor (JIT compilation of the
    # code paths, Python workers); BENCH_WARMUP=0 skips it.
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    extra["warmup"] = os.environ.get("BENCH_WARMUP", "1") == "1" and os.path.isdir(warm_dir)
    if extra["warmup"]:
        wc0 = C.build_corpus(TB.documents(spark, warm_dir), cache="persist")
        w0 = O.weighted_word_coverage_cells(wc0.postings, wc0.kept, counts_rows=wc0.vocab_size)
        greedy_select(w0, 3, cache="persist").collect()
        lazy_greedy_select(w0, 2, cache="persist").collect()
        greedi_select(w0, 2, partitions=2, cache="persist").collect()
        lsh_buckets(wc0.postings, 9, 13).write.format("noop").mode("overwrite").save()

    def timed(name, fn):
        t0 = time.time()
        out = fn()
        times[name] = round(time.time() - t0, 3)
        return out

    def force(df):
        df.write.format("noop").mode("overwrite").save()
        return df

    docs = TB.documents(spark, sf_dir)
    corpus = timed("postings", lambda: C.build_corpus(docs))
    f1 = O.word_coverage_cells(corpus.postings, corpus.vocab_size)
    timed("greedy_select", lambda: greedy_select(f1, 10).collect())
    stats = {}
    timed("lazy_greedy_select", lambda: lazy_greedy_select(f1, 10, stats=stats).collect())
    extra["lazy_share_evaluated"] = round(stats.get("share_evaluated", 0.0), 4)
    wc = O.weighted_word_coverage_cells(corpus.postings, corpus.kept, counts_rows=corpus.vocab_size)
    timed("greedi_word_coverage", lambda: greedi_select(wc, 10, partitions=8).collect())
    dates = TB.doc_dates(spark, sf_dir)
    buckets = timed("lsh_buckets", lambda: materialize(lsh_buckets(corpus.postings, 9, 13), "checkpoint"))
    nov = timed("novelty", lambda: materialize(novelty(corpus.postings, past_neighbor_lsh(corpus.postings, buckets, dates)),
                                               "checkpoint"))
    spread = materialize(word_spread(corpus.postings, dates), "checkpoint")
    infl = O.influence_cells(nov, dates, spread)
    timed("greedi_influence", lambda: greedi_select(infl, 10, partitions=8).collect())

    # the published selections at their k, outside the total
    graph = O.graph_coverage_cells(TB.doc_edges(spark, sf_dir), candidates=docs)
    both = O.combine_cells({"wwc": (wc, 1.0), "lsh": (O.lsh_bucket_cells(buckets), 1.0)})
    k40 = {}
    for name, cells in (("greedi_word_coverage", wc), ("greedi_graph", graph), ("greedi_coverage_lsh", both), ("greedi_influence", infl)):
        t0 = time.time()
        greedi_select(cells, 40, partitions=8).collect()
        k40[name] = round(time.time() - t0, 3)

    quality = {}
    if os.environ.get("BENCH_QUALITY", "0") == "1":
        # BASELINE quality table: random sets of k=40 relative to the selected set
        from corpuslens.operators.baseline import random_select, score_sets
        t0 = time.time()
        lsh3 = O.combine_cells({"wwc": (wc, 1.0), "lsh": (O.lsh_bucket_cells(buckets), 1.0)})
        trials = random_select(docs, 40, trials=10)
        for name, cells in (("word_coverage", wc), ("word_coverage_lsh", lsh3), ("document_influence", infl)):
            sel = greedi_select(cells, 40, partitions=8).select(F.lit(-1).alias("trial"), "doc_id")
            sc = {r.trial: r.score for r in score_sets(cells, trials.select("trial", "doc_id").unionByName(sel)).collect()}
            rel = [sc[t] / sc[-1] for t in range(10)] if sc.get(-1) else []
            mean = sum(rel) / len(rel) if rel else None
            std = (sum((x - mean) ** 2 for x in rel) / (len(rel) - 1)) ** 0.5 if len(rel) > 1 else None
            quality[name] = {"random_relative_mean": round(mean, 4) if mean is not None else None,
                             "random_relative_std": round(std, 4) if std is not None else None}
        quality["seconds"] = round(time.time() - t0, 3)

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "queries_k40": k40, "cpus": cpus, "docs": corpus.n_docs, "vocabulary": corpus.vocab_size, **extra,
                      "quality_k40": quality}))
    spark.stop()


if __name__ == "__main__":
    main()
