"""Properties on random small corpora (fixed seeds), checked against a
brute-force evaluation of the definitions in plain Python."""

import math
import random

import pytest

from corpuslens.functions import objectives as O
from corpuslens.operators.baseline import random_select, score_sets
from corpuslens.operators.greedi import greedi_select
from corpuslens.operators.greedy import greedy_select, lazy_greedy_select
from corpuslens.operators.local_greedy import lazy_greedy_local
from corpuslens.operators.lsh import lsh_buckets
from corpuslens.operators.novelty import novelty, word_spread


def corpus(seed, n_docs=12, vocab=10):
    rnd = random.Random(seed)
    rows = []
    for d in range(n_docs):
        terms = rnd.sample(range(vocab), rnd.randint(1, 5))
        ws = [rnd.random() for _ in terms]
        norm = math.sqrt(sum(w * w for w in ws))
        rows += [(d, f"w{t}", w / norm) for t, w in zip(terms, ws)]
    buckets = [(b, rnd.randint(0, 3), d) for b in range(2) for d in range(n_docs)]
    return rows, buckets


def brute_f(rows, buckets, S, lam_lsh=1.0, vocab_size=10):
    """Word coverage (1/#V) + lam * LSH bucket diversity, from the definitions."""
    cover = {}
    for d, t, w in rows:
        if d in S:
            cover[t] = max(cover.get(t, 0.0), w)
    f = sum(cover.values()) / vocab_size
    sizes, hits = {}, {}
    for b, k, d in buckets:
        sizes[(b, k)] = sizes.get((b, k), 0) + 1
        if d in S:
            hits[(b, k)] = hits.get((b, k), 0) + 1
    total = sum(sizes.values())
    f += lam_lsh * sum(math.sqrt(hits.get(key, 0)) * n / math.sqrt(n) for key, n in sizes.items()) / total
    return f


def brute_greedy(fn, docs, k):
    S, out = [], []
    for _ in range(k):
        base = fn(set(S))
        best = max((d for d in docs if d not in S), key=lambda d: (round(fn(set(S) | {d}) - base, 9), -d))
        out.append(best)
        S.append(best)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_family_equals_brute_force(spark, seed):
    rows, bks = corpus(seed)
    post = spark.createDataFrame(rows, "doc_id long, term string, weight double")
    buckets = spark.createDataFrame(bks, "band int, bucket long, doc_id long")
    cells = O.combine_cells({"wc": (O.word_coverage_cells(post, 10), 1.0), "lsh": (O.lsh_bucket_cells(buckets), 1.0)})
    docs = sorted({r[0] for r in rows})
    want = brute_greedy(lambda S: brute_f(rows, bks, S), docs, 5)
    ids = lambda df: [r.doc_id for r in df.orderBy("rank").collect()]
    assert ids(greedy_select(cells, 5)) == want
    assert ids(lazy_greedy_select(cells, 5, batch=2)) == want
    assert ids(greedi_select(cells, 5, partitions=1)) == want
    assert [d for d, _ in lazy_greedy_local(cells.toPandas(), 5)] == want
    # scores: f(empty) = 0, monotone, normalised <= 1 per objective, diminishing returns
    sets = [[], [want[0]], want[:2], want[:3], want[:5]]
    rows_sets = [(i, d) for i, s in enumerate(sets) for d in s] + [(0, -1)]
    sc = {r.trial: r.score for r in score_sets(cells, spark.createDataFrame(rows_sets, "trial int, doc_id long")).collect()}
    vals = [sc[i] for i in range(len(sets))]
    assert vals[0] == 0.0
    assert all(a <= b + 1e-12 for a, b in zip(vals, vals[1:]))
    assert all(abs(v - brute_f(rows, bks, set(s))) < 1e-9 for v, s in zip(vals, sets))
    assert vals[-1] <= 2.0 + 1e-9
    d = next(x for x in docs if x not in want[:3])
    g_small = brute_f(rows, bks, {want[0], d}) - brute_f(rows, bks, {want[0]})
    g_big = brute_f(rows, bks, set(want[:3]) | {d}) - brute_f(rows, bks, set(want[:3]))
    assert g_small >= g_big - 1e-12


@pytest.mark.parametrize("seed", [4, 5])
def test_influence_equals_brute_force(spark, seed):
    rows, _ = corpus(seed)
    rnd = random.Random(seed)
    dates = {d: rnd.randint(0, 3) for d in range(12)}
    nb = {d: rnd.choice([x for x in range(12) if dates[x] <= dates[d] and x != d] or [None]) for d in range(12)}
    post = spark.createDataFrame(rows, "doc_id long, term string, weight double")
    ddf = spark.createDataFrame(list(dates.items()), "doc_id long, period int")
    ndf = spark.createDataFrame([(d, n) for d, n in nb.items() if n is not None], "doc_id long, neighbor_id long")
    nv = {(r.doc_id, r.term): r.weight for r in novelty(post, ndf).collect()}
    assert all(0 < v <= w + 1e-12 for (d, t), v in nv.items() for dd, tt, w in rows if (dd, tt) == (d, t))
    sp = {(r.period, r.term): r.weight for r in word_spread(post, ddf).collect()}

    def f(S):
        return sum(th * max([nv.get((d, t), 0.0) for d in S if dates[d] <= y] or [0.0]) for (y, t), th in sp.items())

    cells = O.influence_cells(novelty(post, ndf), ddf, word_spread(post, ddf))
    want = brute_greedy(f, sorted({d for d, _ in nv}), 4)
    assert [r.doc_id for r in greedy_select(cells, 4).orderBy("rank").collect()] == want
    assert [r.doc_id for r in lazy_greedy_select(cells, 4, batch=1).orderBy("rank").collect()] == want
    assert [d for d, _ in lazy_greedy_local(cells.toPandas(), 4)] == want
    sets = spark.createDataFrame([(0, d) for d in want], "trial int, doc_id long")
    assert abs(score_sets(cells, sets).first().score - f(set(want))) < 1e-9


def test_buckets_and_random_selection(spark):
    rows, _ = corpus(7, n_docs=30)
    post = spark.createDataFrame(rows, "doc_id long, term string, weight double")
    b = lsh_buckets(post, bands=3, rows=4)
    per_doc = {r.doc_id: r["count"] for r in b.groupBy("doc_id").count().collect()}
    assert set(per_doc.values()) == {3} and len(per_doc) == 30
    assert b.filter("bucket < 0 OR bucket >= 16").count() == 0
    r1 = random_select(post, 5, trials=4, seed="s").collect()
    r2 = random_select(post, 5, trials=4, seed="s").collect()
    assert sorted(map(tuple, r1)) == sorted(map(tuple, r2))
    for t in range(4):
        ids = [r.doc_id for r in r1 if r.trial == t]
        assert len(ids) == 5 == len(set(ids))
