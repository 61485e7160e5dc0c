"""Threshold pairs and best earlier neighbours against brute force, copies included."""
import random

import pytest

from corpuslens.operators.neighbors import past_neighbor_exact
from corpuslens.operators.similarity import cosine_similarity, prefix_index, vector_classes


def corpus(seed: int, n=60, vocabulary=80, size=8):
    rnd, docs = random.Random(seed), {}
    for d in range(n):
        if d > 5 and rnd.random() < 0.4:                     # a near or exact copy
            v = dict(docs[rnd.randrange(d)])
            if rnd.random() < 0.6:
                v[f"w{rnd.randrange(vocabulary)}"] = rnd.random()
        else:
            v = {f"w{int(vocabulary * rnd.random() ** 2)}": 0.05 + rnd.random() for _ in range(size)}
        norm = sum(x * x for x in v.values()) ** 0.5
        docs[d] = {t: x / norm for t, x in v.items()}
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(d, t, x) for d, v in docs.items() for t, x in v.items()], "doc_id long, term string, weight double")


def dot(a, b):
    return sum(x * b[t] for t, x in a.items() if t in b)


@pytest.mark.parametrize("least", [0.3, 0.8])
def test_pairs_of_representatives(spark, least):
    docs = corpus(1)
    post = frame(spark, docs).repartition(4)
    classes = {r["doc_id"]: r["class_id"] for r in vector_classes(post).collect()}
    for d, v in docs.items():
        assert classes[d] == min(e for e, u in docs.items() if u.keys() == v.keys() and all(abs(u[t] - v[t]) < 1e-9 for t in u))
    reps = [d for d in docs if classes[d] == d]
    assert len(reps) < len(docs)
    stats = {}
    got = {(r["doc_a"], r["doc_b"]): r["dot"] for r in cosine_similarity(post, least, stats=stats).collect()}
    want = {(a, b): dot(docs[a], docs[b]) for a in reps for b in reps if a < b and dot(docs[a], docs[b]) >= least}
    assert got.keys() == want.keys() and want and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert stats["indexed"] < stats["postings"] and len(want) <= stats["candidates"] <= stats["meetings"]


def test_prefix_keeps_rare_terms_and_leaves_out_light_ends(spark):
    docs = {0: {"rare": 0.9, "all": (1 - 0.81) ** 0.5}, 1: {"other": 0.6, "all": 0.8}, 2: {"all": 1.0}}
    index = {(r["doc_id"], r["term"]) for r in prefix_index(frame(spark, docs), 0.7).collect()}
    assert index == {(0, "rare"), (1, "other"), (1, "all"), (2, "all")}


@pytest.mark.parametrize("seed", [3, 4])
def test_best_earlier_neighbour(spark, seed):
    docs = corpus(seed)
    dates = {d: d % 7 for d in docs}
    stats = {}
    rows = past_neighbor_exact(frame(spark, docs).repartition(3), spark.createDataFrame(sorted(dates.items()), "doc_id long, period int"), stats=stats)
    got = {r["doc_id"]: (r["neighbor_id"], r["dot"]) for r in rows.collect()}
    for d in docs:
        before = [e for e in docs if (dates[e], e) < (dates[d], d)]
        if not before:
            assert d not in got
            continue
        best = min(before, key=lambda e: (-round(dot(docs[d], docs[e]), 9), e))
        assert got[d][0] == best and abs(got[d][1] - dot(docs[d], docs[best])) < 1e-9
    assert stats["documents"][-1] < len(docs)                # some were settled before the last block
    assert stats["pairs"] < stats["all_pairs"] / 2


def test_pairs_of_documents_are_not_staged(spark, monkeypatch):
    """Every document shares a term with every other; what is staged follows the documents.
    Copies of a date row weigh a document's vector like before."""
    import corpuslens.operators.blocks as B
    import corpuslens.operators.neighbors as N
    keep, staged = N.materialize, []

    def counting(df, mode="checkpoint"):
        out = keep(df, mode)
        staged.append(out.count())
        return out
    monkeypatch.setattr(N, "materialize", counting)
    monkeypatch.setattr(B, "materialize", counting)
    monkeypatch.setattr(B, "BLOCK_DOCS", 50)
    n = 300
    docs = {d: {"all": 0.5, f"w{d % 40}": 0.5 + (d * 7 % 11) / 100} for d in range(n)}
    dates = [(d, d * 13 % 5) for d in range(n)] + [(7, 7 * 13 % 5)]
    got = {r["doc_id"]: (r["neighbor_id"], round(r["dot"], 9)) for r in past_neighbor_exact(
        frame(spark, docs), spark.createDataFrame(dates, "doc_id long, period int")).collect()}
    when, times = dict(dates), lambda d: 2 if d == 7 else 1
    for d in docs:
        before = [(round(times(d) * times(e) * dot(docs[d], docs[e]), 9), -e) for e in docs if (when[e], e) < (when[d], d)]
        assert got.get(d) == ((-max(before)[1], max(before)[0]) if before else None)
    assert staged and max(staged) < n * n / 10


def test_bad_threshold_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, term string, weight double")
    with pytest.raises(ValueError):
        cosine_similarity(none, 0.0)
    assert cosine_similarity(none, 0.5).count() == 0
    assert past_neighbor_exact(none, spark.createDataFrame([], "doc_id long, period int")).count() == 0
