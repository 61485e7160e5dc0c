"""Block products against brute force: small blocks, copies, repeated rows, groups; what queries leave undone."""
import random

import numpy as np
import pytest

import corpuslens.operators.blocks as B
from corpuslens.operators.neighbors import past_neighbor_lsh
from corpuslens.operators.report import cosine_diff_summary, vector_errors
from corpuslens.operators.similarity import all_dots


def corpus(seed, n=50, vocabulary=40, size=6, low=0.05):
    rnd, docs = random.Random(seed), {}
    for d in range(n):
        if d > 5 and rnd.random() < 0.3:
            docs[d] = dict(docs[rnd.randrange(d)])
            continue
        v = {f"w{int(vocabulary * rnd.random() ** 2)}": low + rnd.random() for _ in range(size)}
        norm = sum(x * x for x in v.values()) ** 0.5
        docs[d] = {t: x / norm for t, x in v.items()}
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(d, t, x) for d, v in docs.items() for t, x in v.items()], "doc_id long, term string, weight double").repartition(3)


def dot(a, b):
    return sum(x * b[t] for t, x in a.items() if t in b)


@pytest.fixture(params=[(4, 20, 60), (2048, 1 << 18, 1 << 22)])
def sizes(request, monkeypatch):
    for name, value in zip(("BLOCK_DOCS", "BLOCK_ROWS", "FLUSH_ROWS"), request.param):
        monkeypatch.setattr(B, name, value)


def test_every_pair_with_a_common_term(spark, sizes):
    docs = corpus(1)
    got = {(r.doc_a, r.doc_b): r.dot for r in all_dots(frame(spark, docs)).collect()}
    want = {(a, b): dot(docs[a], docs[b]) for a in docs for b in docs if a < b and docs[a].keys() & docs[b].keys()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert min(want.values()) < 0.3                               # no threshold


def test_repeated_rows_count_as_in_a_join(spark, sizes):
    rows = [(1, "a", 0.5), (1, "a", 0.5), (2, "a", 0.25), (2, "a", 0.25), (2, "b", 1.0), (3, "c", 1.0)]
    got = [tuple(r) for r in all_dots(spark.createDataFrame(rows, "doc_id long, term string, weight double")).collect()]
    assert got == [(1, 2, 0.5, 0.5)]


def test_best_earlier_mate_of_a_bucket(spark, sizes):
    docs = corpus(2)
    dates = {d: d * 7 % 5 for d in docs}
    rnd = random.Random(5)
    mates = {(b, d): rnd.randrange(4) for b in range(2) for d in docs}
    rows = past_neighbor_lsh(frame(spark, docs), spark.createDataFrame([(b, k, d) for (b, d), k in mates.items()], "band int, bucket long, doc_id long"),
                             spark.createDataFrame(sorted(dates.items()), "doc_id long, period int"))
    got = {r.doc_id: (r.neighbor_id, r.dot) for r in rows.collect()}
    for d in docs:
        before = [e for e in docs if (dates[e], e) < (dates[d], d) and any(mates[b, d] == mates[b, e] for b in range(2))]
        if not before:
            assert d not in got
            continue
        best = min(before, key=lambda e: (-round(dot(docs[d], docs[e]), 9), e))
        assert got[d][0] == best and abs(got[d][1] - dot(docs[d], docs[best])) < 1e-9


def test_errors_against_reference_vectors(spark, sizes):
    ours, ref = corpus(3), corpus(4, n=30, vocabulary=6, low=-0.5)
    ref[30] = {"w0": float("nan")}
    got = cosine_diff_summary(vector_errors(frame(spark, ours), frame(spark, ref))).first()
    cells = [abs(dot(ours.get(a, {}), ours.get(b, {})) - dot(ref[a], ref[b])) for a in ref for b in ref
             if a < b < 30 and ref[a].keys() & ref[b].keys()]
    assert (got.cells, got.over_threshold) == (len(cells), sum(e > 1e-2 for e in cells))
    assert abs(got.total_error - sum(cells)) < 1e-9


def test_dense_and_sparse_products_agree():
    rnd = np.random.default_rng(1)
    def block(n, c):
        place, term = np.meshgrid(np.arange(n), np.arange(c))
        return {"docs": np.arange(n), "periods": np.zeros(n, np.int32), "terms": np.arange(c), "starts": np.arange(c + 1) * n,
                "places": place.ravel().astype(np.int32), "weights": rnd.normal(size=n * c)}
    a, b = block(7, 5), block(9, 4)
    dense, met = B.dots(a, b, counted=True)
    old, B.DENSE_CELLS = B.DENSE_CELLS, 0
    try:
        sparse, met2 = B.dots(a, b, counted=True, matches=3)
    finally:
        B.DENSE_CELLS = old
    assert np.allclose(dense, sparse) and (met == 4).all() and (met2 == 4).all()


def test_queries_make_only_what_they_ask_for(spark, sf_dir, monkeypatch):
    """Buckets and word spread come without neighbours, term frequencies without postings."""
    from corpuslens.plans import catalog

    def refuse(*args, **kwargs):
        raise AssertionError("not asked for")
    monkeypatch.setattr(catalog.Context, "_cache", {})
    monkeypatch.setattr("corpuslens.operators.neighbors.past_neighbor_lsh", refuse)
    for name in ("lsh_buckets", "word_spread"):
        assert catalog.QUERIES[name](spark, sf_dir).count() > 0
    monkeypatch.setattr(catalog.Context, "_cache", {})
    monkeypatch.setattr("corpuslens.operators.tfidf.l2_normalize", refuse)
    assert catalog.QUERIES["term_frequency"](spark, sf_dir).count() > 0


def test_text_folder_is_written_by_all_tasks(spark, tmp_path):
    """One input partition, as a small file gives; each task commits its own files."""
    from corpuslens.sources.files import read_text_dir, write_text_dir
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string").coalesce(1)
    write_text_dir(docs, str(tmp_path / "t"))
    files = list((tmp_path / "t").glob("doc_id=*/part-*.txt"))
    assert len(files) == 40 and len({f.name.split("-")[1] for f in files}) > 1
    assert sorted((r.doc_id, r.text) for r in read_text_dir(spark, str(tmp_path / "t")).collect()) == [(i, f"text {i}") for i in range(40)]


def test_a_document_is_packed_once_however_many_groups_it_has(spark, sizes):
    docs = corpus(6)
    rows = spark.createDataFrame([(d, d % 3, [d % 2, 10 + d % 4, 20]) for d in docs], "doc_id long, period int, groups array<long>")
    blocks = [{c: np.frombuffer(r[c], kind) for c, kind in B.PACKED.items()} for r in B.pack(frame(spark, docs), rows).collect()]
    assert sorted(d for b in blocks for d in b["docs"]) == sorted(docs)
    assert sum(len(b["weights"]) for b in blocks) == sum(map(len, docs.values()))
    held = sorted((int(b["docs"][m]), int(g)) for b in blocks for m, g in zip(b["members"], b["groups"]))
    assert held == sorted((d, g) for d in docs for g in (d % 2, 10 + d % 4, 20))


def test_a_task_returns_one_neighbour_a_document(spark, sizes):
    """Not one for each pair of blocks: what is moved does not follow the pairs."""
    docs = corpus(7)
    rows = spark.createDataFrame([(d, 0, [0, 1]) for d in docs], "doc_id long, period int, groups array<long>")
    joined = B.pairs(B.pack(frame(spark, docs), rows)).coalesce(1)
    rows = B.best_earlier(joined, 9, "doc_id long, neighbor_id long, dot double").collect()
    got = {r.doc_id: r.neighbor_id for r in rows}
    assert got and len(rows) == len(got)
    for d, best in got.items():
        assert best == min(range(d), key=lambda e: (-round(dot(docs[d], docs[e]), 9), e))


def test_staged_writes_leave_no_shuffles(spark):
    from corpuslens.session import SHUFFLE_CLEANUP, materialize
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    out = materialize(spark.range(1000).selectExpr("id % 7 AS g").groupBy("g").count(), "table")
    assert tracker.shuffleStatuses().size() <= before and spark.conf.get(SHUFFLE_CLEANUP) == "false"
    assert sorted(r[0] for r in out.collect()) == list(range(7))


def test_blocks_go_when_their_neighbours_are_staged(spark, sizes):
    from pathlib import Path
    from urllib.parse import urlparse
    from corpuslens.session import ensure_checkpoint_dir
    docs = corpus(8)
    folder = Path(urlparse(ensure_checkpoint_dir(spark)).path)
    before = set(folder.glob("table-*"))
    rows = past_neighbor_lsh(frame(spark, docs), spark.createDataFrame([(0, 0, d) for d in docs], "band int, bucket long, doc_id long"),
                             spark.createDataFrame([(d, 0) for d in docs], "doc_id long, period int"))
    left = [spark.read.parquet(str(p)).columns for p in set(folder.glob("table-*")) - before]
    assert left == [["doc_id", "neighbor_id", "dot"]]
    assert rows.count() == len(docs) - 1


def test_novelty_is_the_same_without_broadcasts(spark, monkeypatch):
    import corpuslens.operators.novelty as N
    docs = corpus(9)
    post = frame(spark, docs)
    near = spark.createDataFrame([(d, d // 2 if d > 3 else None) for d in docs if d % 9], "doc_id long, neighbor_id long")
    want = sorted((d, t, x) for d, v in docs.items() for t, w in v.items()
                  if (x := round(max(0.0, w - (docs[d // 2].get(t, 0.0) if d > 3 and d % 9 else 0.0)), 9)) > 0)
    for rows in (N.DEFAULT_BROADCAST_ROWS, 0):
        monkeypatch.setattr(N, "DEFAULT_BROADCAST_ROWS", rows)
        assert sorted((r.doc_id, r.term, round(r.weight, 9)) for r in N.novelty(post, near).collect()) == want


def test_exact_neighbours_of_all_documents(spark, sizes):
    """Every earlier document counts; copies tie, within a block and between blocks."""
    from corpuslens.operators.neighbors import past_neighbor_exact
    docs = corpus(10)
    dates = {d: d * 7 % 5 for d in docs}
    got = {r.doc_id: (r.neighbor_id, r.dot) for r in past_neighbor_exact(frame(spark, docs), spark.createDataFrame(sorted(dates.items()), "doc_id long, period int")).collect()}
    first = min(docs, key=lambda d: (dates[d], d))
    assert got.keys() == docs.keys() - {first}
    for d in got:
        before = [e for e in docs if (dates[e], e) < (dates[d], d)]
        best = min(before, key=lambda e: (-round(dot(docs[d], docs[e]), 9), e))
        assert got[d][0] == best and abs(got[d][1] - dot(docs[d], docs[best])) < 1e-9


def test_ranks_of_two_blocks():
    """One comparison of small numbers tells which document of a pair is earlier."""
    a = {"docs": np.array([3, 5, 9]), "periods": np.array([2, 0, 1], np.int32)}
    b = {"docs": np.array([1, 5, 8]), "periods": np.array([1, 0, -4], np.int32)}
    ra, rb = B._ranks(a, b)
    assert ra.tolist() == [4, 1, 3] and rb.tolist() == [2, 1, 0] and ra.dtype == np.int32
