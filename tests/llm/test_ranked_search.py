"""Block-Max MaxScore against a full evaluation, and the bytes of its index."""
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpuslens.llm import ranked_search as R
from corpuslens.llm.words import SpanHasher, Words, text_slices, word_bytes

LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, k=10):
    """Every document's score for every query, by the formula."""
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    total, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for q, text in dict.fromkeys(items):
        if q is None or text is None:
            continue
        found = []
        for i, b, n in bags:
            m = 100 - 75 + (75 * n * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m))
                    for t in terms_of(text) if t in b)
            if s > 0:
                found.append((-s, i is None, i if i is not None else 0))
        out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [100, 1 << 20, 1 << 40])
def test_variable_bytes(most):
    x = np.array([random.Random(k).randrange(most) for k in range(3000)], np.int64)
    data, size = R.variable_bytes(x)
    assert (R.numbers(data) == x).all() and size.sum() == len(data)


def shard_of(texts):
    building = R.Building()
    for i, j, data, offsets in text_slices(pa.array(texts)):
        building.add(np.arange(i, j), Words(data, offsets, word_bytes(), SpanHasher()))
    n = [len(terms_of(t)) for t in texts]
    return building.row(sum(x > 0 for x in n), sum(n))


def test_blocks_are_rejected_and_nothing_is_lost():
    rnd = random.Random(3)
    common, rare = [f"c{k}" for k in range(30)], [f"r{k}" for k in range(3000)]
    texts = [" ".join(rnd.choices(common, k=rnd.randrange(5, 60)) + rnd.choices(rare, k=5)) for _ in range(6000)]
    for k in range(2990, 3000):
        texts[k * 2 - 1] = "special words " + " ".join(rnd.choices(common, k=4))
    row = shard_of(texts)
    queries = R.Queries([("q", "special words c1 c2 c3 c4"), ("r", "c5 c6 c7"), ("s", "none of these"), ("t", "r1 r2 c9 c9 c9")])
    df = np.frombuffer(row["df"], "<i4")
    n = len(texts)
    first = R.Shard(row, queries.terms)
    queries.weight[:] = [0 if k < 0 else math.floor(1000 * math.log((2 * n + 2) / (2 * df[k] + 1))) for k in first.number]
    blocks = 0
    want = {}
    for q, rank, d, s in plain(list(enumerate(texts)), [("q", "special words c1 c2 c3 c4"), ("r", "c5 c6 c7"), ("t", "r1 r2 c9 c9 c9")]):
        want.setdefault(q, []).append((rank, d, s))
    for k, q in enumerate("qrst"):
        shard = R.Shard(row, queries.terms)
        t = queries.term[queries.first[k]:queries.first[k + 1]]
        blocks = sum(int(np.diff(shard.blocks(x))[0]) for x in t if shard.number[x] >= 0)
        doc, score = shard.search(t, queries.weight[t] * queries.times[queries.first[k]:queries.first[k + 1]], 0, 10)
        best = np.lexsort((doc, -score))[:10]
        assert [(r, d, s) for r, (d, s) in enumerate(zip(doc[best].tolist(), score[best].tolist()), 1)] == sorted(want.get(q, []))
        if q == "q":
            assert shard.decompressed < blocks / 4      # the common words' lists are hardly opened
        beyond = shard.search(t, queries.weight[t], int(score.max(initial=0)) + 1, 10)[0]
        assert len(beyond) == 0


def test_table_with_many_shards_and_query_blocks(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    want = plain([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    index = R.build_index(docs.repartition(5))
    assert sorted(map(tuple, R.search(index, items).collect()), key=str) == want
    assert sorted(map(tuple, R.search(index, items, query_bytes=3000).collect()), key=str) == want


def test_edges(spark, edge, nothing):
    items = [(1, "alpha"), (1, "alpha"), (2, None), (3, ""), (None, "one"), (4, "ONE one ñandú 1234"), (5, "日本語 com example")]
    items = spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "'x' as rank", "1.5 as score")
    got = sorted(map(tuple, R.ranked(edge, items).collect()), key=str)
    rows = edge.select("doc_id", "text").collect()
    assert got == plain([tuple(r) for r in rows], [tuple(r[:2]) for r in items.collect()]) and got
    out = R.ranked(edge, items)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert R.ranked(nothing, items).count() == 0 and R.ranked(edge, items.limit(0)).count() == 0
