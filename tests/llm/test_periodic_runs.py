"""Runs of repeated words against a plain search of all stretches and lags."""
import hashlib
import random
import re
import zlib

import numpy as np
from corpuslens.llm import periodic_runs as P
from corpuslens.llm.words import SpanHasher, not_space


def plain_runs(words):
    """All runs by comparing the words with themselves at every lag."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                best.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in best.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def sliced(texts):
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    n, (row, start, size, period), out, bounds = P.slice_runs(np.frombuffer(b"".join(data), np.uint8), offsets, not_space(), SpanHasher(), SpanHasher(1))
    runs = [[] for _ in texts]
    for r, *x in zip(row.tolist(), start.tolist(), size.tolist(), period.tolist()):
        runs[r].append(tuple(x))
    return n.tolist(), runs, [out[a:b].tobytes().decode() for a, b in zip(bounds, bounds[1:])]


def cases():
    rnd = random.Random(5)
    for k in range(250):
        letters, n = rnd.choice([(1, 40), (2, 90), (3, 160), (8, 300), (300, 400)]), rnd.random()
        words = [f"w{rnd.randrange(letters[0])}" for _ in range(int(letters[1] * n))]
        for _ in range(rnd.randrange(4)):                      # planted repeats, some nested
            if words:
                a = rnd.randrange(len(words))
                block = words[a:a + rnd.randrange(1, 120)]
                words[a:a] = (block * rnd.randrange(2, 6))[:rnd.randrange(1, 700)]
        yield words[:900]


def test_equal_to_a_plain_search():
    every = list(cases())
    n, runs, texts = sliced([" ".join(w) for w in every])
    assert n == [len(w) for w in every]
    want = [plain_runs(w) for w in every]
    assert runs == want and sum(map(len, want)) > 300 and any(q >= 100 for w in want for _, _, q in w)
    assert texts == [collapsed(w, r) for w, r in zip(every, want)]


def test_long_texts_of_few_words():
    n = 200_000
    fib = ["a", "b"]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    word = " ".join(fib[-1][:2500])
    _, runs, texts = sliced(["x " * n, "a b c " * (n // 3), word])
    assert runs[0] == [(0, n, 1)] and texts[0] == "x"
    assert runs[1] == [(0, n // 3 * 3, 3)] and texts[1] == "a b c"
    assert runs[2] == plain_runs(word.split())


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *top, None if not runs else 1000 * top[1] // top[2],
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapsed(words, runs)))


def test_query_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(map(tuple, P.digest(P.periodic_runs(P.repeat_tails(docs))).collect()))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect() if len(r["text"]) < 9000]
    want = sorted(expected(*r) for r in rows)
    ids = {w[0] for w in want}
    assert [g for g in got if g[0] in ids] == want
    assert len(got) == docs.count() and sum(w[1] > 0 for w in want) > 5


def test_edges(spark, edge, nothing):
    out = P.digest(P.periodic_runs(P.repeat_tails(edge)))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is not None, x) for x in r)
    short = edge.filter("length(text) < 9000 or text is null")
    got = sorted(map(tuple, P.digest(P.periodic_runs(P.repeat_tails(short))).collect()), key=key)
    assert got == sorted((expected(r["doc_id"], r["text"]) for r in short.collect()), key=key)
    assert out.count() == edge.count() and P.digest(P.periodic_runs(P.repeat_tails(nothing))).count() == 0
