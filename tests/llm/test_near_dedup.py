import re

import numpy as np
import pyarrow as pa

from corpuslens.llm import near_dedup as N
from corpuslens.llm import queries
from corpuslens.llm.words import SpanHasher

from llm_cases import rows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text, size):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(docs, size, percent=80):
    """doc_id -> (set size, least id reachable), comparing all pairs of distinct sets."""
    sets = {i: shingles(t, size) for i, t in docs if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect() if r.doc_id is not None}


def test_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.QUERIES["op8_minhash_near_dedup"](spark, sf_dir)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = brute(docs, 2)
    assert got(out) == want
    assert {r.doc_id for r in out.filter("kept").collect()} == {i for i, (_, c) in want.items() if i == c}


def test_edge_cases(edge, nothing):
    out = N.near_groups(edge, size=2)
    assert out.count() == len(rows())
    assert got(out) == brute([(r[0], r[1]) for r in rows()], 2)
    assert all(r.kept and r.component_id is None for r in out.filter("doc_id IS NULL").collect())
    assert N.near_groups(nothing, size=2).count() == 0


def test_stage_keeps_one_of_each_group_and_all_columns(edge, nothing):
    out = N.drop_near_copies(edge)
    assert out.columns == edge.columns
    left = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    want = brute([(r[0], r[1]) for r in rows()], 5)
    assert left == sorted(i for i, (_, c) in want.items() if i == c)
    assert out.filter("doc_id IS NULL").count() == 2
    assert N.drop_near_copies(nothing).count() == 0


def test_crowded_group_hangs_together(spark):
    """Borderline copies of one original: alike to it, less so to each other."""
    base = [f"w{i}" for i in range(150)]
    docs = [(0, " ".join(base))]
    rng = np.random.default_rng(3)
    for d in range(1, 200):
        w = list(base)
        for p in rng.choice(150, 7, replace=False):
            w[p] = f"x{d}_{p}"
        docs.append((d, " ".join(w)))
    out = N.near_groups(spark.createDataFrame(docs, "doc_id bigint, text string"), size=2)
    assert got(out) == brute(docs, 2)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    labels = {r.node: r.label for r in N.components(edges).collect()}
    assert labels == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_signature_agreement_follows_similarity():
    reader = SpanHasher()
    a = [f"u{i}" for i in range(400)]
    b = a[:340] + [f"v{i}" for i in range(60)]
    (values, starts), = N.shingle_sets(reader, pa.array([" ".join(a), " ".join(b)]), 1)
    s = N.signatures(values, starts, 1024)
    assert abs((s[0] == s[1]).mean() - 340 / 460) < 0.05


def test_links_that_the_orders_miss_are_found(spark, monkeypatch):
    """With orders that show no pair at all, the groups are still those of all links."""
    rng = np.random.default_rng(5)
    docs = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(100)]
        for _ in range(12):
            w = list(base)
            for p in rng.choice(100, rng.integers(0, 11), replace=False):
                w[p] = f"x{len(docs)}_{p}"
            docs.append((len(docs), " ".join(w)))
    docs += [(100, docs[3][1]), (3, docs[3][1]), (101, "one two"), (102, ""), (103, None)]
    whole = N.candidates
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    for size in (1, 2):
        assert got(N.near_groups(table, size=size)) == brute(docs, size)
    monkeypatch.setattr(N, "candidates", lambda *a, **b: whole(*a, **b).filter("a < 0"))
    for size in (1, 2):
        assert got(N.near_groups(table, size=size)) == brute(docs, size)


def test_an_id_with_unlike_texts_loses_only_its_copies(spark):
    """Texts go by their own group, whatever other texts their id has."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    docs = [(3, a), (5, a), (5, b), (5, b), (7, b + " end"), (8, c), (8, d), (9, d + " end"), (9, c + " end"), (8, c.upper())]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    left = sorted((r.doc_id, r.text.lower()) for r in N.drop_near_copies(table).collect())
    assert left == [(3, a), (5, b), (8, c), (8, d)]
    out = [(r.doc_id, r.component_id) for r in N.near_groups(table).collect()]
    assert sorted(out) == [(3, 3), (5, 3), (5, 5), (5, 5), (7, 5), (8, 8), (8, 8), (8, 8), (9, 8), (9, 8)]


def test_a_column_with_the_name_of_the_key_is_kept(spark):
    a = " ".join(f"a{i}" for i in range(60))
    table = spark.createDataFrame([(1, a, "own"), (2, a, "x"), (3, "other text", "mine")], "doc_id bigint, text string, text_key_of_near_copies string")
    assert sorted(map(tuple, N.drop_near_copies(table).collect())) == [(1, a, "own"), (3, "other text", "mine")]


def test_components_draw_only_the_edges_left(spark, monkeypatch):
    """A group's edges are not joined again in every round: the work stays near the number of edges."""
    rng = np.random.default_rng(3)
    ids = rng.permutation(600)
    links = {(int(ids[k]), int(ids[k + 1])) for k in range(399)} | {(int(ids[400]), int(i)) for i in ids[401:]} | {(700, 700)}
    made, whole = [], N.staged

    def counted(df):
        out = whole(df)
        made.append((out.columns, out.count()))
        return out
    monkeypatch.setattr(N, "staged", counted)
    labels = {r.node: r.label for r in N.components(spark.createDataFrame(sorted(links), "a bigint, b bigint")).collect()}
    chain, star = {int(i) for i in ids[:400]}, {int(i) for i in ids[400:]}
    assert labels == {i: min(g) for g in (chain, star, {700}) for i in g}
    drawn = [n for columns, n in made if columns == ["a", "b"]]
    assert all(2 * y <= x for x, y in zip(drawn, drawn[1:])) and drawn[-1] == 0


def order_pairs(sigs, back=4):
    depth = sigs.shape[1]
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sigs), np.int64)), pa.array([s.astype(">u2").tobytes() for s in sigs]), pa.array(np.arange(len(sigs)))],
                                       ["tree", "prefix", "node"])
    return [tuple(r.values()) for b in N._neighbours(back, 4, depth)(iter([batch.slice(0, 7), batch.slice(7)])) for r in b.to_pylist()]


def test_depth_follows_the_region():
    sparse = np.array([[1, 1, 1, 1, k, 0, 0, 0] for k in range(4)])            # four rows share four values
    crowd = np.array([[2, 2, 2, 2, 2, k // 3, k, 0] for k in range(12)])       # twelve share five, by threes six
    got = order_pairs(np.concatenate([sparse, crowd]))
    assert {(a, b) for a, b, _ in got if b < 4} == {(a, b) for b in range(4) for a in range(b)}
    late = {(a, b): n for a, b, n in got if b >= 8}
    assert all((b - 1, b) in late for b in range(8, 16))                       # the row before, at any depth
    assert all(n >= 6 for (a, b), n in late.items() if b - a > 1) and (13, 15) in late and (9, 11) not in late
