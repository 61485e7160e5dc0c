import collections
import hashlib
import statistics

import pytest

from corpuslens.llm import queries
from corpuslens.llm import sharding as S
from corpuslens.llm import weighted_sampling as W

from llm_cases import rows


def edited(docs):
    """doc_id -> text whose last third is the next document's beginning."""
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for k, (i, t) in enumerate(order):
        n = len(t) // 3
        out[i] = t[:len(t) - n] + order[(k + 1) % len(order)][1][:n]
    return out


def jaccard(a, b):
    a, b = (collections.Counter(w for w in x.lower().split() if w) for x in (a, b))
    both = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in both) / sum(max(a[k], b[k]) for k in both) if both else 1.0


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = {r.doc_id: r for r in queries.QUERIES["op3_weighted_sampling"](spark, sf_dir).collect()}
    want = edited(docs)
    assert len(out) == len(docs)
    errors = []
    prints = collections.defaultdict(set)
    for i, t in docs:
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(want[i].encode()).hexdigest())
        errors.append(r.near_edited - jaccard(t, want[i]))
        prints[t].add(r.fingerprint)
        if t == want[i]:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
    assert all(len(p) == 1 for p in prints.values())
    assert abs(statistics.mean(errors)) < 0.03 and statistics.pstdev(errors) < 0.13


def test_fingerprint_edge_cases(edge, nothing, spark):
    out = W.fingerprints(edge)
    got = out.collect()
    assert len(got) == len(rows())
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert all(r.fingerprint == "" and r.n_chars == 0 for i in (0, 1) for r in by[i])
    assert by[2][0].fingerprint == ""
    assert len({r.fingerprint for r in by[4] + by[5]}) == 1 and len(by[4]) == 2 and len(by[None]) == 2
    assert by[0][0].near_next in (0.0, 1.0)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert W.fingerprints(nothing).count() == 0
    one, = W.fingerprints(spark.createDataFrame([(7, "a b c d e f")], "doc_id bigint, text string")).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b c d a b").hexdigest()


def test_draws_follow_weights(spark):
    """Share of equal draws against generalised Jaccard, weights included."""
    a, b = "x " * 30 + "y " * 10 + "z", "x " * 20 + "y " * 10 + "w " * 5
    texts = spark.createDataFrame([(1, a, b)], "id bigint, text string, edited string")
    r, = W.sampled(texts, ["id"], 300).select(W.likeness(W.F.col("mine"), W.F.col("other")).alias("p")).collect()
    assert abs(r.p - jaccard(a, b)) < 0.1


def test_table_is_even_and_moves_little():
    names = S.shard_names(16)
    table = S.lookup_table(names)
    n = collections.Counter(table)
    assert len(table) == S.table_size(16) and max(n.values()) - min(n.values()) <= 1
    fewer = S.lookup_table(names[:-1], len(table))
    moved = sum(a != b for a, b in zip(table, fewer) if a != 15)
    assert moved < 0.15 * len(table)
    weighted = collections.Counter(S.lookup_table({"a": 1, "b": 3}, 211))
    assert abs(weighted[1] - 3 * weighted[0]) <= 3
    for bad in ([], ["a", "a"], {"a": 0}):
        with pytest.raises(ValueError):
            S.lookup_table(bad)
    with pytest.raises(ValueError):
        S.lookup_table(["a"], 10)


def test_sharding_equals_sql_and_takes_edge_cases(spark, sf_dir, edge, nothing):
    import duckdb
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(queries.ORACLE["op4_sharding"]).fetchall())
    assert sorted(tuple(r) for r in queries.QUERIES["op4_sharding"](spark, sf_dir).collect()) == want
    clash = edge.withColumnRenamed("kept", "slot").withColumnRenamed("score", "shard")
    out = S.assign(clash, "doc_id", S.shard_names(4)).collect()
    assert len(out) == len(rows()) and len({r.shard for r in out if r.doc_id is None}) == 1
    assert all(0 <= r.shard < 4 for r in out)
    assert S.assign(nothing, "doc_id", S.shard_names(4)).count() == 0
