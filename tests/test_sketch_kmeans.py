"""One-pass sketches and ball k-means: weights, cost, and assignment against SQL."""
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators.cluster import Sketch, assign, ball_kmeans, dense_features, sketch, sketch_centres, sketch_kmeans, squared_distances

EMBEDDINGS = "/root/testdata/sf0.001/embeddings.parquet"


def blobs(n=900, k=6, dim=5, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, dim)) * 10
    return np.vstack([centres[i % k] + rng.normal(size=dim) * 0.3 for i in range(n)])


def test_sketch_is_bounded_and_keeps_all_weight():
    x = blobs(5000)
    s = Sketch(40, 1)
    for a in range(0, len(x), 700):
        s.add(x[a:a + 700], np.ones(len(x[a:a + 700])))
        assert len(s.x) <= 40
    assert abs(s.w.sum() - len(x)) < 1e-6 and s.cost > 0
    assert np.allclose((s.x * s.w[:, None]).sum(0), x.sum(0))
    same = Sketch(5, 1)
    same.add(np.ones((1000, 3)), np.ones(1000))                          # copies need no centres of their own
    assert len(same.x) == 1 and same.w[0] == 1000


@pytest.fixture(scope="module")
def features(spark):
    x = blobs()
    df = spark.createDataFrame([(i * 16, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id long, v array<double>")
    return dense_features(df, "doc_id", "v")


def test_clusters_of_well_separated_vectors(spark, features):
    merged = sketch(features, 30, 7, fan_in=3)
    rows = merged.collect()
    assert len(rows) <= 30 and abs(sum(r["weight"] for r in rows) - 900) < 1e-6
    got = {r["doc_id"]: r["cluster"] for r in sketch_kmeans(features, 6, sketch_size=30, partitions=7, fan_in=3).collect()}
    assert len(got) == 900 and len(set(got.values())) == 6
    for i in range(6):
        assert len({got[j * 16] for j in range(i, 900, 6)}) == 1


def test_result_does_not_follow_the_split_of_the_input(spark, features):
    a = sketch_centres(features.repartition(2), 4, 20, partitions=5)
    b = sketch_centres(features.repartition(9), 4, 20, partitions=5)
    assert np.array_equal(a, b)


def test_cost_equals_sql_and_is_near_plain_kmeans(spark):
    table = spark.read.parquet(EMBEDDINGS)
    feats = dense_features(table, "vec_id", "embedding")
    centres = sketch_centres(feats, 10, 100, partitions=16, fan_in=4)
    mine = assign(feats, centres)
    cost = mine.agg(F.sum("distance2")).first()[0]
    con = duckdb.connect()
    con.execute("CREATE TABLE centres (cluster INTEGER, c DOUBLE[])")
    con.executemany("INSERT INTO centres VALUES (?, ?)", [(i, c.tolist()) for i, c in enumerate(centres)])
    rows = con.execute(f"""SELECT vec_id, arg_min(cluster, d), min(d) FROM (
        SELECT vec_id, cluster, list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
        FROM read_parquet('{EMBEDDINGS}'), centres) GROUP BY vec_id""").fetchall()
    assert abs(sum(r[2] for r in rows) - cost) < 1e-6 * cost
    got = {r["doc_id"]: r["cluster"] for r in mine.collect()}
    assert sum(got[v] == c for v, c, _ in rows) >= len(rows) - 1          # a tie may fall either way
    x = np.array([r["embedding"] for r in table.collect()], float)
    plain = squared_distances(x, ball_kmeans(x, np.ones(len(x)), 10)).min(1).sum()
    assert cost < 1.3 * plain


def test_empty_null_and_repeated(spark):
    none = dense_features(spark.createDataFrame([], "doc_id long, v array<double>"), "doc_id", "v")
    assert sketch_kmeans(none, 3, 10, partitions=2).count() == 0
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [5.0, 5.0]), (4, None)]
    feats = dense_features(spark.createDataFrame(rows, "doc_id long, v array<double>"), "doc_id", "v")
    out = [tuple(r) for r in sketch_kmeans(feats, 3, 10, partitions=2).collect()]
    assert len(out) == 3 and len({c for d, c in out if d == 1}) == 1 and 4 not in {d for d, _ in out}
