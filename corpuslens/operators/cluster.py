"""K-means over document vectors.

I1 is Spark ML's distributed k-means.

I2 reads the vectors once.  They are dealt into ``partitions`` parts by a hash of
the id (a plain parameter: the result depends on it, never on the size of the
input or on how it is split), and each part is streamed through a sketch of at
most ``sketch_size`` weighted centres: a vector joins its nearest centre, or opens
a new one with a probability of its squared distance over the facility cost;
when there are too many centres the cost doubles and the centres go through the
same step themselves.  Sketches are merged by that step too, ``fan_in`` at a time in
a tree, so no task holds more than ``fan_in`` sketches and one batch of vectors.  Ball
k-means on the last sketch (bounded by ``sketch_size``, so it may pass through the
driver) gives the centres, and every vector is assigned to its nearest one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, IDF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .greedi import part_of

STEP_ROWS = 512               # vectors compared with the centres at a time
SKETCH = "part int, x array<double>, weight double, cost double"


def dense_features(df: DataFrame, id_col: str = "doc_id", array_col: str = "embedding") -> DataFrame:
    """``(doc_id, features)`` from an array column (JVM-side conversion); rows without a vector are left out."""
    return (df.filter(F.col(array_col).isNotNull())
            .select(F.col(id_col).alias("doc_id"), array_to_vector(F.col(array_col).cast("array<double>")).alias("features")))


def tfidf_features(tokens: DataFrame, num_features: int = 1 << 18) -> DataFrame:
    """``(doc_id, features)``: hashed term counts -> idf -> L2 norm (Spark ML).
    Per-document term lists are bounded by the document's length."""
    docs = tokens.groupBy("doc_id").agg(F.collect_list("term").alias("terms"))
    tf = HashingTF(inputCol="terms", outputCol="tf", numFeatures=num_features).transform(docs)
    idf = IDF(inputCol="tf", outputCol="tfidf").fit(tf).transform(tf)
    return Normalizer(inputCol="tfidf", outputCol="features", p=2.0).transform(idf).select("doc_id", "features")


def kmeans_docs(features: DataFrame, k: int = 100, tol: float = 0.01, max_iter: int = 20, seed: int = 1) -> DataFrame:
    """``(doc_id, cluster)``."""
    model = KMeans(k=k, tol=tol, maxIter=max_iter, seed=seed, featuresCol="features", predictionCol="cluster").fit(features)
    return model.transform(features).select("doc_id", F.col("cluster").cast("int").alias("cluster"))


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :])


class Sketch:
    """At most ``size`` weighted centres of a stream of weighted vectors."""

    def __init__(self, size: int, seed: int, cost: float = 0.0):
        self.size, self.cost, self.random = size, cost, np.random.default_rng(seed)
        self.x = self.w = None

    def add(self, x: np.ndarray, w: np.ndarray) -> None:
        for i in range(0, len(x), STEP_ROWS):
            self._step(x[i:i + STEP_ROWS], w[i:i + STEP_ROWS])
            while len(self.x) > self.size:
                if not self.cost:                       # the first cost: about the least distance between centres
                    d = squared_distances(self.x, self.x)
                    np.fill_diagonal(d, np.inf)
                    self.cost = float(np.quantile(d.min(1), 0.25)) or float(d[np.isfinite(d)].max()) * 1e-6 or 1e-12
                self.cost *= 2
                old, weight, self.x = self.x, self.w, None
                self._step(old, weight)

    def _step(self, x: np.ndarray, w: np.ndarray) -> None:
        if self.x is None:
            self.x, self.w = x[:1].copy(), w[:1].copy()
            x, w = x[1:], w[1:]
        d = squared_distances(x, self.x)
        near = d.argmin(1) if len(x) else np.zeros(0, np.int64)
        opens = w * d[np.arange(len(x)), near] > self.cost * self.random.random(len(x))
        base, fresh = len(self.x), []
        for i in np.flatnonzero(opens):                # openers also look at the centres that this step opened
            if fresh:
                e = squared_distances(x[i:i + 1], x[fresh])[0]
                j = int(e.argmin())
                if e[j] < d[i, near[i]]:
                    if w[i] * e[j] <= self.cost * self.random.random():
                        near[i], opens[i] = base + j, False
                        continue
            near[i] = base + len(fresh)
            fresh.append(i)
        if fresh:
            self.x, self.w = np.vstack([self.x, x[fresh]]), np.append(self.w, w[fresh])
        join = np.flatnonzero(~opens)
        if len(join):
            sums, total = self.x * self.w[:, None], self.w.copy()
            np.add.at(sums, near[join], x[join] * w[join, None])
            np.add.at(total, near[join], w[join])
            self.x, self.w = sums / total[:, None], total

    def rows(self, part: int) -> pa.RecordBatch:
        n = len(self.x)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * self.x.shape[1], pa.int32()), pa.array(self.x.ravel(), pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), flat, pa.array(self.w, pa.float64()), pa.array([self.cost] * n, pa.float64())],
                                          ["part", "x", "weight", "cost"])


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of equally long arrays of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sketches(size: int, seed: int):
    """Streams rows that are sorted by ``part`` into one sketch per part."""
    def run(batches):
        sketch, mine = None, None
        for batch in batches:
            part = batch["part"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                rows = batch.slice(a, b - a)
                if sketch is None or part[a] != mine:
                    if sketch is not None:
                        yield sketch.rows(int(mine))
                    mine, sketch = part[a], Sketch(size, seed + int(part[a]))
                sketch.cost = max(sketch.cost, float(rows["cost"].to_numpy().max()))
                sketch.add(matrix(rows["x"]), rows["weight"].to_numpy())
        if sketch is not None:
            yield sketch.rows(int(mine))
    return run


def sketch(features: DataFrame, sketch_size: int, partitions: int, fan_in: int = 8, seed: int = 1) -> DataFrame:
    """``(part, x, weight, cost)``: the merged sketch of ``features(doc_id, features)``."""
    rows = features.filter(F.col("features").isNotNull()).select(
        F.coalesce(part_of(F.col("doc_id").cast("bigint"), partitions), F.lit(0)).alias("part"), vector_to_array("features").alias("x"),
        F.lit(1.0).alias("weight"), F.lit(0.0).alias("cost"), F.col("doc_id").alias("place"))
    parts = partitions
    while True:
        order = ["part", "place"] if "place" in rows.columns else ["part", "x"]
        rows = rows.repartition(parts, "part").sortWithinPartitions(*order).select("part", "x", "weight", "cost").mapInArrow(_sketches(sketch_size, seed), SKETCH)
        rows = materialize(rows, "table")               # a lost task makes its own sketch again, not the tree
        if parts == 1:
            return rows
        parts = -(-parts // fan_in)
        rows = rows.withColumn("part", F.floor(F.col("part") / fan_in).cast("int"))


def ball_kmeans(x: np.ndarray, w: np.ndarray, k: int, iterations: int = 20, seed: int = 1, trim: float = 0.9, runs: int = 4) -> np.ndarray:
    """At most ``k`` centres of weighted vectors: seeding by distance, then means over the
    vectors within ``trim`` of the way to the next centre; the best of ``runs``."""
    best, least = x[:0], np.inf
    for r in range(runs):
        rng = np.random.default_rng(seed + r)
        c = x[rng.choice(len(x), 1, p=w / w.sum())]
        d = squared_distances(x, c)[:, 0]
        while len(c) < min(k, len(x)) and (d * w).sum() > 0:
            c = np.vstack([c, x[rng.choice(len(x), 1, p=d * w / (d * w).sum())]])
            d = np.minimum(d, squared_distances(x, c[-1:])[:, 0])
        for _ in range(iterations):
            d = squared_distances(x, c)
            near = d.argmin(1)
            between = squared_distances(c, c)
            np.fill_diagonal(between, np.inf)
            ball = trim * trim * between.min(1)[near] if len(c) > 1 else np.full(len(x), np.inf)
            core = d[np.arange(len(x)), near] <= ball
            sums, total = np.zeros_like(c), np.zeros(len(c))
            np.add.at(sums, near[core], x[core] * w[core, None])
            np.add.at(total, near[core], w[core])
            new = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-300)[:, None], c)
            if np.allclose(new, c, rtol=0, atol=1e-12):
                break
            c = new
        cost = float((squared_distances(x, c).min(1) * w).sum())
        if cost < least:
            best, least = c, cost
    return best


def sketch_centres(features: DataFrame, k: int = 100, sketch_size: int = 1300, partitions: int = 16, fan_in: int = 8,
                   max_iter: int = 20, seed: int = 1) -> np.ndarray:
    """The centres of I2, at most ``k``."""
    rows = sketch(features, max(k, sketch_size), partitions, fan_in, seed).orderBy("x").collect()   # at most sketch_size rows
    if not rows:
        return np.zeros((0, 0))
    return ball_kmeans(np.array([r["x"] for r in rows]), np.array([r["weight"] for r in rows]), k, max_iter, seed)


def assign(features: DataFrame, centres: np.ndarray) -> DataFrame:
    """``(doc_id, cluster, distance2)``: nearest centre (ties: the first) and the squared distance."""
    shared = features.sparkSession.sparkContext.broadcast(centres)       # k vectors
    def run(batches):
        for batch in batches:
            if not batch.num_rows or not len(shared.value):
                continue
            x = matrix(batch["x"])
            near, far = [], []
            for i in range(0, len(x), STEP_ROWS):
                d = squared_distances(x[i:i + STEP_ROWS], shared.value)
                near.append(d.argmin(1))
                far.append(((x[i:i + STEP_ROWS] - shared.value[near[-1]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.concatenate(near), pa.int32()), pa.array(np.concatenate(far), pa.float64())],
                                             ["doc_id", "cluster", "distance2"])
    kind = dict(features.dtypes)["doc_id"]
    return (features.filter(F.col("features").isNotNull()).select("doc_id", vector_to_array("features").alias("x"))
            .mapInArrow(run, f"doc_id {kind}, cluster int, distance2 double"))


def sketch_kmeans(features: DataFrame, k: int = 100, sketch_size: int = 1300, partitions: int = 16, fan_in: int = 8,
                  max_iter: int = 20, seed: int = 1) -> DataFrame:
    """``(doc_id, cluster)``; rows without a vector are in no cluster."""
    centres = sketch_centres(features, k, sketch_size, partitions, fan_in, max_iter, seed)
    return assign(features, centres).select("doc_id", "cluster")
