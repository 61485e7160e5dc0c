"""Random-projection LSH over tf-idf postings.

No basis matrix is stored: the sign of (row, term) is a hash of
``seed:row:term`` (md5, identical in Spark and in SQL engines), so the basis
is deterministic and has an open vocabulary.

Signatures: the signs of a term are computed once per distinct term and
packed into 64-bit words (``basis_words``: vocabulary x rows md5s, one
aggregation by term).  The words are joined to the postings (broadcast
under a checked row bound, shuffle otherwise) and a numpy kernel inside
``mapInPandas`` turns each Arrow batch into partial dot products per
(doc, row).  Spark then sums the partials per (doc, row), so the result is
exact whatever the partitioning; the data that crosses the shuffle is
docs x rows, not postings x rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import DEFAULT_BROADCAST_ROWS, join_small, salted_join

WORD_BITS = 64


def sign(seed: str, row: Column, term: Column) -> Column:
    """E1 entry: +1 if the last hex digit of md5(seed:row:term) is < '8', else -1."""
    h = F.md5(F.concat_ws(":", F.lit(seed), row.cast("string"), term))
    return F.when(F.substring(h, 32, 1) < F.lit("8"), F.lit(1.0)).otherwise(F.lit(-1.0))


def projection_basis(terms: DataFrame, bands: int = 9, rows: int = 13, seed: str = "corpuslens") -> DataFrame:
    """``(row, term, sign)`` for a vocabulary ``terms(term)``."""
    t = terms.select("term").distinct().select("term", F.explode(F.sequence(F.lit(0), F.lit(bands * rows - 1))).alias("row"))
    return t.select(F.col("row").cast("int").alias("row"), "term", sign(seed, F.col("row"), F.col("term")).alias("sign"))


def basis_words(terms: DataFrame, n_rows: int, seed: str = "corpuslens") -> DataFrame:
    """``(term, words ARRAY<BIGINT>)``: bit ``r % 64`` of word ``r // 64`` is 1
    where sign(r, term) = +1."""
    x = terms.select("term").distinct().select("term", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("row"))
    x = x.select("term", "row", (sign(seed, F.col("row"), F.col("term")) > 0).cast("bigint").alias("bit"))
    n_words = math.ceil(n_rows / WORD_BITS)
    aggs = [F.bit_or(F.when(F.floor(F.col("row") / WORD_BITS) == j,
                            F.expr(f"shiftleft(bit, CAST(row - {j * WORD_BITS} AS INT))")).otherwise(F.lit(0).cast("bigint")))
            .alias(f"w{j}") for j in range(n_words)]
    return x.groupBy("term").agg(*aggs).select("term", F.array(*[F.col(f"w{j}") for j in range(n_words)]).alias("words"))


def _partial_dots(n_rows: int):
    """mapInPandas kernel: postings + sign words -> partial (doc, row, dot)."""
    shifts = np.arange(WORD_BITS, dtype=np.uint64)

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            words = np.stack(pdf["words"].to_numpy()).astype(np.int64).view(np.uint64)
            bits = ((words[:, :, None] >> shifts[None, None, :]) & np.uint64(1)).reshape(len(pdf), -1)[:, :n_rows]
            signed = (bits.astype(np.float64) * 2.0 - 1.0) * pdf["weight"].to_numpy(np.float64)[:, None]
            docs, inv = np.unique(pdf["doc_id"].to_numpy(np.int64), return_inverse=True)
            order = np.argsort(inv, kind="stable")
            starts = np.searchsorted(inv[order], np.arange(len(docs)))
            sums = np.add.reduceat(signed[order], starts, axis=0)
            yield pd.DataFrame({"doc_id": np.repeat(docs, n_rows),
                                "row": np.tile(np.arange(n_rows, dtype=np.int32), len(docs)),
                                "dot": sums.reshape(-1)})
    return run


def lsh_signature(postings: DataFrame, bands: int = 9, rows: int = 13, seed: str = "corpuslens",
                  broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``(doc_id, row, bit)`` with bit = dot(basis_row, v) > 0."""
    n_rows = bands * rows
    words = basis_words(postings.select("term"), n_rows, seed)
    pw = join_small(postings.select("doc_id", "term", "weight"), words, "term", max_rows=broadcast_rows)
    partial = pw.select("doc_id", "weight", "words").mapInPandas(_partial_dots(n_rows), "doc_id long, row int, dot double")
    dots = partial.groupBy("doc_id", "row").agg(F.sum("dot").alias("dot"))
    return dots.select("doc_id", "row", (F.col("dot") > 0).cast("int").alias("bit"))


def lsh_buckets(postings: DataFrame, bands: int = 9, rows: int = 13, seed: str = "corpuslens") -> DataFrame:
    """``(band, bucket, doc_id)``: the band's bits packed into one integer
    (exact key, so no hash collisions between different bit patterns)."""
    sig = lsh_signature(postings, bands, rows, seed)
    band = F.floor(F.col("row") / F.lit(rows)).cast("int")
    pos = (F.col("row") - band * F.lit(rows)).cast("int")
    return (sig.select("doc_id", band.alias("band"), pos.alias("pos"), "bit")
            .groupBy("doc_id", "band")
            .agg(F.sum(F.expr("shiftleft(cast(bit AS BIGINT), pos)")).cast("bigint").alias("bucket"))
            .select("band", "bucket", "doc_id"))


def bucket_members(buckets: DataFrame) -> DataFrame:
    """``(band, bucket, doc_id, size)``: membership in long form with the
    bucket size attached (a hot bucket stays spread over many tasks)."""
    sizes = buckets.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("size"))
    return join_small(buckets, sizes, ["band", "bucket"])


def closest_date_neighbor(buckets: DataFrame, dates: DataFrame, partitions: int | None = None) -> DataFrame:
    """``(band, bucket, doc_id, neighbor_id)``: predecessor in (period, doc_id)
    order inside the bucket (null for the first).  Range-partitioned, so a
    hot bucket is spread over many tasks (see ``ordered_predecessor``)."""
    from .ordered import ordered_predecessor
    b = buckets.join(dates, "doc_id").select("band", "bucket", "period", "doc_id")
    out = ordered_predecessor(b, ["band", "bucket"], ["period", "doc_id"], "doc_id", "neighbor_id", partitions)
    return out.select("band", "bucket", "doc_id", "neighbor_id")


def earliest_mates(buckets: DataFrame, dates: DataFrame, strict_order: bool = True) -> DataFrame:
    """``(doc_id, band, min_mate)``: the lowest id among bucket-mates that
    precede the doc (in (period, id) order when ``strict_order``; with
    ``period <= own`` otherwise).  Aggregates only: per (bucket, period) the
    two smallest ids, then a running min over the bucket's periods (a group
    per bucket holds at most one row per period, not one per document)."""
    b = buckets.join(dates, "doc_id")
    keys = ["band", "bucket", "period"]
    per = b.groupBy(*keys).agg(F.min("doc_id").alias("m1"))
    # a hot bucket-period (copies) has many members and one aggregate row: salted
    second = (salted_join(b, per, keys, salt_by=["doc_id"]).filter(F.col("doc_id") > F.col("m1"))
              .groupBy(*keys).agg(F.min("doc_id").alias("m2")))
    per = per.join(second, keys, "left")
    w = Window.partitionBy("band", "bucket").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.min("m1").over(w))
    j = salted_join(b, per, keys, salt_by=["doc_id"])
    if strict_order:
        same = F.when(F.col("m1") < F.col("doc_id"), F.col("m1"))
    else:
        same = F.when(F.col("m1") != F.col("doc_id"), F.col("m1")).otherwise(F.col("m2"))
    mate = F.least(F.col("before"), same)
    return j.select("doc_id", "band", mate.alias("min_mate"))


def first_past_neighbor(buckets: DataFrame, dates: DataFrame) -> DataFrame:
    """``(doc_id, neighbor_id)``: lowest-id bucket-mate (any band) with a
    period <= own; docs without one are left out."""
    m = earliest_mates(buckets, dates, strict_order=False)
    return m.groupBy("doc_id").agg(F.min("min_mate").alias("neighbor_id")).filter(F.col("neighbor_id").isNotNull())
