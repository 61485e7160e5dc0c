"""Dot products between documents through the inverted index.

A pair of documents has a non-zero dot product only if they share a term.
Documents are packed into blocks of vectors, and dot products are formed
between two blocks in memory (:mod:`corpuslens.operators.blocks`); pairs are
neither shuffled nor staged, so no term or bucket needs salt.  The "no positive neighbour" fallback
(lowest earlier id, dot 0) comes from aggregates, not from pairs
(:func:`corpuslens.operators.lsh.earliest_mates`).

Tie rule for the best neighbour: highest ``round(dot, 9)``, then lowest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, join_small, materialize
from .blocks import best_earlier, pack, pairs
from .lsh import earliest_mates

DOT_DIGITS = 9
NEIGHBOR_SCHEMA = "doc_id long, neighbor_id long, dot double"


def _best(cands: DataFrame) -> DataFrame:
    """``cands(doc_id, neighbor_id, dot)`` -> best per doc (aggregations only)."""
    c = cands.groupBy("doc_id", "neighbor_id").agg(F.max("dot").alias("dot"))
    key = F.struct(F.round(F.col("dot"), DOT_DIGITS), -F.col("neighbor_id"))
    return (c.groupBy("doc_id").agg(F.max_by(F.struct("neighbor_id", "dot"), key).alias("b"))
            .select("doc_id", F.col("b.neighbor_id").alias("neighbor_id"), F.col("b.dot").alias("dot")))


def past_neighbor_lsh(postings: DataFrame, buckets: DataFrame, dates: DataFrame,
                      max_group_rows: int | None = None) -> DataFrame:
    """E5: ``(doc_id, neighbor_id, dot)``: among bucket-mates (any band) that
    precede the doc in (period, id) order, the one with the largest dot
    product; with no shared term, the lowest-id earlier mate (dot 0).
    Docs with no earlier mate in any band are absent."""
    # a bucket with one member has no mate: drop those memberships first
    sizes = buckets.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    shared = join_small(buckets, sizes.select("band", "bucket"), ["band", "bucket"], "left_semi")
    groups = shared.groupBy("doc_id").agg(F.collect_list(F.xxhash64("band", "bucket")).alias("groups"))
    blocks = pack(postings, dates.join(groups, "doc_id"))
    dots = materialize(best_earlier(pairs(blocks), DOT_DIGITS, NEIGHBOR_SCHEMA), "table")   # a few rows a document
    discard(blocks)
    fallback = (earliest_mates(buckets, dates).groupBy("doc_id").agg(F.min("min_mate").alias("neighbor_id"))
                .filter(F.col("neighbor_id").isNotNull()).select("doc_id", "neighbor_id", F.lit(0.0).alias("dot")))
    return _best(dots.unionByName(fallback))


def past_neighbor_exact(postings: DataFrame, dates: DataFrame, max_group_rows: int | None = None,
                        stats: dict | None = None) -> DataFrame:
    """E5 with every document in one bucket.  Only the first doc in
    (period, id) order has none.

    Blocks of documents meet as in E5, every block with every other, and a task returns one
    neighbour for each document of its blocks: the work grows with the square of the
    documents, what is moved and staged does not.  A document none of whose terms an earlier
    one holds is settled by the fallback alone.  ``stats`` receives the pairs of a document and
    an earlier one at a common term (and all pairs at a term, either way round, own ones too),
    and the documents before and after those settled at once."""
    # rows of a document's date count like copies of its vector
    docs = dates.groupBy("doc_id").agg(F.min("period").alias("period"), F.count(F.lit(1)).alias("copies"))
    rows = (postings.filter(F.col("weight") > 0).join(docs, "doc_id")
            .select("doc_id", "period", "term", (F.col("weight") * F.col("copies")).alias("weight")))
    if stats is not None:
        first = rows.groupBy("term").agg(F.min(F.struct("period", "doc_id")).alias("first"), F.count(F.lit(1)).cast("double").alias("df"))
        n = first.agg(F.sum(F.col("df") * F.col("df")).alias("every"), F.sum("df").alias("own")).first()
        later = rows.join(first, "term").filter(F.struct("period", "doc_id") > F.col("first"))
        stats.update(pairs=((n["every"] or 0.0) - (n["own"] or 0.0)) / 2, all_pairs=n["every"] or 0.0,
                     documents=[x.select("doc_id").distinct().count() for x in (rows, later)])
    blocks = pack(rows, docs.select("doc_id", "period", F.array(F.lit(0).cast("bigint")).alias("groups")))
    dots = materialize(best_earlier(pairs(blocks), DOT_DIGITS, NEIGHBOR_SCHEMA, grouped=False), "table")
    discard(blocks)
    # lowest id among all earlier documents: one global bucket
    one = dates.join(postings.select("doc_id").distinct(), "doc_id").select(
        F.lit(0).alias("band"), F.lit(0).cast("bigint").alias("bucket"), "doc_id")
    fallback = (earliest_mates(one, dates).filter(F.col("min_mate").isNotNull())
                .select("doc_id", F.col("min_mate").alias("neighbor_id"), F.lit(0.0).alias("dot")))
    return _best(dots.unionByName(fallback))
