"""Novelty vectors, their statistics, de-duplication and word spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import DEFAULT_BROADCAST_ROWS, join_small, materialize, salted_join

# Differences at or below this are float noise (exact copies of a document
# differ by ~1e-17 after normalisation) and count as zero.
NOVELTY_EPS = 1e-9


def novelty(postings: DataFrame, neighbors: DataFrame, ignore_isolated: bool = False) -> DataFrame:
    """``(doc_id, term, weight)`` with
    ``weight = max(0, phi(d, w) - phi(n(d), w))`` on the doc's own terms,
    zeros (|x| <= NOVELTY_EPS) dropped.  Docs without a past neighbour keep their own vector, or
    are dropped with ``ignore_isolated``.  Always compares original vectors."""
    # one row per doc, read by the hot-key sample and the join: cached
    nb = materialize(neighbors.select("doc_id", "neighbor_id"), "persist")
    have = nb.filter("neighbor_id IS NOT NULL")
    rows = have.count()
    own = join_small(postings, have, "doc_id", known_rows=rows)
    other = postings.select(F.col("doc_id").alias("neighbor_id"), "term", F.col("weight").alias("nweight"))
    if rows <= DEFAULT_BROADCAST_ROWS:       # only vectors of neighbours are moved; above that the filter would move them all itself
        other = other.join(F.broadcast(have.select("neighbor_id").distinct()), "neighbor_id", "left_semi")
    # many documents can share one neighbour (copies pick the same earliest
    # copy): hot (neighbour, term) keys are salted
    j = salted_join(own, other, ["neighbor_id", "term"], "left", salt_by=["doc_id"])
    v = F.greatest(F.lit(0.0), F.col("weight") - F.coalesce(F.col("nweight"), F.lit(0.0)))
    out = j.select("doc_id", "term", v.alias("weight"))
    if not ignore_isolated:  # without a neighbour nothing is compared: no join, and no hot null key
        alone = join_small(postings, have.select("doc_id"), "doc_id", "left_anti", known_rows=rows)
        out = out.unionByName(alone.select("doc_id", "term", F.col("weight").cast("double").alias("weight")))
    return out.filter(F.col("weight") > F.lit(NOVELTY_EPS))


def novelty_stats(postings: DataFrame, neighbors: DataFrame, buckets: DataFrame | None = None,
                  dates: DataFrame | None = None) -> DataFrame:
    """``(counter, value)`` rows: TOTAL documents with a vector,
    POTENTIALLY_IGNORED = those without a past neighbour and, given buckets,
    DUPLICATES = documents with an earlier bucket-mate in more than one band
    (they would receive one novelty vector per band)."""
    docs = postings.select("doc_id").distinct()
    flagged = docs.join(neighbors.select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    total = flagged.agg(F.count(F.lit(1)).cast("bigint").alias("value")).select(F.lit("TOTAL").alias("counter"), "value")
    ignored = flagged.agg(F.coalesce(F.sum(F.when(F.col("has").isNull(), 1).otherwise(0)), F.lit(0)).cast("bigint").alias("value")) \
        .select(F.lit("POTENTIALLY_IGNORED").alias("counter"), "value")
    out = total.unionByName(ignored)
    if buckets is not None and dates is not None:
        from .lsh import earliest_mates
        per_band = earliest_mates(buckets, dates).filter(F.col("min_mate").isNotNull())
        dup = (per_band.groupBy("doc_id").agg(F.countDistinct("band").alias("nb"))
               .agg(F.coalesce(F.sum(F.when(F.col("nb") > 1, 1).otherwise(0)), F.lit(0)).cast("bigint").alias("value"))
               .select(F.lit("DUPLICATES").alias("counter"), "value"))
        out = out.unionByName(dup)
    return out


def dedup_by_id(vectors: DataFrame, key: str = "band") -> DataFrame:
    """Several vectors per doc (one per ``key`` value) -> one: the vector
    of the smallest key.  Aggregate + join by document, no per-doc window: vectors that
    are dealt by document stay where they are (an equality would become a key of the
    join, and they would be dealt again by both)."""
    pick = vectors.groupBy("doc_id").agg(F.min(key).alias("_least"))
    return vectors.join(pick, "doc_id").filter(F.col(key) <= F.col("_least")).drop(key, "_least")


def word_spread(postings: DataFrame, dates: DataFrame) -> DataFrame:
    """``(period, term, weight)`` with weight = sum of the tf-idf of the
    term over documents of that period (a true sum)."""
    return (postings.join(dates.select("doc_id", "period"), "doc_id")
            .groupBy("period", "term").agg(F.sum("weight").alias("weight")))
