"""G12 random baselines, per-trial scoring and H6 baseline statistics.

Random selection ranks every candidate by ``md5(seed:trial:doc_id)`` and keeps
the k smallest per trial.  The ``row_number() <= k`` filter is planned by
Spark as a window group limit, so each map task forwards only its k best rows
per trial before the shuffle: no task ever sees a whole trial.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def random_select(candidates: DataFrame, k: int, trials: int = 10, seed: str = "corpuslens") -> DataFrame:
    """``(trial, rank, doc_id)``: k distinct ids per trial, without replacement."""
    ids = candidates.select("doc_id").distinct()
    t = ids.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col("trial").cast("string"), F.col("doc_id").cast("string")))
    w = Window.partitionBy("trial").orderBy(h, F.col("doc_id"))
    return (t.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(F.col("trial").cast("int").alias("trial"), F.col("rank").cast("int").alias("rank"), "doc_id"))


def score_sets(cells: DataFrame, sets: DataFrame, set_col: str = "trial") -> DataFrame:
    """``(set_col, score)`` for many selections at once.

    ``sets(set_col, doc_id)`` is small (k rows per set, a bound set by the
    parameters) and joined by broadcast; cells are grouped by (set, cell),
    then summed per set."""
    from ..functions.objectives import cell_scores
    s = sets.select(set_col, "doc_id").distinct()
    scores = cell_scores(cells, s, set_col).groupBy(set_col).agg(F.sum("contrib").alias("score"))
    # sets that touch no cell score 0
    return s.select(set_col).distinct().join(scores, set_col, "left").select(
        set_col, F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))


def baseline_stats(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """H6: mean and sample standard deviation of trial scores."""
    g = scores.groupBy(*by) if by else scores
    return g.agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"),
                 F.count(F.lit(1)).alias("trials"))
