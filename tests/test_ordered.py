"""Range-partitioned predecessor equals a window lag, also with a hot group."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslens.operators.ordered import ordered_predecessor


def test_matches_window_lag_with_hot_group(spark):
    rnd = random.Random(3)
    rows = [(0, rnd.randint(0, 5), i) for i in range(300)]            # hot group 0
    rows += [(g, rnd.randint(0, 5), 1000 + i) for i, g in enumerate(rnd.choices(range(1, 20), k=200))]
    df = spark.createDataFrame(rows, "g long, t int, doc_id long")
    got = {(r.g, r.doc_id): r.prev for r in ordered_predecessor(df, ["g"], ["t", "doc_id"], "doc_id", "prev", 7).collect()}
    w = Window.partitionBy("g").orderBy("t", "doc_id")
    want = {(r.g, r.doc_id): r.prev for r in df.select("g", "doc_id", F.lag("doc_id").over(w).alias("prev")).collect()}
    assert got == want
