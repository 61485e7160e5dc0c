"""Predecessor in a sorted order, without one task per group.

A window ``lag(...) OVER (PARTITION BY g ORDER BY o)`` sends a whole group
to one task; with a group holding a third of all rows that task holds a
third of the data.  Here rows are range-partitioned on ``(g, o)`` instead,
so a hot group spans as many partitions as its size needs.  Each partition
computes the lag of its own rows; only the first row of a partition can
have its predecessor elsewhere, and that is the last row of the nearest
non-empty earlier partition (range partitions are ordered).  Those boundary
rows are one per partition (a count bound by the partition number, not by
the data) and are broadcast.  Everything stays in the JVM, so 64-bit ids are
exact.

The partitioned, sorted rows are checkpointed between the two passes so
both see identical partitions even if an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize


def ordered_predecessor(df: DataFrame, group_cols: list[str], order_cols: list[str], value_col: str,
                        out_col: str = "prev", partitions: int | None = None) -> DataFrame:
    """``df`` plus ``out_col`` = ``value_col`` of the previous row of the same
    group in ``order_cols`` order (null for the first row of a group)."""
    keys = group_cols + order_cols
    cols = list(dict.fromkeys(keys + [value_col]))
    ranged = df.select(*cols)
    ranged = ranged.repartitionByRange(partitions, *keys) if partitions else ranged.repartitionByRange(*keys)
    ranged = materialize(ranged.sortWithinPartitions(*keys).withColumns({"_pid": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "checkpoint")

    # the last row of every non-empty partition: a row per partition
    tail = F.max_by(F.struct(*[F.col(c) for c in dict.fromkeys([*group_cols, value_col])]), "_at").alias("tail")
    tails = {r["_pid"]: r["tail"] for r in ranged.groupBy("_pid").agg(tail).collect()}
    rows, carry = [], None
    for pid in sorted(tails):
        if carry is not None:
            rows.append((pid, carry))
        carry = tails[pid]
    spark = df.sparkSession
    kind = ranged.select(F.struct(*[F.col(c) for c in dict.fromkeys([*group_cols, value_col])]).alias("t")).schema["t"].dataType
    before = spark.createDataFrame(rows, T.StructType([T.StructField("_pid", T.IntegerType()), T.StructField("_before", kind)]))

    # partitions are even (range-partitioned), so a window per partition is no hot group
    w = Window.partitionBy("_pid").orderBy("_at")
    row = F.struct(*[F.col(c) for c in dict.fromkeys([*group_cols, value_col])])
    out = ranged.withColumn("_last", F.lag(row).over(w)).join(F.broadcast(before), "_pid", "left")
    last = F.coalesce(F.col("_last"), F.col("_before"))
    same = F.lit(True)
    for c in group_cols:
        same = same & last.getField(c).eqNullSafe(F.col(c))
    return out.select(*cols, F.when(last.isNotNull() & same, last.getField(value_col)).alias(out_col))
