"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

BATCH_BYTES = 8 << 20
PLACES = 1 << 63              # places of a sample


def arrow_batches(spark: SparkSession) -> None:
    """Lower the default bound on the bytes of an Arrow batch, which a Python
    worker's memory follows; a session's own setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, str(BATCH_BYTES))


def staged(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder once and go on from there.

    Parquet rather than ``checkpoint()``: a checkpoint keeps the constraints that
    the optimizer inferred for its plan, and in a loop of joins those double
    with every round.  The folder is the cluster's to clean, like checkpoints."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True for the documents that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def place(doc_id: Column) -> Column:
    """Place of a document in a sample's order, from 0 to ``PLACES`` - 1."""
    return F.shiftrightunsigned(F.xxhash64(doc_id.cast("string")), 1)


def last_place(rows: int, count: int) -> int:
    """Last place in a sample of about ``rows`` out of ``count`` rows, in whole
    numbers, so that the share holds however many rows there are."""
    return min(PLACES, -(-rows * PLACES // count)) - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
