"""Session helpers: building a session, lineage cuts and size-checked joins.

Nothing here holds data on the driver.  The two helpers that pick a join
strategy look at a *count* (one number) and never at the rows themselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a side may have before we stop broadcasting it.  A row of the small
# tables we broadcast (ids, cover cells, word stats) is < 100 bytes, so the
# default keeps a broadcast below ~200 MB per executor.
DEFAULT_BROADCAST_ROWS = 2_000_000


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "corpuslens") -> SparkSession:
    """Return the active session, or build a local one for tests and bench.

    On a cluster the session is built by the launcher; we only add the
    settings this library relies on when they are not set already.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    n = shuffle_partitions or int(os.environ.get("CORPUSLENS_SHUFFLE_PARTITIONS", "8"))
    builder = (builder
               .config("spark.sql.shuffle.partitions", str(n))
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", os.environ.get("CORPUSLENS_DRIVER_MEMORY", "16g")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only when it is unset
    and the master is local (tests) create a private scratch folder for it."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="corpuslens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def staged_conf(spark: SparkSession):
    """The shuffles of what runs in here go when it ends: nothing reads them again, and waiting for
    the driver's garbage collection they would lie on the executors' disks beside those of the next steps."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def write_staged(df: DataFrame, path: str) -> None:
    """Write a table that later jobs read from its files."""
    with staged_conf(df.sparkSession):
        df.write.parquet(path)


def materialize(df: DataFrame, mode: str = "checkpoint") -> DataFrame:
    """Cut lineage of a table that is reused many times.

    ``checkpoint`` writes Parquet below the shared checkpoint folder (the plan of
    every later job starts from the written files, and the table survives the loss
    of any executor), then keeps a copy in what memory there is for the repeated
    scans of iterative operators; blocks that do not fit or are lost are read
    from the files again, and never spilt.  (``DataFrame.checkpoint`` writes
    serialised rows, several times the size.)  ``persist`` only caches (lost blocks
    are recomputed from lineage); ``table`` is the files alone; ``none`` is a no-op.
    """
    if mode == "none":
        return df
    if mode == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    folder = ensure_checkpoint_dir(df.sparkSession)
    path = f"{folder}/table-{uuid.uuid4().hex}"
    write_staged(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    return out if mode == "table" else out.persist(StorageLevel.MEMORY_ONLY)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``materialize(df, "table")`` staged, when nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if os.path.basename(folder).startswith("table-"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = DEFAULT_BROADCAST_ROWS, known_rows: int | None = None) -> DataFrame:
    """Join, broadcasting ``small`` only when its row count is proven small.

    ``known_rows`` lets callers that already know an upper bound skip the
    count.  Above the bound the join is left to the planner (sort-merge or
    shuffle hash, AQE may still convert it at run time from real sizes).
    """
    n = known_rows if known_rows is not None else small.count()
    if n <= max_rows:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def scalar(df: DataFrame, column: str = None):
    """First column of a one-row aggregate (a single number on the driver)."""
    row = df.first()
    if row is None:
        return None
    return row[column] if column else row[0]


DEFAULT_MAX_GROUP_ROWS = 200_000
MAX_GROUP_ROWS = DEFAULT_MAX_GROUP_ROWS  # read at call time; tests lower it to force salting


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
                max_group_rows: int | None = None, salt_by: list[str] | None = None) -> DataFrame:
    """Equi-join on ``keys`` where no key's left side exceeds ``max_group_rows``
    rows in one task.

    Keys with more left rows are split into ``ceil(n / max_group_rows)``
    sub-keys: each left row takes a salt from a hash of ``salt_by`` (default:
    all its non-key columns) and the right rows of that key are replicated
    once per salt.  Every (left, right) match still meets exactly once, so
    the result equals the plain join.  The table of hot keys has at most
    rows / max_group_rows entries and is joined by a size-checked broadcast.
    """
    max_group_rows = max_group_rows or MAX_GROUP_ROWS
    # hot keys from a Bernoulli sample: a key at the limit appears ~64 times,
    # keys above half the limit are split (conservative); exact when small
    frac = min(1.0, 64.0 / max_group_rows)
    src = left.select(*keys).sample(fraction=frac, seed=17) if frac < 1.0 else left.select(*keys)
    est = F.col("_n") / F.lit(frac)
    hot = (src.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
           .filter(est > F.lit(max_group_rows / 2 if frac < 1.0 else max_group_rows))
           .select(*keys, F.greatest(F.lit(2), F.ceil(est / F.lit(max_group_rows))).cast("int").alias("_s")))
    hot = materialize(hot, "persist")
    n_hot = hot.count()
    if n_hot == 0:
        hot.unpersist()
        return left.join(right, keys, how)
    cols = salt_by or [c for c in left.columns if c not in keys]
    lsalt = F.when(F.col("_s").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*cols), F.col("_s")).cast("int"))
    rsalt = F.explode(F.when(F.col("_s").isNull(), F.array(F.lit(0)))
                      .otherwise(F.sequence(F.lit(0), F.col("_s") - 1)))
    lx = join_small(left, hot, keys, "left", known_rows=n_hot).withColumn("_salt", lsalt).drop("_s")
    rx = join_small(right, hot, keys, "left", known_rows=n_hot).withColumn("_salt", rsalt).drop("_s")
    return lx.join(rx, keys + ["_salt"], how).drop("_salt")
