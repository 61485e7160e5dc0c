"""Readers and writers for the file formats of the pipeline.

Every reader returns a lazy DataFrame with an explicit schema (no schema
inference), so the scans prune columns and push filters where the format
allows it.  Writers overwrite their target.  Scratch output goes below the
session's shared checkpoint folder, never to a machine-local path.
"""

from __future__ import annotations

import math
import os
import re
import uuid
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, materialize, staged_conf

DENSE_EPS = 1e-5  # fixed value: matrix entries with |v| <= this are dropped


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/corpuslens-io/{name}-{uuid.uuid4().hex[:12]}"


# ------------------------------------------------------------- A1 wiki XML

WIKI_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("ns", T.LongType()),
    T.StructField("id", T.LongType()),
    T.StructField("redirect", T.StructType([T.StructField("_title", T.StringType())])),
    T.StructField("revision", T.StructType([
        T.StructField("timestamp", T.StringType()),
        T.StructField("text", T.StructType([T.StructField("_VALUE", T.StringType())])),
    ])),
])
# Wiki markup that flags disambiguation and stub pages.
WIKI_DISAMBIG_PATTERN = r"(?i)\{\{\s*(disambig|disambiguation)[^}]*\}\}"
WIKI_STUB_PATTERN = r"(?i)\{\{[^}]*stub\s*\}\}"


def read_wiki_dump(spark: SparkSession, path: str, row_tag: str = "page") -> DataFrame:
    """A1: XML dump -> ``pages(doc_id, title, text, ts, is_redirect,
    is_disambig, is_stub, is_article)``; article = namespace 0."""
    raw = (spark.read.format("xml").option("rowTag", row_tag).option("ignoreSurroundingSpaces", "false")
           .schema(WIKI_SCHEMA).load(path))
    text = F.coalesce(F.col("revision.text._VALUE"), F.lit(""))
    return raw.select(
        F.col("id").alias("doc_id"), F.coalesce(F.col("title"), F.lit("")).alias("title"), text.alias("text"),
        F.col("revision.timestamp").alias("ts"),
        F.col("redirect._title").isNotNull().alias("is_redirect"),
        text.rlike(WIKI_DISAMBIG_PATTERN).alias("is_disambig"),
        text.rlike(WIKI_STUB_PATTERN).alias("is_stub"),
        (F.coalesce(F.col("ns"), F.lit(0)) == 0).alias("is_article"))


def write_wiki_dump(pages: DataFrame, path: str) -> None:
    """Write ``(doc_id, title, text, ts)`` in the dump's page layout."""
    out = pages.select(F.col("title"), F.lit(0).cast("long").alias("ns"), F.col("doc_id").alias("id"),
                       F.struct(F.col("ts").alias("timestamp"),
                                F.struct(F.col("text").alias("_VALUE")).alias("text")).alias("revision"))
    out.write.mode("overwrite").format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(path)


# ----------------------------------------------------------- A2 text dirs

LIST_SCHEMA = "path string, size long"
# Fixed value: endings of the names that Spark's text reader decompresses.
COMPRESSED = r"\.(deflate|gz|bz2|lz4|snappy|zst)$"
TASK_BYTES = 64 << 20     # of files that a task reads, about
FOLDER_FILES = 4096
# Fixed value: characters that a path of Spark's metadata shows as %XX.
QUOTED = "[\x00-\x20\"#%<>?\\[\\\\\\]^`{|}\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def shared_folder(spark: SparkSession, path: str) -> str | None:
    """The plain path of a folder in the file system that the machines mount; None in any other."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(p).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def _entries(batches):
    """Kernel: folders -> their entries, ``size`` null for a folder; names that Spark's readers hide are left out."""
    paths, sizes = [], []

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "size"])
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            with os.scandir(folder) as entries:
                for e in entries:
                    if e.name[0] == "." or e.name[0] == "_" and "=" not in e.name or e.name.endswith("._COPYING_"):
                        continue
                    paths.append(e.path)
                    sizes.append(None if e.is_dir() else e.stat().st_size)
                    if len(paths) == 1 << 14:
                        yield rows()
                        paths, sizes = [], []
    yield rows()


def _contents(batches):
    """Kernel: paths of files -> ``(file_path, text)``."""
    paths, texts, held = [], [], 0

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], names=["file_path", "text"])
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with open(path, "rb", buffering=0) as f:
                texts.append(f.readall())
            paths.append("file:" + re.sub(QUOTED, lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), path))
            held += len(texts[-1])
            if held >= 1 << 22 or len(paths) == 1 << 12:
                yield rows()
                paths, texts, held = [], [], 0
    yield rows()


def _files_below(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, size)`` of the files that Spark's readers find below a folder of :func:`shared_folder`: those
    in the folder itself and below ``name=value`` folders.  The folders of a level are
    dealt out over the tasks; the driver holds no list of files."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    level, found = spark.range(1).select(F.lit(folder).alias("path")), []
    while not found or not level.isEmpty():
        seen = materialize(level.mapInArrow(_entries, LIST_SCHEMA), "table")
        found.append(seen.filter(F.col("size") > 0))               # Spark's readers pass over empty files
        level = seen.filter(F.col("size").isNull()).select("path").repartition(n, "path")
    below = F.expr(f"substring(path, {len(folder.rstrip('/')) + 2})")
    return reduce(DataFrame.unionByName, found).filter(~below.contains("/") | below.rlike("(^|/)[^/=]+=[^/]*/"))


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file_path, text)``, a row per file.  Spark's own reader lists with a task per folder, keeps
    every file's status on the driver and sets up a reader for each file; plain files of a mounted
    folder are listed and read by the tasks themselves."""
    folder = shared_folder(spark, path)
    if folder is not None and os.path.isdir(folder):
        files = _files_below(spark, folder)
        row = files.agg(F.sum("size").alias("size"), F.count_if(F.col("path").rlike(COMPRESSED)).alias("compressed")).first()
        if not row["compressed"]:
            n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((row["size"] or 0) / TASK_BYTES))
            whole = files.select("path").repartition(n, "path").mapInArrow(_contents, "file_path string, text binary")
            return whole.select("file_path", F.col("text").cast("string").alias("text"))
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))


def read_text_dir(spark: SparkSession, path: str) -> DataFrame:
    """A2: one document per file -> ``(name, doc_id, text)``; ``doc_id`` is the
    file name's digits (or the value of a ``doc_id=N`` folder, or behind a task's number
    as :func:`write_text_dir` names files) when present."""
    df = _whole_files(spark, path)
    name = F.regexp_extract(F.col("file_path"), r"([^/]+)$", 1)
    folder_id = F.regexp_extract(F.col("file_path"), r"doc_id=(-?[0-9]+)/", 1)
    file_id = F.regexp_extract(name, r"^(?:part-[0-9]+-doc_id=)?(-?[0-9]+)", 1)
    doc_id = F.when(folder_id != "", folder_id).when(file_id != "", file_id).try_cast("bigint")
    return df.select(name.alias("name"), doc_id.alias("doc_id"), F.regexp_replace("text", r"\n$", "").alias("text"))


def _text_files(folder: str):
    """Kernel: ``(doc_id, text)`` sorted by id -> a file per id; yields how many.  A file gets its name when
    it is complete, and a task that is repeated writes the same names."""
    token, most = uuid.uuid4().hex, FOLDER_FILES

    def run(batches):
        task, files, file, current = TaskContext.get(), 0, None, None
        draft = f".{task.taskAttemptId()}-{token}"

        def close():
            file.close()
            os.replace(f"{at}/{draft}", f"{at}/part-{task.partitionId():05d}-doc_id={'null' if current is None else current}.txt")
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if file is None or doc != current:
                    if file is not None:
                        close()
                    if files % most == 0:                          # a folder is named by its first id
                        at = f"{folder}/doc_id=from-{doc}"
                        os.makedirs(at, exist_ok=True)
                    file, files, current = open(f"{at}/{draft}", "wb"), files + 1, doc
                file.write((text or b"") + b"\n")
        if file is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])
    return run


def write_text_dir(docs: DataFrame, path: str) -> None:
    """One text file per ``doc_id`` (the texts of a repeated id are joined
    by a newline).  All tasks write, whatever the input's splits, and each moves its own files into place.
    In a mounted folder the tasks make the files themselves (Hadoop's local file system
    starts several processes for each file, to set its rights), named by the id, up to ``FOLDER_FILES`` in a folder;
    in any other, Spark's writer makes ``doc_id=N`` folders
    (the committer's version 2: by default the driver moves the files, one after another)."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, folder = docs.select("doc_id", "text").repartition(n, "doc_id"), shared_folder(spark, path)
    kinds = rows.schema["doc_id"].dataType, rows.schema["text"].dataType
    if folder is None or not isinstance(kinds[0], T.IntegralType) or not isinstance(kinds[1], T.StringType):
        rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("doc_id").text(path)
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    os.makedirs(folder)
    rows = rows.select("doc_id", F.col("text").cast("binary").alias("text")).sortWithinPartitions("doc_id")
    with staged_conf(spark):
        rows.mapInArrow(_text_files(folder), "files long").agg(F.sum("files")).collect()
    open(f"{folder}/_SUCCESS", "w").close()


# -------------------------------------------------- A3, A4 whitespace text

def _int_fields(path_df: DataFrame) -> DataFrame:
    lines = path_df.select(F.trim(F.col("value")).alias("line"))
    lines = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    return lines.select(F.split(F.col("line"), r"\s+").alias("f"))


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """A3: lines ``node source`` (``#`` comments skipped) -> ``(doc_id, src_id)``."""
    f = _int_fields(spark.read.text(path))
    out = f.select(F.get("f", 0).try_cast("bigint").alias("doc_id"), F.get("f", 1).try_cast("bigint").alias("src_id"))
    return out.filter(F.col("doc_id").isNotNull() & F.col("src_id").isNotNull())


def read_revision_stats(spark: SparkSession, path: str, with_volume: bool = True) -> DataFrame:
    """A4: lines ``id count [volume]`` -> ``(doc_id, rev_count, rev_volume)``;
    the volume is null when absent or not asked for."""
    f = _int_fields(spark.read.text(path))
    vol = F.when(F.size("f") > 2, F.get("f", 2).try_cast("bigint")) if with_volume else F.lit(None).cast("bigint")
    out = f.select(F.get("f", 0).try_cast("bigint").alias("doc_id"), F.get("f", 1).try_cast("bigint").alias("rev_count"),
                   vol.alias("rev_volume"))
    return out.filter(F.col("doc_id").isNotNull() & F.col("rev_count").isNotNull())


def write_lines(df: DataFrame, cols: list[str], path: str, sep: str = " ") -> None:
    df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in cols]).alias("value")).write.mode("overwrite").text(path)


# ------------------------------------------------------- A5 dense matrix

def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(part, line_no, line)``: each file is read whole so line numbers are
    exact (plain line reads have no reliable order).  ``part`` is the
    ``part-NNNNN`` index of the file (its name otherwise), so a matrix split
    into part files pairs with a names folder split the same way; one file
    is one task."""
    whole = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), "value")
    part = F.when(F.col("file").rlike(r"^part-[0-9]+"), F.regexp_extract("file", r"^part-([0-9]+)", 1)).otherwise(F.col("file"))
    return whole.select(part.alias("part"),
                        F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("line_no", "line"))


def dense_to_postings(df: DataFrame, id_col: str, array_col: str, eps: float = DENSE_EPS) -> DataFrame:
    """Dense rows -> sparse ``(doc_id, term, weight)``; the column index is
    the term; entries with ``|v| <= eps`` are dropped."""
    x = df.select(F.col(id_col).alias("doc_id"), F.posexplode(array_col).alias("pos", "v"))
    return x.filter(F.abs(F.col("v")) > F.lit(eps)).select(
        "doc_id", F.col("pos").cast("string").alias("term"), F.col("v").cast("double").alias("weight"))


def read_dense_matrix(spark: SparkSession, matrix_path: str, names_path: str | None = None,
                      eps: float = DENSE_EPS, value_type: str = "double") -> DataFrame:
    """A5: one row of numbers per line (+ a parallel file of names) ->
    ``(doc_id, term, weight)``.  Without names the line number is the id.
    ``value_type='float'`` parses single-precision text exactly as the
    float it was written from."""
    m = _numbered_lines(spark, matrix_path).select(
        "part", "line_no",
        F.split(F.trim("line"), r"\s+").try_cast(f"array<{value_type}>").cast("array<double>").alias("vec"))
    if names_path is None:
        return dense_to_postings(m.withColumnRenamed("line_no", "doc_id"), "doc_id", "vec", eps)
    names = _numbered_lines(spark, names_path).select("part", "line_no", F.trim("line").try_cast("bigint").alias("doc_id"))
    return dense_to_postings(m.join(names, ["part", "line_no"]), "doc_id", "vec", eps)


def write_dense_matrix(df: DataFrame, id_col: str, array_col: str, matrix_path: str, names_path: str,
                       partitions: int | None = None) -> None:
    """Write a matrix and its names as line-aligned part files: the rows are
    range-partitioned and checkpointed once, so both writes see the same
    partitions (part-N of the matrix pairs with part-N of the names)."""
    from ..session import materialize
    src = df.select(id_col, array_col)
    src = src.repartitionByRange(partitions, id_col) if partitions else src.repartitionByRange(id_col)
    fixed = materialize(src.sortWithinPartitions(id_col), "checkpoint")
    fixed.select(F.array_join(F.transform(array_col, lambda v: v.cast("string")), " ").alias("value")) \
        .write.mode("overwrite").text(matrix_path)
    fixed.select(F.col(id_col).cast("string").alias("value")).write.mode("overwrite").text(names_path)


# ----------------------------------------------- A6, A8, A9, A10 parquet

def read_word_counts(spark: SparkSession, path: str, flavour: str = "df") -> DataFrame:
    """Word statistics -> ``(term, count)`` from the ``df`` or ``wc`` column."""
    if flavour not in ("df", "wc"):
        raise ValueError("flavour must be 'df' or 'wc'")
    return spark.read.parquet(path).select("term", F.col(flavour).alias("count"))


def write_vectors(postings: DataFrame, path: str, compression: str = "zstd") -> None:
    """Postings as parquet, overwriting the target."""
    postings.select("doc_id", "term", "weight").write.mode("overwrite").option("compression", compression).parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("doc_id", "term", "weight")


def read_dates(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, period)``."""
    return spark.read.parquet(path).select("doc_id", F.col("period").cast("int"))


def read_adjacency(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """Long-form adjacency, optionally only for nodes in ``ids(doc_id)``
    (semi join: Parquet filters and dynamic pruning apply)."""
    adj = spark.read.parquet(path).select("doc_id", "src_id")
    return adj if ids is None else adj.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """``(band, bucket, doc_id)`` membership."""
    return spark.read.parquet(path).select(F.col("band").cast("int"), F.col("bucket").cast("bigint"), "doc_id")


def write_selection(selection: DataFrame, path: str, as_text: bool = False) -> None:
    """A10: selection as parquet with its rank, or as text, one id per line."""
    if as_text:
        # k rows: a single ordered file
        selection.orderBy("rank").select(F.col("doc_id").cast("string").alias("value")).coalesce(1) \
            .write.mode("overwrite").text(path)
    else:
        selection.write.mode("overwrite").parquet(path)


def read_selection(spark: SparkSession, path: str, as_text: bool = False) -> DataFrame:
    """A10: back as ``(doc_id)`` (text) or the full selection (parquet)."""
    if as_text:
        return spark.read.text(path).select(F.trim("value").try_cast("bigint").alias("doc_id")).filter(F.col("doc_id").isNotNull())
    return spark.read.parquet(path)


# ------------------------------------------------------------ A7 citations

def read_citations_aan(spark: SparkSession, path: str) -> DataFrame:
    """A7 (AAN): TSV ``cites <tab> paper_id``; short or empty rows skipped."""
    raw = spark.read.text(path).select(F.split(F.col("value"), "\t").alias("f"))
    ok = raw.filter((F.size("f") >= 2) & (F.trim(F.col("f")[1]) != ""))
    return ok.select(F.trim(F.col("f")[1]).alias("paper_id"), F.trim(F.col("f")[0]).try_cast("int").alias("cites"))


def read_citations_nips(spark: SparkSession, ids_path: str, counts_path: str, count_tokens: bool = False) -> DataFrame:
    """A7 (NIPS): two line-aligned files, paper lines and count lines; the
    count is the second integer of its line, or the number of tokens."""
    ids = _numbered_lines(spark, ids_path).select("part", "line_no", F.trim("line").alias("paper_line"))
    cnt = _numbered_lines(spark, counts_path).select("part", "line_no", F.split(F.trim("line"), r"\s+").alias("f"))
    c = F.size("f") if count_tokens else F.col("f")[1].try_cast("int")
    return ids.join(cnt, ["part", "line_no"]).select("paper_line", c.cast("int").alias("cites"))


# ------------------------------------------------------- A11 wiki tables

def read_wiki_tables(spark: SparkSession, pages_path: str, links_path: str, categories_path: str,
                     page_categories_path: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Page, link and category tables from Parquet or headed CSV."""
    def load(p, schema):
        if fmt == "csv":
            return spark.read.option("header", "true").schema(schema).csv(p)
        return spark.read.parquet(p)
    return {
        "pages": load(pages_path, "doc_id long, title string"),
        "page_links": load(links_path, "src_id long, doc_id long"),
        "category_links": load(categories_path, "parent string, child string"),
        "page_categories": load(page_categories_path, "doc_id long, category string"),
    }


def write_counted(df: DataFrame, path: str, counters: dict[str, Column]) -> dict[str, int]:
    """Write ``df`` as Parquet and count, in the same pass, its rows (``TOTAL``) and those
    for which each condition of ``counters`` holds (null: not counted).  A task that is
    repeated after a lost executor counts once; an empty table gives zeros."""
    names = list(counters)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("total"),
               *[F.count_if(c).alias(f"c{i}") for i, c in enumerate(counters.values())]).write.parquet(path)
    got = seen.get
    return {"TOTAL": got["total"]} | {n: got[f"c{i}"] for i, n in enumerate(names)}
