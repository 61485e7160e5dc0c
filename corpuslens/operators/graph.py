"""Link graph, categories and per-document boosts.

The canonical adjacency is the long form ``edges(doc_id, src_id)``: a node
with a third of all links is then just many rows spread over many tasks,
never one array in one task.  Aggregates (counts, degrees) use map-side
partial aggregation, so hot nodes cost one partial row per map task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

MERGED = 16  # levels of a category tree that are kept as tables of their own


def build_adjacency(edges: DataFrame) -> DataFrame:
    """Distinct inlinks per node, long form ``(doc_id, src_id)``."""
    return edges.select("doc_id", "src_id").distinct()


def inlink_counts(edges: DataFrame) -> DataFrame:
    """``(doc_id, inlinks)`` number of distinct inlinks."""
    return build_adjacency(edges).groupBy("doc_id").agg(F.count(F.lit(1)).alias("inlinks"))


def symmetrize_edges(lines: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """D3: directed lines -> undirected unique pairs ``(a < b)``; self loops dropped."""
    return (lines.filter(F.col(src) != F.col(dst))
            .select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).distinct())


def degree(edges: DataFrame) -> DataFrame:
    """``(node, in_degree, out_degree)`` over distinct edges ``src_id -> doc_id``."""
    e = build_adjacency(edges)
    ins = e.groupBy(F.col("doc_id").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    outs = e.groupBy(F.col("src_id").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    return (ins.join(outs, "node", "full_outer")
            .select("node", F.coalesce("in_degree", F.lit(0)).alias("in_degree"),
                    F.coalesce("out_degree", F.lit(0)).alias("out_degree")))


def category_closure(category_links: DataFrame, roots: list[str], max_depth: int | None = None,
                     cache: str = "checkpoint") -> DataFrame:
    """Categories reachable from ``roots`` (inclusive) as ``(category)``.

    Breadth-first frontier expansion: join the frontier with the links,
    drop what earlier levels hold (anti join), stop when the frontier is
    empty or ``max_depth`` is reached, so cycles end.  Only what a level adds is
    materialised, so lineage does not grow with depth and a lost executor only
    repeats one level; ``MERGED`` levels become one table, which keeps the plan
    short on deep trees and rewrites a category once in so many levels."""
    spark = category_links.sparkSession
    links = category_links.select("parent", "child").distinct()
    frontier = spark.createDataFrame([(r,) for r in roots], "category string").distinct()
    older, levels = None, [frontier]
    depth = 0
    while max_depth is None or depth < max_depth:
        visited = reduce(DataFrame.unionByName, levels if older is None else [older, *levels])
        nxt = (frontier.join(links, frontier.category == links.parent)
               .select(F.col("child").alias("category")).filter("category IS NOT NULL").distinct()
               .join(visited, "category", "left_anti"))
        nxt = materialize(nxt, cache)
        if nxt.isEmpty():
            break
        levels.append(nxt)
        if len(levels) > MERGED:
            older, levels = materialize(visited.unionByName(nxt), cache), []
        frontier = nxt
        depth += 1
    return reduce(DataFrame.unionByName, levels if older is None else [older, *levels])


def category_extract(category_links: DataFrame, page_categories: DataFrame, roots: list[str],
                     max_depth: int | None = None, cache: str = "checkpoint") -> DataFrame:
    """Distinct articles filed under the roots or their descendants."""
    cats = category_closure(category_links, roots, max_depth, cache)
    return page_categories.join(cats, "category", "left_semi").select("doc_id").distinct()


def largest_category(page_categories: DataFrame) -> DataFrame:
    """The category with most distinct pages (ties: smallest name)."""
    counts = page_categories.select("doc_id", "category").distinct().groupBy("category").agg(
        F.count(F.lit(1)).alias("pages"))
    return counts.orderBy(F.col("pages").desc(), F.col("category")).limit(1)


def document_boost(docs: DataFrame, edges: DataFrame | None, revisions: DataFrame | None,
                   use_inlinks: bool = True, use_count: bool = True, use_volume: bool = True) -> DataFrame:
    """``(doc_id, boost)`` = inlinks factor * count factor * volume factor.

    inlinks = 1 + #distinct inlinks (1 if unused or no links); count = 1 +
    rev_count; volume = 1 + ln(rev_volume), 1 when the volume is missing or
    not positive; both revision factors are 1 without a revision row."""
    out = docs.select("doc_id").distinct()
    boost = F.lit(1.0)
    if use_inlinks and edges is not None:
        out = out.join(inlink_counts(edges), "doc_id", "left")
        boost = boost * (F.lit(1.0) + F.coalesce(F.col("inlinks").cast("double"), F.lit(0.0)))
    if revisions is not None and (use_count or use_volume):
        out = out.join(revisions.select("doc_id", "rev_count", "rev_volume"), "doc_id", "left")
        if use_count:
            boost = boost * (F.lit(1.0) + F.coalesce(F.col("rev_count").cast("double"), F.lit(0.0)))
        if use_volume:
            boost = boost * F.when(F.col("rev_volume") > 0, F.lit(1.0) + F.log(F.col("rev_volume").cast("double"))
                                   ).otherwise(F.lit(1.0))
    return out.select("doc_id", boost.alias("boost"))


def combine_corpora(corpora: list[DataFrame]) -> DataFrame:
    """Union by name; a doc id present in several corpora keeps the row
    of the first corpus listed (groups hold at most len(corpora) rows)."""
    out = None
    for i, c in enumerate(corpora):
        c = c.withColumn("_prio", F.lit(i))
        out = c if out is None else out.unionByName(c)
    w = Window.partitionBy("doc_id").orderBy("_prio")
    return out.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_prio")
