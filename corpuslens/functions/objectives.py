"""Every objective as one ``cells`` table.

    f(S) = sum over cells of theta(cell) * C({ value(d, cell) : d in S })

``cells(doc_id BIGINT, cell STRING, kind STRING, theta DOUBLE, value DOUBLE,
t INT)`` holds one row per (document, cell) where the document has a value.
The combiner ``C`` is named by ``kind``:

* ``max``          C = max(0, max value)            (coverage family)
* ``sqrt_count``   C = sqrt(#docs of S in the cell)  (LSH bucket diversity)
* ``exactly_one``  C = 1 if exactly one doc of S     (graph cut, not monotone)
* ``influence``    document influence (F6): the cell is a term, ``t`` the
  document's period, ``value`` its novelty and ``theta`` the tail weight
  T(term, t) = sum of spread(term, y) over y >= t.  The term's contribution
  is sum_y spread(term, y) * max{value(s) : s in S, t(s) <= y}, evaluated
  from the step function of S's values over time (at most |S| segments per
  term), so periods are never exploded.

``t`` is null for every kind but ``influence``.

All builders are lazy DataFrame expressions; none collects rows.  The
greedy engines in ``corpuslens.operators.greedy`` work on any such table,
and so does :func:`score`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_small, salted_join, scalar

MAX, SQRT_COUNT, EXACTLY_ONE, INFLUENCE = "max", "sqrt_count", "exactly_one", "influence"
CELL_COLUMNS = ("doc_id", "cell", "kind", "theta", "value", "t")
KINDS = (MAX, SQRT_COUNT, EXACTLY_ONE, INFLUENCE)


def _cells(df: DataFrame, cell: Column, kind: str, theta: Column, value: Column, t: Column | None = None) -> DataFrame:
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), cell.cast("string").alias("cell"),
                     F.lit(kind).alias("kind"), theta.cast("double").alias("theta"),
                     value.cast("double").alias("value"),
                     (t if t is not None else F.lit(None)).cast("int").alias("t"))


# ---------------------------------------------------------------- coverage

def word_coverage_cells(postings: DataFrame, vocab_size: int) -> DataFrame:
    """theta = 1/#V over the pruned vocabulary."""
    return _cells(postings, F.col("term"), MAX, F.lit(1.0 / max(vocab_size, 1)), F.col("weight"))


def importance(count: Column, how: str = "sqrt") -> Column:
    """word importance from a count: sqrt or natural log."""
    if how == "sqrt":
        return F.sqrt(count.cast("double"))
    if how == "log":
        return F.log(count.cast("double"))
    raise ValueError(f"unknown importance {how!r}")


def term_weights(counts: DataFrame, count_col: str = "df", how: str = "sqrt") -> DataFrame:
    """``(term, tw)`` with ``tw = g(c) / sum g(c)`` over the count table."""
    g = counts.select("term", importance(F.col(count_col), how).alias("g"))
    total = scalar(g.agg(F.sum("g"))) or 1.0
    return g.select("term", (F.col("g") / F.lit(float(total))).alias("tw"))


def weighted_word_coverage_cells(postings: DataFrame, counts: DataFrame, count_col: str = "df",
                                 how: str = "sqrt", value: Column | None = None,
                                 counts_rows: int | None = None) -> DataFrame:
    """theta = g(c(w)) / sum g(c).  Terms missing from ``counts`` get
    weight 0 (they contribute nothing)."""
    tw = term_weights(counts, count_col, how)
    joined = join_small(postings, tw, "term", "inner", known_rows=counts_rows)
    return _cells(joined, F.col("term"), MAX, F.col("tw"), value if value is not None else F.col("weight"))


def boosted_word_coverage_cells(postings: DataFrame, counts: DataFrame, boost: DataFrame,
                                count_col: str = "df", how: str = "sqrt",
                                counts_rows: int | None = None) -> DataFrame:
    """F2 on ``weight * boost(doc)``; ``boost(doc_id, boost)`` from
    :func:`corpuslens.operators.graph.document_boost` (missing -> 1)."""
    boosted = (postings.join(boost.select("doc_id", "boost"), "doc_id", "left")
               .withColumn("weight", F.col("weight") * F.coalesce(F.col("boost"), F.lit(1.0))))
    return weighted_word_coverage_cells(boosted, counts, count_col, how, counts_rows=counts_rows)


def lucene_word_coverage_cells(tf: DataFrame, stats: DataFrame, n_docs: int,
                               stats_rows: int | None = None) -> DataFrame:
    """value = sqrt(tf) * idf, theta = sqrt(total tf of the term), no norm."""
    from ..operators.tfidf import idf
    joined = join_small(tf, stats.select("term", "df", "wc"), "term", known_rows=stats_rows)
    return _cells(joined, F.col("term"), MAX, F.sqrt(F.col("wc").cast("double")),
                  F.sqrt(F.col("tf").cast("double")) * idf(F.col("df"), n_docs))


# ------------------------------------------------------------------- graph

def graph_coverage_cells(edges: DataFrame, normalize: bool = False, candidates: DataFrame | None = None) -> DataFrame:
    """F8: a node covers itself and its distinct inlinks.  Candidates are all
    documents of ``candidates(doc_id)`` and all nodes that have inlinks, so a
    node without inlinks covers itself.  ``normalize`` divides by their number."""
    e = edges.select("doc_id", "src_id").distinct()
    nodes = e.select("doc_id") if candidates is None else e.select("doc_id").union(candidates.select("doc_id"))
    own = nodes.distinct().select("doc_id", F.col("doc_id").alias("node"))
    links = e.select("doc_id", F.col("src_id").alias("node"))
    both = own.unionByName(links)
    theta = F.lit(1.0)
    if normalize:
        n = own.count()
        theta = F.lit(1.0 / max(n, 1))
    return _cells(both, F.col("node"), MAX, theta, F.lit(1.0))


def revisions_cells(revisions: DataFrame) -> DataFrame:
    """modular, theta = 1 / sum of counts; a doc is its own cell."""
    total = scalar(revisions.agg(F.sum("rev_count").cast("bigint"))) or 1
    return _cells(revisions, F.col("doc_id"), MAX, F.lit(1.0 / float(total)), F.col("rev_count"))


def cut_cells(undirected: DataFrame) -> DataFrame:
    """each undirected edge ``(a, b)`` is a cell of both endpoints."""
    cell = F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string"))
    ends = (undirected.select(F.col("a").alias("doc_id"), cell.alias("cell"))
            .unionByName(undirected.select(F.col("b").alias("doc_id"), cell.alias("cell"))))
    return _cells(ends, F.col("cell"), EXACTLY_ONE, F.lit(1.0), F.lit(1.0))


# -------------------------------------------------------------------- lsh

def lsh_bucket_cells(buckets: DataFrame) -> DataFrame:
    """bucket B weighs sqrt(#B) / sum #B; combiner sqrt(#(S n B))."""
    sizes = buckets.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"))
    total = scalar(sizes.agg(F.sum("n"))) or 1
    joined = join_small(buckets, sizes, ["band", "bucket"])
    return _cells(joined, F.concat_ws(":", F.col("band").cast("string"), F.col("bucket").cast("string")),
                  SQRT_COUNT, F.sqrt(F.col("n").cast("double")) / F.lit(float(total)), F.lit(1.0))


# -------------------------------------------------------------- influence

def spread_tails(spread: DataFrame, strict: bool = False) -> DataFrame:
    """``(term, period, tail)``: tail = sum of spread(term, y) over y >= period
    (y > period if strict).  A window per term over its periods: a group
    holds at most one row per period, never one per document."""
    w = Window.partitionBy("term").orderBy(F.col("period").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tail = F.sum("weight").over(w)
    if strict:
        tail = tail - F.col("weight")
    return spread.select("term", "period", tail.alias("tail"))


def influence_cells(novelty: DataFrame, dates: DataFrame, spread: DataFrame, strict: bool = False) -> DataFrame:
    """F6 cells: one row per novelty posting, ``t`` = the doc's period and
    ``theta`` = T(term, t).  A doc's own (term, period) always has spread
    (the doc contributes to it), so the tail is an equi-join on
    ``(term, period)``; nothing is exploded over periods."""
    nd = novelty.join(dates.select("doc_id", "period"), "doc_id")
    # a common term in a crowded period is a hot key with one tail row: salted
    joined = salted_join(nd, spread_tails(spread, strict), ["term", "period"], salt_by=["doc_id"])
    return _cells(joined, F.col("term"), INFLUENCE, F.col("tail"), F.col("weight"), F.col("period"))


def influence_segments(selected_cells: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Step function of the selected documents per term (and group):
    ``(group..., cell, lo, t_lo, hi, t_hi, m)``: on periods [lo, hi) the max
    novelty so far is ``m``; ``t_lo``/``t_hi`` are the tails at the bounds
    (``hi`` null = open end, tail 0).  A leading segment (lo null, m = 0)
    covers the periods before the first selected date.  Groups hold at most
    |S| rows per term."""
    g = list(group_cols or [])
    per = (selected_cells.groupBy(*g, "cell", "t")
           .agg(F.max("value").alias("v"), F.max("theta").alias("tail")))
    w = Window.partitionBy(*g, "cell").orderBy("t")
    seg = per.select(*g, "cell", F.col("t").alias("lo"), F.col("tail").alias("t_lo"),
                     F.lead("t").over(w).alias("hi"), F.coalesce(F.lead("tail").over(w), F.lit(0.0)).alias("t_hi"),
                     F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("m"))
    first = (per.groupBy(*g, "cell").agg(F.min_by("t", "t").alias("hi"), F.min_by("tail", "t").alias("t_hi"))
             .select(*g, "cell", F.lit(None).cast("int").alias("lo"), F.lit(None).cast("double").alias("t_lo"),
                     "hi", "t_hi", F.lit(0.0).alias("m")))
    return seg.unionByName(first)


def influence_contribution(t: Column, value: Column, theta: Column, lo: Column, t_lo: Column,
                           hi: Column, t_hi: Column, m: Column) -> Column:
    """Marginal value of a candidate's (term) row on one segment of the cover."""
    active = hi.isNull() | (hi > t)
    start_tail = F.when(lo.isNull() | (t >= lo), theta).otherwise(t_lo)
    return F.when(active, F.greatest(F.lit(0.0), value - m) * (start_tail - t_hi)).otherwise(F.lit(0.0))


def influence_doc_dates_scores(novelty: DataFrame, dates: DataFrame, spread: DataFrame, sets: DataFrame,
                               set_col: str = "trial", strict: bool = False) -> DataFrame:
    """``(set_col, score)``: F6 counted only on the periods on which a
    selected document was published.  Per set: its docs' novelty rows joined
    with its own periods (|S| x |S| per term), the running max per (period,
    term), times the spread of that (period, term)."""
    s = sets.select(set_col, "doc_id").distinct()
    sel = novelty.join(F.broadcast(s), "doc_id").join(dates.select("doc_id", F.col("period").alias("ts")), "doc_id")
    ys = s.join(dates.select("doc_id", F.col("period").alias("y")), "doc_id").select(set_col, "y").distinct()
    cond = (F.col("ts") < F.col("y")) if strict else (F.col("ts") <= F.col("y"))
    m = (sel.join(F.broadcast(ys), set_col).filter(cond)
         .groupBy(set_col, "y", "term").agg(F.max("weight").alias("m")))
    sp = spread.select(F.col("period").alias("y"), "term", F.col("weight").alias("theta"))
    scores = m.join(sp, ["y", "term"]).groupBy(set_col).agg(F.sum(F.col("theta") * F.greatest(F.lit(0.0), F.col("m"))).alias("score"))
    return s.select(set_col).distinct().join(scores, set_col, "left").select(
        set_col, F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))


# ---------------------------------------------------------- combinations

def combine_cells(parts: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """``{name: (cells, lambda)}`` -> one table; cell ids are prefixed by
    the objective name so two objectives never share a cell."""
    out = None
    for name, (cells, lam) in parts.items():
        if lam < 0:
            raise ValueError("weights of a combination must be >= 0")
        c = cells.select("doc_id", F.concat(F.lit(name + "|"), F.col("cell")).alias("cell"), "kind",
                         (F.col("theta") * F.lit(float(lam))).alias("theta"), "value", "t")
        out = c if out is None else out.unionByName(c)
    return out


# ------------------------------------------------------------------ score

def cell_value(kind: Column, theta: Column, vmax: Column, cnt: Column) -> Column:
    """theta * C(...) for one cell, given the max value and count of S in it."""
    return (F.when(kind == MAX, theta * F.greatest(F.lit(0.0), vmax))
            .when(kind == SQRT_COUNT, theta * F.sqrt(cnt.cast("double")))
            .when(kind == EXACTLY_ONE, F.when(cnt == 1, theta).otherwise(F.lit(0.0)))
            .otherwise(F.raise_error(F.concat(F.lit("unknown kind of cell: "), kind))))


def cell_scores(cells: DataFrame, selection: DataFrame, set_col: str | None = None) -> DataFrame:
    """``([set_col,] cell, kind, contrib)`` for the cells touched by the
    selection(s) ``([set_col,] doc_id)``; influence cells are scored from
    their step functions."""
    g = [set_col] if set_col else []
    sets = selection.select(*g, "doc_id").distinct()
    sel = cells.join(F.broadcast(sets), "doc_id") if set_col else cells.join(sets, "doc_id", "left_semi")
    std = sel.filter(F.col("kind") != INFLUENCE)
    per = std.groupBy(*g, "cell", "kind").agg(F.max("theta").alias("theta"), F.max("value").alias("vmax"),
                                              F.count(F.lit(1)).alias("cnt"))
    out = per.select(*g, "cell", "kind", cell_value(F.col("kind"), F.col("theta"), F.col("vmax"), F.col("cnt")).alias("contrib"))
    seg = influence_segments(sel.filter(F.col("kind") == INFLUENCE), g).filter(F.col("lo").isNotNull())
    inf = seg.groupBy(*g, "cell").agg(F.sum(F.col("m") * (F.col("t_lo") - F.col("t_hi"))).alias("contrib"))
    return out.unionByName(inf.select(*g, "cell", F.lit(INFLUENCE).alias("kind"), "contrib"))


def score(cells: DataFrame, selection: DataFrame, objective: str = "objective") -> DataFrame:
    """One row ``(objective, score)``; the empty set scores 0."""
    s = cell_scores(cells, selection).agg(F.coalesce(F.sum("contrib"), F.lit(0.0)).alias("score"))
    return s.select(F.lit(objective).alias("objective"), "score")
