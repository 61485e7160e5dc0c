"""Registered queries: one Spark callable ``(spark, sf_dir) -> DataFrame`` per
inventory key, and the matching DuckDB SQL where one exists.

Each query reads the driver's tables in full (via ``corpuslens.sources``)
and runs the library operator on them.  Doubles are rounded to 6 places so
results compare with the SQL oracle by value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import tfidf as C
from ..session import materialize
from ..sources import tables as TB
from . import oracle_sql as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
GREEDY_K = 5
GREEDI_P = 16
LSH_BANDS, LSH_ROWS = 3, 4
LSH_SEED = "corpuslens"


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = [F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


class Context:
    """Per (session, sf_dir) cache of the expensive shared inputs."""
    _cache: dict = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._corpus = None

    @classmethod
    def of(cls, spark, sf_dir) -> "Context":
        key = (id(spark), sf_dir)
        if key not in cls._cache:
            cls._cache[key] = cls(spark, sf_dir)
        return cls._cache[key]

    @property
    def corpus(self) -> C.Corpus:
        if self._corpus is None:
            self._corpus = C.build_corpus(TB.documents(self.spark, self.sf_dir))
        return self._corpus


def ctx(spark, sf_dir) -> Context:
    return Context.of(spark, sf_dir)


# ---------------------------------------------------------------- C: text

@register("tokenize", Q.with_(Q.TOKS) + "SELECT doc_id, term FROM toks")
def q_tokenize(spark, sf_dir):
    return C.tokenize(TB.documents(spark, sf_dir))


@register("term_frequency", Q.with_(Q.TOKS, Q.TF) + "SELECT doc_id, term, tf FROM tf")
def q_term_frequency(spark, sf_dir):
    return ctx(spark, sf_dir).corpus.tf


@register("document_frequency", Q.with_(Q.TOKS, Q.TF, Q.WS) + "SELECT term, df FROM ws")
def q_document_frequency(spark, sf_dir):
    return ctx(spark, sf_dir).corpus.stats.select("term", "df")


@register("word_count", Q.with_(Q.TOKS, Q.TF, Q.WS) + "SELECT term, wc FROM ws")
def q_word_count(spark, sf_dir):
    return ctx(spark, sf_dir).corpus.stats.select("term", "wc")


@register("prune_vocabulary", Q.with_(Q.TOKS, Q.TF, Q.WS, Q.SIG, Q.KEPT) + "SELECT term, df, wc FROM kept")
def q_prune_vocabulary(spark, sf_dir):
    return ctx(spark, sf_dir).corpus.kept


@register("tfidf", Q.with_(*Q.CORPUS[:-1]) + "SELECT doc_id, term, round(w, 6) AS weight FROM raw")
def q_tfidf(spark, sf_dir):
    c = ctx(spark, sf_dir).corpus
    return rounded(C.tfidf(c.tf, c.kept, c.n_docs, kept_rows=c.vocab_size))


@register("l2_normalize", Q.with_(*Q.CORPUS) + "SELECT doc_id, term, round(weight, 6) AS weight FROM postings")
def q_l2_normalize(spark, sf_dir):
    return rounded(ctx(spark, sf_dir).corpus.postings)


# ------------------------------------------------------------ F/G: select

def f1_cells(spark, sf_dir):
    from ..functions.objectives import word_coverage_cells
    c = ctx(spark, sf_dir).corpus
    return word_coverage_cells(c.postings, c.vocab_size)


@register("greedy_select", Q.greedy_query([*Q.CORPUS, Q.F1_CELLS], GREEDY_K))
def q_greedy_select(spark, sf_dir):
    from ..operators.greedy import greedy_select
    return rounded(greedy_select(f1_cells(spark, sf_dir), GREEDY_K))


def weighted_cells(spark, sf_dir, count_col="df", how="sqrt"):
    from ..functions.objectives import weighted_word_coverage_cells
    c = ctx(spark, sf_dir).corpus
    return weighted_word_coverage_cells(c.postings, c.kept, count_col, how, counts_rows=c.vocab_size)


DOC_CANDIDATES = "SELECT doc_id FROM documents"
TRIALS = 10


def doc_trials(spark, sf_dir):
    from ..operators.baseline import random_select
    return random_select(TB.documents(spark, sf_dir), GREEDY_K, TRIALS)


@register("random_select", Q.with_(Q.random_sets(DOC_CANDIDATES, GREEDY_K, TRIALS)) + "SELECT trial, rank, doc_id FROM rs")
def q_random_select(spark, sf_dir):
    return doc_trials(spark, sf_dir)


@register("word_coverage", Q.with_(*Q.CORPUS, Q.F1_CELLS, Q.random_sets(DOC_CANDIDATES, GREEDY_K, TRIALS))
          + Q.score_sets("cells"))
def q_word_coverage(spark, sf_dir):
    from ..operators.baseline import score_sets
    return rounded(score_sets(f1_cells(spark, sf_dir), doc_trials(spark, sf_dir)))


@register("weighted_word_coverage", Q.with_(*Q.CORPUS, *Q.weighted_cells(), Q.random_sets(DOC_CANDIDATES, GREEDY_K, TRIALS))
          + Q.score_sets("cells"))
def q_weighted_word_coverage(spark, sf_dir):
    from ..operators.baseline import score_sets
    return rounded(score_sets(weighted_cells(spark, sf_dir), doc_trials(spark, sf_dir)))


_IMPORTANCE = [("df", "sqrt"), ("df", "log"), ("wc", "sqrt"), ("wc", "log")]


def _importance_sql():
    parts, ctes = [], []
    for cc, how in _IMPORTANCE:
        name = f"c_{cc}_{how}"
        ctes += Q.weighted_cells(cc, how, name=name)
        parts.append(Q.score_sets(name, extra=f"'{how}' AS importance, '{cc}' AS count_col, "))
    return Q.with_(*Q.CORPUS, *ctes, Q.random_sets(DOC_CANDIDATES, GREEDY_K, TRIALS)) + "\nUNION ALL\n".join(parts)


@register("word_importance", _importance_sql())
def q_word_importance(spark, sf_dir):
    from ..operators.baseline import score_sets
    trials = doc_trials(spark, sf_dir)
    out = None
    for cc, how in _IMPORTANCE:
        s = score_sets(weighted_cells(spark, sf_dir, cc, how), trials).select(
            F.lit(how).alias("importance"), F.lit(cc).alias("count_col"), "trial", "score")
        out = s if out is None else out.unionByName(s)
    return rounded(out)


@register("lazy_greedy_select", Q.greedy_query([*Q.CORPUS, *Q.weighted_cells()], GREEDY_K))
def q_lazy_greedy_select(spark, sf_dir):
    from ..operators.greedy import lazy_greedy_select
    return rounded(lazy_greedy_select(weighted_cells(spark, sf_dir), GREEDY_K, batch=8))


_PARTED = f"pc AS (SELECT *, {Q.part_of(GREEDI_P)} AS part FROM cells)"


@register("greedi_first", Q.with_(*Q.CORPUS, Q.F1_CELLS, _PARTED, *Q.greedy_ctes(GREEDY_K, "pc", "f", grouped=True))
          + Q.selection_select("f", grouped=True))
def q_greedi_first(spark, sf_dir):
    from ..operators.greedi import greedi_first
    return rounded(greedi_first(f1_cells(spark, sf_dir), GREEDY_K, GREEDI_P))


@register("greedi_second", Q.greedi_query([*Q.CORPUS, Q.F1_CELLS], GREEDY_K, GREEDI_P))
def q_greedi_second(spark, sf_dir):
    from ..operators.greedi import greedi_first, greedi_second
    cells = f1_cells(spark, sf_dir)
    return rounded(greedi_second(cells, greedi_first(cells, GREEDY_K, GREEDI_P), GREEDY_K))


@register("greedi_word_coverage", Q.greedi_query([*Q.CORPUS, *Q.weighted_cells()], GREEDY_K, GREEDI_P))
def q_greedi_word_coverage(spark, sf_dir):
    from ..operators.greedi import greedi_select
    return rounded(greedi_select(weighted_cells(spark, sf_dir), GREEDY_K, GREEDI_P))


@register("baseline_stats", Q.with_(*Q.CORPUS, Q.F1_CELLS, *Q.weighted_cells(name="wcells"),
                                    Q.random_sets(DOC_CANDIDATES, GREEDY_K, TRIALS),
                                    "s1 AS (" + Q.score_sets("cells") + ")",
                                    "s2 AS (" + Q.score_sets("wcells") + ")")
          + """SELECT objective, round(mean, 6) AS mean, round(std, 6) AS std, trials FROM (
  SELECT 'word_coverage' AS objective, avg(score) AS mean, stddev_samp(score) AS std, count(*) AS trials FROM s1
  UNION ALL
  SELECT 'weighted_word_coverage', avg(score), stddev_samp(score), count(*) FROM s2) q""")
def q_baseline_stats(spark, sf_dir):
    from ..operators.baseline import baseline_stats, score_sets
    trials = doc_trials(spark, sf_dir)
    s1 = score_sets(f1_cells(spark, sf_dir), trials).withColumn("objective", F.lit("word_coverage"))
    s2 = score_sets(weighted_cells(spark, sf_dir), trials).withColumn("objective", F.lit("weighted_word_coverage"))
    return rounded(baseline_stats(s1.unionByName(s2), ["objective"]))


# ---------------------------------------------------------------- D: graph

CAT_ROOTS = ["EUROPE", "ASIA"]


@register("build_adjacency", Q.with_(Q.EDGES, Q.ADJ) + "SELECT doc_id, src_id FROM adj")
def q_build_adjacency(spark, sf_dir):
    from ..operators.graph import build_adjacency
    return build_adjacency(TB.doc_edges(spark, sf_dir))


@register("inlink_counts", Q.with_(Q.EDGES, Q.ADJ) + "SELECT doc_id, count(*) AS inlinks FROM adj GROUP BY doc_id")
def q_inlink_counts(spark, sf_dir):
    from ..operators.graph import inlink_counts
    return inlink_counts(TB.doc_edges(spark, sf_dir))


@register("symmetrize_edges", Q.with_(Q.LINES, Q.UND) + "SELECT a, b FROM und")
def q_symmetrize_edges(spark, sf_dir):
    from ..operators.graph import symmetrize_edges
    return symmetrize_edges(TB.cut_edges(spark, sf_dir))


@register("degree", Q.with_(Q.EDGES, Q.ADJ) + """SELECT coalesce(i.node, o.node) AS node,
  coalesce(i.in_degree, 0) AS in_degree, coalesce(o.out_degree, 0) AS out_degree
FROM (SELECT doc_id AS node, count(*) AS in_degree FROM adj GROUP BY doc_id) i
FULL OUTER JOIN (SELECT src_id AS node, count(*) AS out_degree FROM adj GROUP BY src_id) o ON i.node = o.node""")
def q_degree(spark, sf_dir):
    from ..operators.graph import degree
    return degree(TB.doc_edges(spark, sf_dir))


def _closure_sql(max_depth=None):
    roots = " UNION ".join(f"SELECT '{r}' AS category, 0 AS depth" for r in CAT_ROOTS)
    lim = f" WHERE cats.depth < {max_depth}" if max_depth is not None else ""
    dep = "cats.depth + 1" if max_depth is not None else "0"
    return ("WITH RECURSIVE " + Q.CATLINKS + ",\n" + Q.PAGECATS + f""",
cats(category, depth) AS ({roots}
  UNION SELECT l.child, {dep} FROM cats JOIN category_links l ON l.parent = cats.category{lim})
SELECT DISTINCT doc_id FROM page_categories WHERE category IN (SELECT category FROM cats)""")


@register("category_extract", _closure_sql())
def q_category_extract(spark, sf_dir):
    from ..operators.graph import category_extract
    return category_extract(TB.category_links(spark, sf_dir), TB.page_categories(spark, sf_dir), CAT_ROOTS)


@register("category_children", _closure_sql(1))
def q_category_children(spark, sf_dir):
    from ..operators.graph import category_extract
    return category_extract(TB.category_links(spark, sf_dir), TB.page_categories(spark, sf_dir), CAT_ROOTS, max_depth=1)


@register("largest_category", Q.with_(Q.PAGECATS) + """SELECT category, count(*) AS pages
FROM (SELECT DISTINCT doc_id, category FROM page_categories) p GROUP BY category ORDER BY pages DESC, category LIMIT 1""")
def q_largest_category(spark, sf_dir):
    from ..operators.graph import largest_category
    return largest_category(TB.page_categories(spark, sf_dir))


@register("document_boost", Q.with_(Q.EDGES, Q.ADJ, Q.REV, Q.boost_cte()) + "SELECT doc_id, round(boost, 6) AS boost FROM boost")
def q_document_boost(spark, sf_dir):
    from ..operators.graph import document_boost
    return rounded(document_boost(TB.documents(spark, sf_dir), TB.doc_edges(spark, sf_dir), TB.revisions(spark, sf_dir)))


@register("combine_corpora", """SELECT doc_id, corpus, length(text) AS n_chars FROM (
  SELECT doc_id, text, 'documents' AS corpus FROM documents
  UNION ALL
  SELECT item_id, text, 'benchmark' FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM documents)) q""")
def q_combine_corpora(spark, sf_dir):
    from ..operators.graph import combine_corpora
    docs = TB.table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("documents").alias("corpus"))
    bench = TB.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text",
                                                        F.lit("benchmark").alias("corpus"))
    return combine_corpora([docs, bench]).select("doc_id", "corpus", F.length("text").alias("n_chars"))


# ------------------------------------------------- F/G on graph and boosts

def graph_cells(spark, sf_dir):
    from ..functions.objectives import graph_coverage_cells
    return graph_coverage_cells(TB.doc_edges(spark, sf_dir), candidates=TB.documents(spark, sf_dir))


def cut_cells(spark, sf_dir):
    from ..functions.objectives import cut_cells as cc
    from ..operators.graph import symmetrize_edges
    return cc(symmetrize_edges(TB.cut_edges(spark, sf_dir)))


def rev_cells(spark, sf_dir):
    from ..functions.objectives import revisions_cells
    return revisions_cells(TB.revisions(spark, sf_dir))


def boosted_cells(spark, sf_dir):
    from ..functions.objectives import boosted_word_coverage_cells
    from ..operators.graph import document_boost
    c = ctx(spark, sf_dir).corpus
    boost = document_boost(TB.documents(spark, sf_dir), TB.doc_edges(spark, sf_dir), TB.revisions(spark, sf_dir))
    return boosted_word_coverage_cells(c.postings, c.kept, boost, counts_rows=c.vocab_size)


def _trials_of(spark, cand: DataFrame):
    from ..operators.baseline import random_select
    return random_select(cand, GREEDY_K, TRIALS)


def _scored(cells, trials):
    from ..operators.baseline import score_sets
    return rounded(score_sets(cells, trials))


def graph_candidates(spark, sf_dir) -> DataFrame:
    """Every document and every node with inlinks, as ``GRAPH_CAND`` in SQL."""
    return TB.doc_edges(spark, sf_dir).select("doc_id").union(TB.documents(spark, sf_dir).select("doc_id"))


GRAPH_CAND = "SELECT doc_id FROM adj UNION SELECT doc_id FROM documents"
CUT_CAND = "SELECT a AS doc_id FROM und UNION SELECT b FROM und"
REV_CAND = "SELECT doc_id FROM rev"
BOOSTED = [*Q.CORPUS, Q.EDGES, Q.ADJ, Q.REV, Q.boost_cte(), Q.BOOSTED_POSTINGS,
           *Q.weighted_cells(src="bpost", value="p.weight", name="bcells")]


@register("graph_coverage", Q.with_(Q.EDGES, Q.ADJ, Q.GRAPH_CELLS, Q.random_sets(GRAPH_CAND, GREEDY_K, TRIALS))
          + Q.score_sets("gcells"))
def q_graph_coverage(spark, sf_dir):
    return _scored(graph_cells(spark, sf_dir), _trials_of(spark, graph_candidates(spark, sf_dir)))


@register("graph_cut", Q.with_(Q.LINES, Q.UND, Q.CUT_CELLS, Q.random_sets(CUT_CAND, GREEDY_K, TRIALS))
          + Q.score_sets("ccells"))
def q_graph_cut(spark, sf_dir):
    cells = cut_cells(spark, sf_dir)
    return _scored(cells, _trials_of(spark, cells))


@register("revisions_sum", Q.with_(Q.REV, Q.REV_CELLS, Q.random_sets(REV_CAND, GREEDY_K, TRIALS))
          + Q.score_sets("rcells"))
def q_revisions_sum(spark, sf_dir):
    return _scored(rev_cells(spark, sf_dir), _trials_of(spark, TB.revisions(spark, sf_dir)))


@register("boosted_word_coverage", Q.with_(*BOOSTED, Q.random_sets(DOC_CANDIDATES, GREEDY_K, TRIALS))
          + Q.score_sets("bcells"))
def q_boosted_word_coverage(spark, sf_dir):
    return _scored(boosted_cells(spark, sf_dir), doc_trials(spark, sf_dir))


@register("greedi_graph", Q.greedi_query([Q.EDGES, Q.ADJ, Q.GRAPH_CELLS], GREEDY_K, GREEDI_P, "gcells"))
def q_greedi_graph(spark, sf_dir):
    from ..operators.greedi import greedi_select
    return rounded(greedi_select(graph_cells(spark, sf_dir), GREEDY_K, GREEDI_P))


@register("greedy_cut", Q.greedy_query([Q.LINES, Q.UND, Q.CUT_CELLS], GREEDY_K, "ccells"))
def q_greedy_cut(spark, sf_dir):
    from ..operators.greedy import greedy_select
    return rounded(greedy_select(cut_cells(spark, sf_dir), GREEDY_K))


@register("greedi_boosted", Q.greedi_query(BOOSTED, GREEDY_K, GREEDI_P, "bcells"))
def q_greedi_boosted(spark, sf_dir):
    from ..operators.greedi import greedi_select
    return rounded(greedi_select(boosted_cells(spark, sf_dir), GREEDY_K, GREEDI_P))


def _variants_sql():
    parts = []
    for code in range(8):
        inl, cnt, vol = bool(code & 4), bool(code & 2), bool(code & 1)
        flags = f"{int(inl)}{int(cnt)}{int(vol)}"
        b = f"b{code}"
        parts.append((Q.boost_cte(b, inl, cnt, vol),
                      f"""SELECT '{flags}' AS flags, round(sum(tw * vmax), 6) AS score FROM (
  SELECT p.term, max(t.tw) AS tw, max(p.weight * coalesce({b}.boost, 1.0)) AS vmax
  FROM postings p JOIN sel0 ON p.doc_id = sel0.doc_id LEFT JOIN {b} ON p.doc_id = {b}.doc_id
  JOIN tw_cells t ON p.term = t.term GROUP BY p.term) q"""))
    ctes = [*Q.CORPUS, Q.EDGES, Q.ADJ, Q.REV, *Q.weighted_cells(), Q.random_sets(DOC_CANDIDATES, GREEDY_K, TRIALS),
            "sel0 AS (SELECT doc_id FROM rs WHERE trial = 0)", *[p[0] for p in parts]]
    return Q.with_(*ctes) + "\nUNION ALL\n".join(p[1] for p in parts)


@register("score_variants", _variants_sql())
def q_score_variants(spark, sf_dir):
    from ..operators.report import score_variants
    c = ctx(spark, sf_dir).corpus
    sel = doc_trials(spark, sf_dir).filter("trial = 0")
    return rounded(score_variants(c.postings, c.kept, sel, TB.doc_edges(spark, sf_dir), TB.revisions(spark, sf_dir)))


@register("selection_report", Q.with_(Q.EDGES, Q.ADJ, Q.REV, Q.REV_CELLS, *Q.greedy_ctes(GREEDY_K, "rcells"),
                                      f"sel AS ({Q.selection_select()})",
                                      """rep AS (SELECT s.rank, s.doc_id, c.c_name AS title, CAST(coalesce(i.inlinks, 0) AS BIGINT) AS inlinks
  FROM sel s LEFT JOIN customer c ON s.doc_id = c.c_custkey
  LEFT JOIN (SELECT doc_id, count(*) AS inlinks FROM adj GROUP BY doc_id) i ON s.doc_id = i.doc_id)""")
          + "SELECT * FROM rep UNION ALL SELECT NULL, NULL, 'TOTAL', CAST(sum(inlinks) AS BIGINT) FROM rep")
def q_selection_report(spark, sf_dir):
    from ..operators.greedy import greedy_select
    from ..operators.report import selection_report
    sel = greedy_select(rev_cells(spark, sf_dir), GREEDY_K)
    return selection_report(sel, TB.category_names(spark, sf_dir), TB.doc_edges(spark, sf_dir))


# ------------------------------------------------ E: lsh, neighbours, novelty

LSH = [*Q.CORPUS, *Q.lsh_ctes(LSH_BANDS, LSH_ROWS, LSH_SEED)]
DATED_LSH = [*LSH, Q.DATES]


class _LshState:
    """Shared LSH inputs, each materialised when it is first asked for."""

    def __init__(self, spark, sf_dir):
        self._corpus, self.dates = ctx(spark, sf_dir).corpus, TB.doc_dates(spark, sf_dir)

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    @cached_property
    def buckets(self) -> DataFrame:
        from ..operators.lsh import lsh_buckets
        return materialize(lsh_buckets(self._corpus.postings, LSH_BANDS, LSH_ROWS, LSH_SEED), "table")

    @cached_property
    def nbr(self) -> DataFrame:
        from ..operators.neighbors import past_neighbor_lsh
        return materialize(past_neighbor_lsh(self._corpus.postings, self.buckets, self.dates), "table")

    @cached_property
    def nov(self) -> DataFrame:
        from ..operators.novelty import novelty
        return materialize(novelty(self._corpus.postings, self.nbr), "table")

    @cached_property
    def spread(self) -> DataFrame:
        from ..operators.novelty import word_spread
        return materialize(word_spread(self._corpus.postings, self.dates), "table")


def _lsh_state(spark, sf_dir) -> _LshState:
    cx = ctx(spark, sf_dir)
    if getattr(cx, "_lsh", None) is None:
        cx._lsh = _LshState(spark, sf_dir)
    return cx._lsh


@register("projection_basis", Q.with_(*LSH[:-2]) + "SELECT row, term, sign FROM basis")
def q_projection_basis(spark, sf_dir):
    from ..operators.lsh import projection_basis
    return projection_basis(ctx(spark, sf_dir).corpus.kept, LSH_BANDS, LSH_ROWS, LSH_SEED)


@register("lsh_signature", Q.with_(*LSH[:-1]) + "SELECT doc_id, row, bit FROM lsig")
def q_lsh_signature(spark, sf_dir):
    from ..operators.lsh import lsh_signature
    return lsh_signature(ctx(spark, sf_dir).corpus.postings, LSH_BANDS, LSH_ROWS, LSH_SEED)


@register("lsh_buckets", Q.with_(*LSH) + "SELECT band, bucket, doc_id FROM buckets")
def q_lsh_buckets(spark, sf_dir):
    return _lsh_state(spark, sf_dir)["buckets"]


@register("bucket_members", Q.with_(*LSH) + """SELECT b.band, b.bucket, b.doc_id, z.size FROM buckets b
JOIN (SELECT band, bucket, count(*) AS size FROM buckets GROUP BY band, bucket) z ON b.band = z.band AND b.bucket = z.bucket""")
def q_bucket_members(spark, sf_dir):
    from ..operators.lsh import bucket_members
    return bucket_members(_lsh_state(spark, sf_dir)["buckets"])


@register("closest_date_neighbor", Q.with_(*DATED_LSH) + """SELECT b.band, b.bucket, b.doc_id,
  lag(b.doc_id) OVER (PARTITION BY b.band, b.bucket ORDER BY d.period, b.doc_id) AS neighbor_id
FROM buckets b JOIN dates d ON b.doc_id = d.doc_id""")
def q_closest_date_neighbor(spark, sf_dir):
    from ..operators.lsh import closest_date_neighbor
    st = _lsh_state(spark, sf_dir)
    return closest_date_neighbor(st["buckets"], st["dates"])


@register("first_past_neighbor", Q.with_(*DATED_LSH, "bd AS (SELECT b.band, b.bucket, b.doc_id, d.period FROM buckets b JOIN dates d ON b.doc_id = d.doc_id)")
          + """SELECT x.doc_id, min(y.doc_id) AS neighbor_id FROM bd x JOIN bd y
  ON x.band = y.band AND x.bucket = y.bucket AND y.period <= x.period AND y.doc_id <> x.doc_id GROUP BY x.doc_id""")
def q_first_past_neighbor(spark, sf_dir):
    from ..operators.lsh import first_past_neighbor
    st = _lsh_state(spark, sf_dir)
    return first_past_neighbor(st["buckets"], st["dates"])


@register("past_neighbor_lsh", Q.with_(*DATED_LSH, *Q.NEIGHBORS_LSH) + "SELECT doc_id, neighbor_id, round(dot, 6) AS dot FROM nbr")
def q_past_neighbor_lsh(spark, sf_dir):
    return rounded(_lsh_state(spark, sf_dir)["nbr"])


@register("past_neighbor_exact", Q.with_(*Q.CORPUS, Q.DATES, *Q.NEIGHBORS_EXACT)
          + "SELECT doc_id, neighbor_id, round(dot, 6) AS dot FROM xnbr")
def q_past_neighbor_exact(spark, sf_dir):
    from ..operators.neighbors import past_neighbor_exact
    return rounded(past_neighbor_exact(ctx(spark, sf_dir).corpus.postings, TB.doc_dates(spark, sf_dir)))


NOVELTY = [*DATED_LSH, *Q.NEIGHBORS_LSH, Q.novelty_cte()]


@register("novelty", Q.with_(*NOVELTY) + "SELECT doc_id, term, round(weight, 6) AS weight FROM nov")
def q_novelty(spark, sf_dir):
    return rounded(_lsh_state(spark, sf_dir)["nov"])


@register("novelty_ignore_isolated", Q.with_(*DATED_LSH, *Q.NEIGHBORS_LSH, Q.novelty_cte(inner=True))
          + "SELECT doc_id, term, round(weight, 6) AS weight FROM nov")
def q_novelty_ignore_isolated(spark, sf_dir):
    from ..operators.novelty import novelty
    st = _lsh_state(spark, sf_dir)
    return rounded(novelty(ctx(spark, sf_dir).corpus.postings, st["nbr"], ignore_isolated=True))


@register("novelty_stats", Q.with_(*DATED_LSH, *Q.NEIGHBORS_LSH, Q.novelty_cte(),
                                   "docs AS (SELECT DISTINCT doc_id FROM postings)",
                                   """perband AS (SELECT x.doc_id, count(DISTINCT x.band) AS nb FROM bd x JOIN bd y
  ON x.band = y.band AND x.bucket = y.bucket AND """ + Q.EARLIER + " GROUP BY x.doc_id)")
          + """SELECT 'TOTAL' AS counter, CAST(count(*) AS BIGINT) AS value FROM docs
UNION ALL SELECT 'POTENTIALLY_IGNORED', CAST(count(*) AS BIGINT) FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM nbr)
UNION ALL SELECT 'DUPLICATES', CAST(count(*) AS BIGINT) FROM perband WHERE nb > 1""")
def q_novelty_stats(spark, sf_dir):
    from ..operators.novelty import novelty_stats
    st = _lsh_state(spark, sf_dir)
    return novelty_stats(ctx(spark, sf_dir).corpus.postings, st["nbr"], st["buckets"], st["dates"])


@register("dedup_by_id", Q.with_(*LSH) + """SELECT p.doc_id, p.term, round(p.weight, 6) AS weight
FROM postings p JOIN (SELECT doc_id, min(band) AS band FROM buckets GROUP BY doc_id) m ON p.doc_id = m.doc_id""")
def q_dedup_by_id(spark, sf_dir):
    from ..operators.novelty import dedup_by_id
    st = _lsh_state(spark, sf_dir)
    per_band = ctx(spark, sf_dir).corpus.postings.join(st["buckets"].select("doc_id", "band"), "doc_id")
    return rounded(dedup_by_id(per_band, "band"))


@register("word_spread", Q.with_(*Q.CORPUS, Q.DATES, Q.SPREAD) + "SELECT period, term, round(weight, 6) AS weight FROM spread")
def q_word_spread(spark, sf_dir):
    return rounded(_lsh_state(spark, sf_dir)["spread"])


@register("cosine_similarity", Q.with_(*Q.CORPUS) + """SELECT doc_a, doc_b, round(dot, 6) AS dot, round(1.0 - dot, 6) AS distance FROM (
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, sum(a.weight * b.weight) AS dot
  FROM postings a JOIN postings b ON a.term = b.term WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id) q""")
def q_cosine_similarity(spark, sf_dir):
    from ..operators.similarity import all_dots
    return rounded(all_dots(ctx(spark, sf_dir).corpus.postings))


# ------------------------------------------- F/G on lsh and influence cells

def lsh_cells(spark, sf_dir):
    from ..functions.objectives import lsh_bucket_cells
    return lsh_bucket_cells(_lsh_state(spark, sf_dir)["buckets"])


def infl_cells(spark, sf_dir, strict=False):
    from ..functions.objectives import influence_cells
    st = _lsh_state(spark, sf_dir)
    return influence_cells(st["nov"], st["dates"], st["spread"], strict=strict)


INFLUENCE = [*NOVELTY, Q.SPREAD, Q.influence_cells()]


@register("lsh_bucket_coverage", Q.with_(*LSH, Q.LSH_CELLS, Q.random_sets(DOC_CANDIDATES, GREEDY_K, TRIALS))
          + Q.score_sets("lcells"))
def q_lsh_bucket_coverage(spark, sf_dir):
    return _scored(lsh_cells(spark, sf_dir), doc_trials(spark, sf_dir))


@register("combine_objectives", Q.with_(*LSH, Q.LSH_CELLS, *Q.weighted_cells(name="wcells"),
                                        Q.combine([("wwc", "wcells", 1.0), ("lsh", "lcells", 0.5)]),
                                        Q.random_sets(DOC_CANDIDATES, GREEDY_K, TRIALS))
          + Q.score_sets("mcells"))
def q_combine_objectives(spark, sf_dir):
    from ..functions.objectives import combine_cells
    cells = combine_cells({"wwc": (weighted_cells(spark, sf_dir), 1.0), "lsh": (lsh_cells(spark, sf_dir), 0.5)})
    return _scored(cells, doc_trials(spark, sf_dir))


@register("greedi_lsh_coverage", Q.greedi_query([*LSH, Q.LSH_CELLS, *Q.weighted_cells(name="wcells"),
                                                 Q.combine([("wwc", "wcells", 1.0), ("lsh", "lcells", 1.0)])],
                                                GREEDY_K, GREEDI_P, "mcells"))
def q_greedi_lsh_coverage(spark, sf_dir):
    from ..functions.objectives import combine_cells
    from ..operators.greedi import greedi_select
    cells = combine_cells({"wwc": (weighted_cells(spark, sf_dir), 1.0), "lsh": (lsh_cells(spark, sf_dir), 1.0)})
    return rounded(greedi_select(cells, GREEDY_K, GREEDI_P))


@register("document_influence", Q.with_(*INFLUENCE, Q.random_sets(DOC_CANDIDATES, GREEDY_K, TRIALS))
          + Q.score_sets("icells"))
def q_document_influence(spark, sf_dir):
    return _scored(infl_cells(spark, sf_dir), doc_trials(spark, sf_dir))


@register("influence_doc_dates", Q.with_(*INFLUENCE, Q.random_sets(DOC_CANDIDATES, GREEDY_K, TRIALS),
                                         """rsc AS (SELECT r.trial, c.* FROM rs r JOIN icells c ON r.doc_id = c.doc_id
  WHERE c.y IN (SELECT d.period FROM rs r2 JOIN dates d ON r2.doc_id = d.doc_id WHERE r2.trial = r.trial))""")
          + """SELECT t.trial, round(coalesce(s.score, 0.0), 6) AS score FROM (SELECT DISTINCT trial FROM rs) t LEFT JOIN (
  SELECT trial, sum(theta * greatest(0.0, vmax)) AS score FROM (
    SELECT trial, cell, max(theta) AS theta, max(value) AS vmax FROM rsc GROUP BY trial, cell) x GROUP BY trial) s
  ON t.trial = s.trial""")
def q_influence_doc_dates(spark, sf_dir):
    from ..functions.objectives import influence_doc_dates_scores
    st = _lsh_state(spark, sf_dir)
    return rounded(influence_doc_dates_scores(st["nov"], st["dates"], st["spread"], doc_trials(spark, sf_dir)))


@register("greedi_influence", Q.greedi_query(INFLUENCE, GREEDY_K, GREEDI_P, "icells"))
def q_greedi_influence(spark, sf_dir):
    from ..operators.greedi import greedi_select
    return rounded(greedi_select(infl_cells(spark, sf_dir), GREEDY_K, GREEDI_P))


# --------------------------------------------------------- B: pages and ids

def _classified(spark, sf_dir):
    from ..functions.pages import classify_pages, html_pages
    return classify_pages(html_pages(TB.table(spark, sf_dir, "pages")))


@register("classify_page", Q.with_(*Q.classified_pages()) + "SELECT doc_id, title, page_type FROM cp")
def q_classify_page(spark, sf_dir):
    return _classified(spark, sf_dir).select("doc_id", "title", "page_type")


@register("page_type_counts", Q.with_(*Q.classified_pages()) + """SELECT page_type, count(*) AS pages FROM cp GROUP BY page_type
UNION ALL SELECT 'TOTAL', count(*) FROM cp""")
def q_page_type_counts(spark, sf_dir):
    from ..functions.pages import page_type_counts
    return page_type_counts(_classified(spark, sf_dir))


@register("pages_to_text", Q.with_(*Q.classified_pages()) + "SELECT doc_id, content AS text FROM cp WHERE page_type = 'ARTICLE'")
def q_pages_to_text(spark, sf_dir):
    from ..functions.pages import pages_to_text
    return pages_to_text(_classified(spark, sf_dir))


@register("document_date", """SELECT event_id AS doc_id, CAST(year(ts) * 1000 + dayofyear(ts) AS INTEGER) AS period
FROM events WHERE ts IS NOT NULL""")
def q_document_date(spark, sf_dir):
    from ..functions.pages import document_date
    ev = TB.table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("doc_id"), document_date(F.col("ts")).alias("period")).filter(
        F.col("period").isNotNull())


@register("date_from_id", "SELECT doc_id, CAST((((doc_id // 100) % 100) + 100) % 100 AS INTEGER) AS period FROM documents")
def q_date_from_id(spark, sf_dir):
    from ..functions.pages import date_from_id
    return TB.table(spark, sf_dir, "documents").select("doc_id", date_from_id("doc_id", 100, 100).alias("period"))


_AAN_SQL = ("upper(substr(event_type, 1, 1)) || lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') || '-' "
            "|| lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0')")
_NIPS_SQL = ("'file is ../nipsdata/txt/nips' || lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') || '/' "
             "|| lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') || '.txt'")


@register("paper_key", f"""SELECT event_id, name, CAST(CAST(ascii(name) % 100 AS VARCHAR) || substr(name, 2, 2) || substr(name, 5, 4) AS BIGINT) AS aan_key,
  CAST(substr(line, 29, 2) AS BIGINT) * 10000 + CAST(substr(line, 32, 4) AS BIGINT) AS nips_key
FROM (SELECT event_id, {_AAN_SQL} AS name, {_NIPS_SQL} AS line FROM events) q""")
def q_paper_key(spark, sf_dir):
    from ..functions.pages import aan_key, nips_key
    ev = TB.table(spark, sf_dir, "events")
    two = F.lpad((F.col("user_id") % 100).cast("string"), 2, "0")
    four = F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0")
    named = ev.select("event_id",
                      F.concat(F.upper(F.substring("event_type", 1, 1)), two, F.lit("-"), four).alias("name"),
                      F.concat(F.lit("file is ../nipsdata/txt/nips"), two, F.lit("/"), four, F.lit(".txt")).alias("line"))
    return named.select("event_id", "name", aan_key(F.col("name")).alias("aan_key"), nips_key(F.col("line")).alias("nips_key"))


@register("extract_ids", Q.with_(*Q.CORPUS) + "SELECT DISTINCT doc_id FROM postings")
def q_extract_ids(spark, sf_dir):
    return ctx(spark, sf_dir).corpus.postings.select("doc_id").distinct()


@register("filter_subset", Q.with_(*Q.CORPUS, Q.random_sets(DOC_CANDIDATES, GREEDY_K, TRIALS))
          + "SELECT doc_id, term, round(weight, 6) AS weight FROM postings WHERE doc_id IN (SELECT doc_id FROM rs WHERE trial = 0)")
def q_filter_subset(spark, sf_dir):
    subset = doc_trials(spark, sf_dir).filter("trial = 0").select("doc_id")
    return rounded(ctx(spark, sf_dir).corpus.postings.join(F.broadcast(subset), "doc_id", "left_semi"))


@register("partition_docs", "SELECT doc_id, CAST(((doc_id % 10) + 10) % 10 AS INTEGER) AS part FROM documents")
def q_partition_docs(spark, sf_dir):
    from ..functions.pages import partition_of
    return TB.table(spark, sf_dir, "documents").select("doc_id", partition_of(F.col("doc_id"), 10).alias("part"))


# ------------------------------------------- A: sources (write, then read)

def _io(spark, name):
    from ..sources.files import scratch_path
    return scratch_path(spark, name)


@register("read_wiki_dump", Q.with_(*Q.classified_pages()) + "SELECT doc_id, title, content AS text, is_article FROM cp")
def q_read_wiki_dump(spark, sf_dir):
    from ..functions.pages import html_pages
    from ..sources.files import read_wiki_dump, write_wiki_dump
    pages = html_pages(TB.table(spark, sf_dir, "pages")).select("doc_id", "title", F.col("content").alias("text"),
                                                                F.lit(None).cast("string").alias("ts"))
    path = _io(spark, "wiki")
    write_wiki_dump(pages, path)
    return read_wiki_dump(spark, path).select("doc_id", "title", "text", "is_article")


@register("read_text_dir", "SELECT doc_id, text FROM documents")
def q_read_text_dir(spark, sf_dir):
    from ..sources.files import read_text_dir, write_text_dir
    path = _io(spark, "text")
    write_text_dir(TB.table(spark, sf_dir, "documents"), path)
    return read_text_dir(spark, path).select("doc_id", "text")


@register("read_edge_list", "SELECT user_id AS doc_id, event_id AS src_id FROM events")
def q_read_edge_list(spark, sf_dir):
    from ..sources.files import read_edge_list, write_lines
    path = _io(spark, "edges")
    write_lines(TB.doc_edges(spark, sf_dir), ["doc_id", "src_id"], path)
    return read_edge_list(spark, path)


@register("read_revision_stats", Q.with_(Q.REV) + "SELECT doc_id, rev_count, rev_volume FROM rev")
def q_read_revision_stats(spark, sf_dir):
    from ..sources.files import read_revision_stats, write_lines
    path = _io(spark, "revisions")
    write_lines(TB.revisions(spark, sf_dir), ["doc_id", "rev_count", "rev_volume"], path)
    return read_revision_stats(spark, path, with_volume=True)


@register("read_dense_matrix", """SELECT vec_id AS doc_id, CAST(pos - 1 AS VARCHAR) AS term, round(CAST(v AS DOUBLE), 6) AS weight
FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) q
WHERE abs(v) > 1e-5""")
def q_read_dense_matrix(spark, sf_dir):
    from ..sources.files import read_dense_matrix, write_dense_matrix
    m, n = _io(spark, "matrix"), _io(spark, "names")
    write_dense_matrix(TB.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", m, n)
    return rounded(read_dense_matrix(spark, m, n, value_type="float"))


@register("read_word_counts", Q.with_(Q.TOKS, Q.TF, Q.WS, Q.SIG, Q.KEPT) + "SELECT term, df AS count FROM kept")
def q_read_word_counts(spark, sf_dir):
    from ..sources.files import read_word_counts
    path = _io(spark, "wordcounts")
    ctx(spark, sf_dir).corpus.kept.write.mode("overwrite").parquet(path)
    return read_word_counts(spark, path, "df")


@register("read_vectors", Q.with_(*Q.CORPUS) + "SELECT doc_id, term, round(weight, 6) AS weight FROM postings")
def q_read_vectors(spark, sf_dir):
    from ..sources.files import read_vectors, write_vectors
    path = _io(spark, "vectors")
    write_vectors(ctx(spark, sf_dir).corpus.postings, path)
    return rounded(read_vectors(spark, path))


@register("read_adjacency", Q.with_(Q.EDGES, Q.ADJ, Q.random_sets(GRAPH_CAND, GREEDY_K, TRIALS))
          + "SELECT doc_id, src_id FROM adj WHERE doc_id IN (SELECT doc_id FROM rs)")
def q_read_adjacency(spark, sf_dir):
    from ..operators.graph import build_adjacency
    from ..sources.files import read_adjacency
    path = _io(spark, "adjacency")
    build_adjacency(TB.doc_edges(spark, sf_dir)).write.mode("overwrite").parquet(path)
    ids = _trials_of(spark, graph_candidates(spark, sf_dir)).select("doc_id")
    return read_adjacency(spark, path, ids)


@register("read_buckets", Q.with_(*LSH) + "SELECT band, bucket, doc_id FROM buckets")
def q_read_buckets(spark, sf_dir):
    from ..sources.files import read_buckets
    path = _io(spark, "buckets")
    _lsh_state(spark, sf_dir)["buckets"].write.mode("overwrite").parquet(path)
    return read_buckets(spark, path)


@register("read_dates", Q.with_(Q.DATES) + "SELECT doc_id, period FROM dates")
def q_read_dates(spark, sf_dir):
    from ..sources.files import read_dates
    path = _io(spark, "dates")
    TB.doc_dates(spark, sf_dir).write.mode("overwrite").parquet(path)
    return read_dates(spark, path)


@register("read_selection", Q.with_(Q.REV, Q.REV_CELLS, *Q.greedy_ctes(GREEDY_K, "rcells")) + "SELECT doc_id FROM g_all")
def q_read_selection(spark, sf_dir):
    from ..operators.greedy import greedy_select
    from ..sources.files import read_selection, write_selection
    path = _io(spark, "selection")
    write_selection(greedy_select(rev_cells(spark, sf_dir), GREEDY_K), path, as_text=True)
    return read_selection(spark, path, as_text=True)


@register("read_citations", "SELECT CAST(user_id AS VARCHAR) AS paper_id, CAST(count(*) AS INTEGER) AS cites FROM events GROUP BY user_id")
def q_read_citations(spark, sf_dir):
    from ..sources.files import read_citations_aan, write_lines
    path = _io(spark, "citations")
    write_lines(TB.citations(spark, sf_dir), ["cites", "paper_id"], path, sep="\t")
    return read_citations_aan(spark, path)


@register("read_wiki_tables", Q.with_(Q.PAGECATS) + "SELECT doc_id, category FROM page_categories")
def q_read_wiki_tables(spark, sf_dir):
    from ..sources.files import read_wiki_tables
    paths = {k: _io(spark, k) for k in ("pages", "links", "cats", "pagecats")}
    TB.category_names(spark, sf_dir).write.mode("overwrite").option("header", "true").csv(paths["pages"])
    TB.doc_edges(spark, sf_dir).select("src_id", "doc_id").write.mode("overwrite").option("header", "true").csv(paths["links"])
    TB.category_links(spark, sf_dir).write.mode("overwrite").option("header", "true").csv(paths["cats"])
    TB.page_categories(spark, sf_dir).write.mode("overwrite").option("header", "true").csv(paths["pagecats"])
    t = read_wiki_tables(spark, paths["pages"], paths["links"], paths["cats"], paths["pagecats"], fmt="csv")
    return t["page_categories"]


# ------------------------------------------- F5, G10, F14, H2-H5 reports

def lucene_cells(spark, sf_dir):
    from ..functions.objectives import lucene_word_coverage_cells
    c = ctx(spark, sf_dir).corpus
    return lucene_word_coverage_cells(c.tf, c.stats, c.n_docs)


LUCENE = [Q.TOKS, Q.TF, Q.WS, Q.ND, Q.LUCENE_CELLS]


@register("lucene_word_coverage", Q.with_(*LUCENE, Q.random_sets(DOC_CANDIDATES, GREEDY_K, TRIALS)) + Q.score_sets("lucells"))
def q_lucene_word_coverage(spark, sf_dir):
    return _scored(lucene_cells(spark, sf_dir), doc_trials(spark, sf_dir))


@register("greedy_lucene", Q.greedy_query(LUCENE, GREEDY_K, "lucells"))
def q_greedy_lucene(spark, sf_dir):
    from ..operators.greedy import greedy_select
    return rounded(greedy_select(lucene_cells(spark, sf_dir), GREEDY_K))


_CROSS = [("word_coverage", "cells", "ga"), ("weighted_word_coverage", "wcells", "gb"), ("lsh_bucket_coverage", "lcells", "gc")]


def _cross_sql():
    ctes = [*LSH, Q.F1_CELLS, *Q.weighted_cells(name="wcells"), Q.LSH_CELLS]
    for _, cells, pre in _CROSS:
        ctes += Q.greedy_ctes(GREEDY_K, cells, pre)
    ctes.append("sets AS (" + " UNION ALL ".join(f"SELECT '{n}' AS selection, doc_id FROM {p}_all" for n, _, p in _CROSS) + ")")
    ctes.append("sc AS (" + "\nUNION ALL\n".join(
        Q.score_sets(c, "sets", "selection", extra=f"'{n}' AS objective, ", digits=None) for n, c, _ in _CROSS) + ")")
    return Q.with_(*ctes) + """SELECT s.selection, s.objective, round(s.score, 6) AS score,
  round(CASE WHEN o.score > 0 THEN s.score / o.score END, 6) AS relative
FROM sc s LEFT JOIN sc o ON o.selection = s.objective AND o.objective = s.objective"""


@register("cross_score", _cross_sql())
def q_cross_score(spark, sf_dir):
    from ..operators.greedy import greedy_select
    from ..operators.report import cross_score
    cells = {"word_coverage": f1_cells(spark, sf_dir), "weighted_word_coverage": weighted_cells(spark, sf_dir),
             "lsh_bucket_coverage": lsh_cells(spark, sf_dir)}
    sels = {n: greedy_select(c, GREEDY_K) for n, c in cells.items()}
    return rounded(cross_score(cells, sels))


@register("citation_count", Q.with_(Q.EDGES, Q.ADJ, Q.GRAPH_CELLS, *Q.greedy_ctes(GREEDY_K, "gcells"))
          + """SELECT CAST(coalesce(sum(c.cites), 0) AS BIGINT) AS citations FROM g_all s
LEFT JOIN (SELECT user_id AS paper_id, count(*) AS cites FROM events GROUP BY user_id) c ON s.doc_id = c.paper_id""")
def q_citation_count(spark, sf_dir):
    from ..operators.greedy import greedy_select
    from ..operators.report import citation_count
    return citation_count(greedy_select(graph_cells(spark, sf_dir), GREEDY_K), TB.citations(spark, sf_dir))


@register("citation_bound", f"""WITH c AS (SELECT user_id AS paper_id, count(*) AS cites FROM events GROUP BY user_id)
SELECT 'best' AS metric, CAST(coalesce(sum(cites), 0) AS BIGINT) AS citations
  FROM (SELECT cites FROM c ORDER BY cites DESC, paper_id LIMIT {GREEDY_K}) t
UNION ALL SELECT 'total', CAST(coalesce(sum(cites), 0) AS BIGINT) FROM c""")
def q_citation_bound(spark, sf_dir):
    from ..operators.report import citation_bound
    return citation_bound(TB.citations(spark, sf_dir), GREEDY_K)


@register("cosine_diff", Q.with_(*Q.CORPUS, Q.EMB_POSTINGS, Q.pair_dots("postings", "ours"), Q.pair_dots("embp", "refd"),
                                 "ref AS (SELECT doc_a, doc_b, 1.0 - dot AS value FROM refd)",
                                 """errs AS (SELECT r.doc_a, r.doc_b, abs((1.0 - coalesce(o.dot, 0.0)) - r.value) AS error
  FROM ref r LEFT JOIN ours o ON r.doc_a = o.doc_a AND r.doc_b = o.doc_b WHERE NOT isnan(r.value))""")
          + """SELECT count(*) AS cells, CAST(coalesce(sum(CASE WHEN error > 1e-2 THEN 1 ELSE 0 END), 0) AS BIGINT) AS over_threshold,
  round(coalesce(sum(error), 0.0), 6) AS total_error FROM errs""")
def q_cosine_diff(spark, sf_dir):
    from ..operators.report import cosine_diff_summary, vector_errors
    from ..operators.tfidf import l2_normalize
    from ..sources.files import dense_to_postings
    emb = l2_normalize(dense_to_postings(TB.table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return rounded(cosine_diff_summary(vector_errors(ctx(spark, sf_dir).corpus.postings, emb)))


@register("vector_diff", Q.with_(*NOVELTY) + """SELECT doc_id, round(sq, 6) AS sq_dist, CASE WHEN na = 0 THEN 'missing_left'
  WHEN nb = 0 THEN 'missing_right' WHEN sq > 1e-2 THEN 'over' ELSE 'ok' END AS status FROM (
  SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, sum((coalesce(a.weight, 0.0) - coalesce(b.weight, 0.0)) ^ 2) AS sq,
    count(a.weight) AS na, count(b.weight) AS nb
  FROM postings a FULL OUTER JOIN nov b ON a.doc_id = b.doc_id AND a.term = b.term
  GROUP BY coalesce(a.doc_id, b.doc_id)) q""")
def q_vector_diff(spark, sf_dir):
    from ..operators.report import vector_diff
    return rounded(vector_diff(ctx(spark, sf_dir).corpus.postings, _lsh_state(spark, sf_dir)["nov"]))


# ------------------------------------------------ I: clustering; G13 dispatch

KMEANS_K = 10


@register("kmeans_docs")
def q_kmeans_docs(spark, sf_dir):
    from ..operators.cluster import dense_features, kmeans_docs
    return kmeans_docs(dense_features(TB.table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), KMEANS_K)


@register("sketch_kmeans")
def q_sketch_kmeans(spark, sf_dir):
    from ..operators.cluster import dense_features, sketch_kmeans
    feats = dense_features(TB.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return sketch_kmeans(feats, KMEANS_K, sketch_size=100, partitions=GREEDI_P, fan_in=4)


# every branch of the dispatch, with the cells it stands for
DISPATCH = {
    "boosted_word_coverage": (BOOSTED, "bcells"),
    "word_coverage_lsh": ([*LSH, Q.LSH_CELLS, *Q.weighted_cells(name="wcells"),
                           Q.combine([("wwc", "wcells", 1.0), ("lsh", "lcells", 1.0)])], "mcells"),
    "graph_coverage": ([Q.EDGES, Q.ADJ, Q.GRAPH_CELLS], "gcells"),
    "weighted_word_coverage": ([*Q.CORPUS, *Q.weighted_cells()], "cells"),
    "word_coverage": ([*Q.CORPUS, Q.F1_CELLS], "cells"),
}


@register("choose_objective", "\nUNION ALL\n".join(
    f"SELECT '{name}' AS objective, b.* FROM ({Q.greedi_query(ctes, GREEDY_K, GREEDI_P, cells)}) b"
    for name, (ctes, cells) in DISPATCH.items()))
def q_choose_objective(spark, sf_dir):
    from .summarize import choose_objective, summarize
    c = ctx(spark, sf_dir).corpus
    docs, edges = TB.documents(spark, sf_dir), TB.doc_edges(spark, sf_dir)
    given = [{"counts": c.kept, "edges": edges, "revisions": TB.revisions(spark, sf_dir)},
             {"counts": c.kept, "buckets": _lsh_state(spark, sf_dir)["buckets"]}, {"edges": edges}, {"counts": c.kept}, {}]
    out = [summarize(choose_objective(c.postings, c.vocab_size, docs=docs, **g), GREEDY_K, method="greedi", partitions=GREEDI_P)
           for g in given]
    return rounded(reduce(DataFrame.unionByName, out))


# ------------------------------------------------ extension surface

@register("custom_objective", Q.greedy_query([*Q.CORPUS, Q.F1_CELLS], GREEDY_K).replace(
    "SELECT CAST(r AS INTEGER) AS rank", "SELECT 'custom' AS objective, CAST(r AS INTEGER) AS rank"))
def q_custom_objective(spark, sf_dir):
    """A user-defined objective is any cells table; here word coverage wrapped
    as a custom objective and run through ``summarize``."""
    from .summarize import CellsObjective, summarize
    return rounded(summarize(CellsObjective("custom", f1_cells(spark, sf_dir)), GREEDY_K, method="lazy"))
