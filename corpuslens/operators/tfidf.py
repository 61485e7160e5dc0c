"""Text -> tokens -> tf -> word stats -> pruned, normalised tf-idf.

Partitioning plan: documents are hash-partitioned by ``doc_id`` once (one
shuffle of the raw text, which is smaller than the postings it produces);
tokenising, ``tf`` and the per-document norm then run without another
exchange because ``HashPartitioning(doc_id)`` already satisfies the
clustering on ``(doc_id, term)`` and on ``doc_id``.  Word statistics are the
only shuffle by term (with map-side partial aggregation, so hot terms cost
one row per map task).  The pruned vocabulary is joined back with a
size-checked broadcast.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_stop_word, tokens
from ..session import join_small, materialize, scalar


TASK_TEXT = 16 << 20      # bytes of text whose term counts a task holds, about


def tasks_for(docs: DataFrame) -> int | None:
    """Partitions of at most about ``TASK_TEXT`` bytes of text; None where the session's own
    parallelism gives smaller ones.  A task that counts terms holds them all, so its memory
    follows its texts, and the planner joins partitions by their compressed size."""
    size = scalar(docs.agg(F.sum(F.octet_length("text").cast("bigint")))) or 0
    n = math.ceil(size / TASK_TEXT)
    return n if n > docs.sparkSession.sparkContext.defaultParallelism else None


def tokenize(docs: DataFrame, stop_lang: str | None = "en", stem=None,
             num_partitions: int | None = None) -> DataFrame:
    """``(doc_id, text[, lang])`` -> ``(doc_id, term)``, one row per token.

    Stop words and possessive endings are removed only for documents whose
    ``lang`` is ``stop_lang`` (every document when there is no ``lang``
    column).  ``stem`` is an optional ``Column -> Column`` applied to each
    term.
    """
    has_lang = "lang" in docs.columns
    cols = ["doc_id", "text"] + (["lang"] if has_lang else [])
    parts = (docs.select(*cols).repartition(num_partitions, "doc_id") if num_partitions
             else docs.select(*cols).repartition("doc_id"))
    poss = None
    if stop_lang is not None:
        poss = (F.col("lang") == F.lit(stop_lang)) if has_lang else F.lit(True)
    exploded = parts.select("doc_id", *(["lang"] if has_lang else []),
                            F.explode(tokens(F.col("text"), poss)).alias("term"))
    if stop_lang is not None:
        exploded = exploded.filter(~is_stop_word(F.col("term"), F.col("lang") if has_lang else None, stop_lang))
    if stem is not None:
        exploded = exploded.withColumn("term", stem(F.col("term")))
    return exploded.select("doc_id", "term")


def term_frequency(toks: DataFrame) -> DataFrame:
    """``(doc_id, term, tf)``."""
    return toks.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def word_stats(tf: DataFrame) -> DataFrame:
    """C3+C4: ``(term, df, wc)`` - document frequency and total occurrences."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("wc"))


def df_sigma(stats: DataFrame, center: float = 0.0) -> float:
    """Spread of document frequencies around ``center``: sqrt(avg((df-c)^2))."""
    return scalar(stats.agg(F.sqrt(F.avg(F.pow(F.col("df") - F.lit(center), 2))).alias("s"))) or 0.0


def prune_vocabulary(stats: DataFrame, min_wc: int = 6, min_df: int = 3,
                     max_df_sigma: float | None = 3.0, sigma_center: float = 0.0) -> DataFrame:
    """Keep terms with ``wc >= min_wc``, ``df >= min_df`` and
    ``df <= max_df_sigma * sigma`` (sigma from :func:`df_sigma`)."""
    cond = (F.col("wc") >= min_wc) & (F.col("df") >= min_df)
    if max_df_sigma is not None:
        sigma = df_sigma(stats, sigma_center)
        cond = cond & (F.col("df") <= F.lit(float(max_df_sigma * sigma)))
    return stats.filter(cond)


def idf(df_col, n_docs: int):
    """Lucene's default idf: ``1 + ln(N / (df + 1))``."""
    return F.lit(1.0) + F.log(F.lit(float(n_docs)) / (df_col + F.lit(1.0)))


def tfidf(tf: DataFrame, kept_stats: DataFrame, n_docs: int, kept_rows: int | None = None) -> DataFrame:
    """``(doc_id, term, weight = sqrt(tf) * idf(df))`` over kept terms."""
    joined = join_small(tf, kept_stats.select("term", "df"), "term", known_rows=kept_rows)
    return joined.select("doc_id", "term", (F.sqrt(F.col("tf").cast("double")) * idf(F.col("df"), n_docs)).alias("weight"))


def l2_normalize(postings: DataFrame) -> DataFrame:
    """Divide each weight by its document's 2-norm."""
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("doc_id")))
    return postings.select("doc_id", "term", (F.col("weight") / norm).alias("weight"))


class Corpus:
    """Everything later operators need from the text side; each table is made when it is
    first asked for, so a caller pays for what it uses."""

    def __init__(self, docs: DataFrame, min_wc: int, min_df: int, max_df_sigma: float | None, sigma_center: float,
                 stop_lang: str | None, normalize: bool, num_partitions: int | None, cache: str):
        self._docs, self._prune, self._normalize = docs, (min_wc, min_df, max_df_sigma, sigma_center), normalize
        self._stop_lang, self._partitions = stop_lang, num_partitions
        # statistics and postings feed later steps and operators: staged.  tf has a row for each
        # term of each document, and a cached copy spills several times the text: it is formed
        # in one pass over the texts by each of the two steps that read it
        self._staged = "table" if cache == "checkpoint" else cache

    @cached_property
    def n_docs(self) -> int:
        """Documents before pruning."""
        return self._docs.select("doc_id").count()

    @cached_property
    def tf(self) -> DataFrame:
        """``(doc_id, term, tf)``, all terms."""
        n = self._partitions or tasks_for(self._docs)
        return term_frequency(tokenize(self._docs, self._stop_lang, num_partitions=n))

    @cached_property
    def stats(self) -> DataFrame:
        """``(term, df, wc)``, all terms."""
        return materialize(word_stats(self.tf), self._staged)

    @cached_property
    def kept(self) -> DataFrame:
        """``(term, df, wc)``, pruned vocabulary."""
        return materialize(prune_vocabulary(self.stats, *self._prune), self._staged)

    @cached_property
    def vocab_size(self) -> int:
        return self.kept.count()

    @cached_property
    def postings(self) -> DataFrame:
        """``(doc_id, term, weight)``, pruned and normalised."""
        post = tfidf(self.tf, self.kept, self.n_docs, kept_rows=self.vocab_size)
        return materialize(l2_normalize(post) if self._normalize else post, self._staged)


def build_corpus(docs: DataFrame, min_wc: int = 6, min_df: int = 3,
                 max_df_sigma: float | None = 3.0, sigma_center: float = 0.0,
                 stop_lang: str | None = "en", normalize: bool = True,
                 num_partitions: int | None = None, cache: str = "checkpoint") -> Corpus:
    """C1-C7 in order, each step on first use; ``N`` counts the documents before pruning."""
    return Corpus(docs, min_wc, min_df, max_df_sigma, sigma_center, stop_lang, normalize, num_partitions, cache)
