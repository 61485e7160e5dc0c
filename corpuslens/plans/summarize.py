"""G13 and the custom-objective surface: one call from inputs to a summary.

``choose_objective`` applies the dispatch of the batch jobs: revision
statistics -> boosted coverage; else LSH buckets -> weighted coverage plus
bucket diversity; else a link graph -> graph coverage; else word counts ->
weighted coverage; else plain word coverage.  ``summarize`` builds the
cells and runs the chosen selection algorithm.

Custom objectives: any object with a ``cells()`` method returning a
``cells(doc_id, cell, kind, theta, value)`` DataFrame (see
``corpuslens.functions.objectives``) can be passed as ``objective``.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import objectives as O


class CustomObjective(Protocol):
    name: str

    def cells(self) -> DataFrame: ...


class CellsObjective:
    """Wrap a ready cells table as an objective."""

    def __init__(self, name: str, cells: DataFrame):
        self.name, self._cells = name, cells

    def cells(self) -> DataFrame:
        return self._cells


def choose_objective(postings: DataFrame, vocab_size: int, counts: DataFrame | None = None,
                     buckets: DataFrame | None = None, edges: DataFrame | None = None,
                     revisions: DataFrame | None = None, docs: DataFrame | None = None, use_inlinks: bool = True,
                     use_count: bool = True, use_volume: bool = True) -> CellsObjective:
    """The objective the given inputs call for, in this order: ``revisions``
    (coverage boosted by the factors that ``use_inlinks``, ``use_count`` and
    ``use_volume`` switch), ``buckets`` (coverage and LSH buckets), ``edges`` (graph
    coverage over every document, with or without inlinks), ``counts`` (weighted
    coverage), nothing (plain coverage).  ``docs(doc_id)`` are the documents; without
    it those that have postings."""
    base_docs = docs if docs is not None else postings.select("doc_id").distinct()
    if revisions is not None:
        from ..operators.graph import document_boost
        boost = document_boost(base_docs, edges, revisions, use_inlinks, use_count, use_volume)
        if counts is None:
            boosted = postings.join(boost, "doc_id", "left").withColumn(
                "weight", F.col("weight") * F.coalesce(F.col("boost"), F.lit(1.0)))
            return CellsObjective("boosted_word_coverage", O.word_coverage_cells(boosted, vocab_size))
        return CellsObjective("boosted_word_coverage", O.boosted_word_coverage_cells(postings, counts, boost))
    if buckets is not None:
        words = (O.weighted_word_coverage_cells(postings, counts) if counts is not None
                 else O.word_coverage_cells(postings, vocab_size))
        return CellsObjective("word_coverage_lsh", O.combine_cells({"wwc": (words, 1.0),
                                                                     "lsh": (O.lsh_bucket_cells(buckets), 1.0)}))
    if edges is not None:
        return CellsObjective("graph_coverage", O.graph_coverage_cells(edges, candidates=base_docs))
    if counts is not None:
        return CellsObjective("weighted_word_coverage", O.weighted_word_coverage_cells(postings, counts))
    return CellsObjective("word_coverage", O.word_coverage_cells(postings, vocab_size))


def summarize(objective, k: int, method: str = "greedi", partitions: int = 16,
              keep_best: bool = False, batch: int = 16) -> DataFrame:
    """Select ``k`` documents maximising ``objective`` (a CustomObjective or a
    cells DataFrame).  ``method``: ``greedi`` (two rounds), ``lazy`` or
    ``greedy`` (exact, distributed).  Returns ``(objective, rank, doc_id,
    gain, score)``."""
    from ..operators.greedi import greedi_select
    from ..operators.greedy import greedy_select, lazy_greedy_select
    cells = objective if isinstance(objective, DataFrame) else objective.cells()
    name = getattr(objective, "name", "custom")
    if method == "greedi":
        sel = greedi_select(cells, k, partitions, keep_best=keep_best)
    elif method == "lazy":
        sel = lazy_greedy_select(cells, k, batch=batch)
    elif method == "greedy":
        sel = greedy_select(cells, k)
    else:
        raise ValueError(f"unknown method {method!r}")
    return sel.select(F.lit(name).alias("objective"), "rank", "doc_id", "gain", "score")
