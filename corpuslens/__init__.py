"""corpuslens: document summarisation by submodular selection on Spark.

Typical use::

    from corpuslens import build_corpus, choose_objective, summarize
    corpus = build_corpus(spark.read.parquet(".../documents.parquet"))
    objective = choose_objective(corpus.postings, corpus.vocab_size, counts=corpus.kept)
    summary = summarize(objective, k=40)            # GreeDi, two rounds

Every operator is a DataFrame function; see README.md for the inventory.
"""

import sys as _sys

# Functions that run in Python workers (applyInPandas / mapInPandas kernels)
# are shipped by value, so executors need no installed copy of this package.
from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from .functions.objectives import (boosted_word_coverage_cells, combine_cells, cut_cells, graph_coverage_cells,
                                   influence_cells, lsh_bucket_cells, lucene_word_coverage_cells, revisions_cells,
                                   score, weighted_word_coverage_cells, word_coverage_cells)
from .operators.greedi import greedi_select
from .operators.greedy import greedy_select, lazy_greedy_select
from .operators.tfidf import build_corpus
from .plans.summarize import CellsObjective, choose_objective, summarize
from .session import get_session

__all__ = [
    "build_corpus", "word_coverage_cells", "weighted_word_coverage_cells", "boosted_word_coverage_cells",
    "lucene_word_coverage_cells", "graph_coverage_cells", "revisions_cells", "cut_cells", "lsh_bucket_cells",
    "influence_cells", "combine_cells", "score", "greedy_select", "lazy_greedy_select", "greedi_select",
    "choose_objective", "summarize", "CellsObjective", "get_session",
]
