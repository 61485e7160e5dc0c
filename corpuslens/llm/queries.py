"""Registered queries of this subpackage: ``opN_<name>`` and ``pipeline``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (decontaminate, html_text, language, lexical_packing, near_dedup, packing, periodic_runs, personal_data, ranked_search, sharding,
               token_counts, toxicity, weighted_sampling)
from .common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op8_minhash_near_dedup")
def op8(spark, sf_dir):
    return near_dedup.near_groups(read_table(spark, sf_dir, "documents"), size=2)


@register("op7_benchmark_decontamination")
def op7(spark, sf_dir):
    docs, items = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontaminate.digest(decontaminate.benchmark_matches(docs, items))


@register("op6_token_counts")
def op6(spark, sf_dir):
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


@register("op5_best_fit_packing")
def op5(spark, sf_dir):
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


@register("op9_language_id")
def op9(spark, sf_dir):
    return language.languages(read_table(spark, sf_dir, "documents"))


@register("op10_toxicity")
def op10(spark, sf_dir):
    return toxicity.toxicity(*(read_table(spark, sf_dir, t) for t in ("documents", "labels")))


@register("op2_personal_data")
def op2(spark, sf_dir):
    return personal_data.digest(personal_data.find(read_table(spark, sf_dir, "documents")))


@register("op3_weighted_sampling")
def op3(spark, sf_dir):
    return weighted_sampling.fingerprints(read_table(spark, sf_dir, "documents"))


@register("op4_sharding", sharding.oracle())
def op4(spark, sf_dir):
    return sharding.assign(read_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", sharding.shard_names())


@register("op1_html_extraction")
def op1(spark, sf_dir):
    return html_text.extract(read_table(spark, sf_dir, "pages"))


@register("op11_ranked_search", ranked_search.SQL)
def op11(spark, sf_dir):
    return ranked_search.ranked(*(read_table(spark, sf_dir, t) for t in ("documents", "benchmark")))


@register("op12_lexical_packing")
def op12(spark, sf_dir):
    return lexical_packing.pack_neighbours(read_table(spark, sf_dir, "documents"))


@register("op13_periodic_runs")
def op13(spark, sf_dir):
    return periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.repeat_tails(read_table(spark, sf_dir, "documents"))))
