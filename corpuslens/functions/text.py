"""Column expressions for turning text into terms (JVM-side, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop-word list of Lucene's standard and English
# analysers (public Lucene API, StopAnalyzer.ENGLISH_STOP_WORDS_SET).
ENGLISH_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in",
    "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will",
    "with",
)

# Fixed value: a token is a maximal run of Unicode letters and digits.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
# Fixed value: an English possessive ending ('s or ’s before a non-word character).
POSSESSIVE_PATTERN = r"['’]s([^\p{L}\p{N}]|$)"


def tokens(text: Column, possessive: Column | None = None) -> Column:
    """``ARRAY<STRING>`` of lower-cased tokens of ``text``; where
    ``possessive`` is true, possessive endings are removed first."""
    low = F.lower(text)
    if possessive is not None:
        low = F.when(possessive, F.regexp_replace(low, POSSESSIVE_PATTERN, "$1")).otherwise(low)
    return F.regexp_extract_all(low, F.lit(TOKEN_PATTERN), 0)


def is_stop_word(term: Column, lang: Column | None = None, stop_lang: str = "en") -> Column:
    """True for a stop word of ``stop_lang``; other languages keep every term."""
    hit = term.isin(*ENGLISH_STOP_WORDS)
    if lang is None:
        return hit
    return (lang == F.lit(stop_lang)) & hit
