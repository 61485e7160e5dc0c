"""Operator 6: token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a slice of texts come from ``pretokens``; each distinct one
is merged once and its count kept for the task.  New ones are merged together:
their byte symbols lie in one flat array with row numbers, and in every round
each row applies its own lowest-rank pair at all its places at once.  That
equals merging one place at a time, since in a trained vocabulary a pair that
holds a merged symbol ranks behind the merge that made it.  Rows without a
known pair leave; what is left in a row is its count.

Texts never leave their partition and nothing is collected, so skew does not
matter; memory is a slice, the cache and the longest single text.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
each get their own; an empty table gives an empty table; only ``doc_id`` and
``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches
from .pretokens import Known, PreTokens, code_classes, text_lists, tokenizer_file

VOCABULARY = "byte_bpe_50k.json"
OVER = 512
NO_RANK = np.iinfo(np.int64).max


def byte_symbols() -> dict[str, int]:
    """Printable character -> byte, by the format's rule: printable Latin-1 bytes
    stand for themselves, the others follow from U+0100 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class RankMerger:
    """Merge table of a byte-level BPE file as sorted arrays."""

    def __init__(self, tokenizer_json: str):
        model = json.loads(tokenizer_json)["model"]
        vocab = model["vocab"]
        self.byte_id = np.zeros(256, np.int64)
        for c, b in byte_symbols().items():
            self.byte_id[b] = vocab[c]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank

    def ranks(self, key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NO_RANK)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words after all merges, in word order, and how many each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.int64)
        left: list[tuple[np.ndarray, np.ndarray]] = []
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        row = np.repeat(np.arange(len(words)), size)
        while len(sym):
            last = np.append(row[1:] != row[:-1], True)
            rank = np.full(len(sym), NO_RANK)
            inner = np.flatnonzero(~last)
            rank[inner] = self.ranks(sym[inner] << 20 | sym[inner + 1])
            begin = np.flatnonzero(np.append(True, last[:-1]))
            best = np.minimum.reduceat(rank, begin)
            n = np.diff(np.append(begin, len(sym)))
            done = best == NO_RANK
            out[row[begin[done]]] = n[done]
            least = np.repeat(best, n)
            left.append((row[least == NO_RANK], sym[least == NO_RANK]))
            at = np.flatnonzero((rank == least) & (least != NO_RANK))
            # overlapping places (one symbol repeated) go pairwise from the left
            fresh = np.append(True, at[1:] != at[:-1] + 1) if len(at) else np.zeros(0, bool)
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0)) if len(at) else at
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = least != NO_RANK
            keep[at + 1] = False
            sym, row = sym[keep], row[keep]
        if not left:
            return np.zeros(0, np.int64), out
        row, sym = (np.concatenate(x) for x in zip(*left))
        return sym[np.argsort(row, kind="stable")], out


class TokenCounter:
    """Counts of whole texts, with a cache of pre-token counts."""

    def __init__(self, tokenizer_json: str, classes: tuple[np.ndarray, np.ndarray]):
        self.merger, self.splitter = RankMerger(tokenizer_json), PreTokens(tokenizer_json, classes)
        self.known = Known(self._fresh, self._forget)

    def _forget(self) -> None:
        self.count = np.zeros(0, np.int64)

    def _fresh(self, texts: list[str]) -> None:
        self.count = np.append(self.count, self.merger.merge([t.encode("utf-8", "replace") for t in texts])[1])

    def count_texts(self, texts: list[str]) -> np.ndarray:
        pieces = self.splitter.split(texts)
        slots = self.known.slots(pieces)
        out = np.bincount(pieces.row, weights=self.count[slots], minlength=len(texts)).astype(np.int64)
        for i, parts in pieces.extra.items():
            at = [self.known.one(p) for p in parts if isinstance(p, str)]
            out[i] = int(self.count[at].sum()) + sum(not isinstance(p, str) for p in parts)
        return out


def _count(shared):
    def run(batches):
        counter = TokenCounter(shared.value, code_classes())
        for batch in batches:
            n = [counter.count_texts(texts) for _, texts in text_lists(batch["text"])]
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(n, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])
    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, over: int = OVER) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of ``docs(doc_id, text)``; ``vocabulary``
    is a path of a byte-level BPE ``.json`` file or the name of a public one."""
    spark = docs.sparkSession
    arrow_batches(spark)
    with open(tokenizer_file(vocabulary), encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # the vocabulary file: a few MB, whatever the input
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes")).mapInArrow(
        _count(shared), f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > over)
