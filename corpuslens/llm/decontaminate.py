"""Operator 7: benchmark passages in training texts, by suffix arrays.

Each slice of the training table (a *shard*: some megabytes of whole texts in
a task) gets a suffix array over its words: the positions in lexicographic
order of the words that follow, compared to the window's depth.  Every test
suffix is binary-searched in it; the range found gives all places of its
window, and runs of hits on one diagonal (same item, same shift) are joined
to the longest verbatim matches.  A match is as long as its window at least,
so positions whose first two words never follow each other in a test item
are left out of the sort; no match can begin there.

The test items reach the tasks in blocks of bounded size; a second block
reads the texts again and adds to the first one's matches.  Texts are never
shuffled: each row's result depends on that row and the items only, so hot
sources, shared passages and lost executors need no extra care.

Defined results: a null or empty text has no words and no matches; an item
without words or without an id matches nothing; items that repeat an id count
once; repeated rows each get their own result; empty tables give no rows or
no matches.  Only named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches
from .words import SpanHasher, Words, text_slices, word_bytes

WINDOW = 10                # words of a window
BLOCK_BYTES = 16 << 20     # test text sent to the tasks at a time
FILTER_BITS = 20
MATCH = "array<struct<item_id:string,start:bigint,words:bigint,item_start:bigint>>"


class TestSuffixes:
    """All test suffixes of a block of items, cut at the window's length."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window = window
        w = SpanHasher()
        column = pa.array([t for _, t in items], pa.large_string())
        hashes = [(r, x) for i, _, data, offs in text_slices(column)
                  for r, x in enumerate_rows(Words(data, offs, word_bytes(), w), i)]
        self.vocabulary = np.unique(np.concatenate([x for _, x in hashes])) if hashes else np.zeros(0, np.uint64)
        bits = max(1, int(len(self.vocabulary)).bit_length())
        self.per_key = max(1, 63 // bits)
        self.bits = bits
        low, high, length, item, at = [], [], [], [], []
        lead = set()
        top = (1 << bits) - 1
        for r, x in hashes:
            ids = (np.searchsorted(self.vocabulary, x) + 1).tolist()
            size = min(window, len(ids))
            for s in range(len(ids) - size + 1):
                part = ids[s:s + size]
                low.append(part + [0] * (window - size))
                high.append(part + [top] * (window - size))
                length.append(size)
                item.append(r)
                at.append(s)
                lead.add((part[0], part[1]) if size > 1 else (part[0], -1))
        self.low, self.high = (self.keys(np.array(x, np.uint64).reshape(-1, window)) for x in (low, high))
        self.length, self.item, self.at = (np.array(x, np.int64) for x in (length, item, at))
        self.ids = [i for i, _ in items]
        base = len(self.vocabulary) + 1
        self.pairs = np.unique(np.array([a * base + b for a, b in lead if b >= 0], np.int64))
        self.single = np.unique(np.array([a for a, b in lead if b < 0], np.int64))
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(self.vocabulary >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    @classmethod
    def of(cls, state: dict) -> "TestSuffixes":
        """From a broadcast ``vars()`` (plain arrays, so workers need no module)."""
        self = cls.__new__(cls)
        self.__dict__.update(state)
        return self

    def keys(self, ids: np.ndarray) -> np.ndarray:
        """Rows of word ids as byte strings that compare as the id sequences do."""
        cols = []
        for k in range(0, self.window, self.per_key):
            v = np.zeros(len(ids), np.uint64)
            for j in range(k, k + self.per_key):
                v = (v << np.uint64(self.bits)) | (ids[:, j] if j < self.window else np.uint64(0))
            cols.append(v)
        return np.stack(cols, axis=1).astype(">u8").view(f"S{8 * len(cols)}").ravel()

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 1, 0)
        return out

    def matches(self, words: Words) -> list[np.ndarray]:
        """Longest verbatim matches in a shard: arrays (word start, words, item, item start)."""
        empty = [np.zeros(0, np.int64)] * 4
        if not len(words.hash) or not len(self.length):
            return empty
        ids = self.word_ids(words.hash)
        row_end = np.repeat(words.first[1:], np.diff(words.first))
        known = np.flatnonzero(ids)
        follow = np.where(known + 1 < row_end[known], ids[np.minimum(known + 1, len(ids) - 1)], 0)
        begins = member(self.pairs, ids[known] * (len(self.vocabulary) + 1) + follow) & (follow > 0)
        begins |= member(self.single, ids[known])
        at = known[begins]
        if not len(at):
            return empty
        k = at[:, None] + np.arange(self.window)
        suffix = np.where(k < row_end[at][:, None], ids[np.minimum(k, len(ids) - 1)], 0).astype(np.uint64)
        keys = self.keys(suffix)
        order = np.argsort(keys, kind="stable")
        array, keys = at[order], keys[order]                      # the shard's suffix array
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        n = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(n)), n)
        if not len(which):
            return empty
        place = array[lo[which] + (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n))]
        item, start, size = self.item[which], self.at[which], self.length[which]
        row = np.searchsorted(words.first, place, "right")
        order = np.lexsort((start, place - start, row, item))
        item, start, size, place, row = (x[order] for x in (item, start, size, place, row))
        fresh = np.ones(len(item), bool)
        fresh[1:] = ((item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
                     | (place[1:] != place[:-1] + 1))
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(item)) - 1
        return [place[first], place[last] + size[last] - place[first], item[first], start[first]]


def enumerate_rows(words: Words, base: int):
    for r in range(len(words.first) - 1):
        if words.first[r] < words.first[r + 1]:
            yield base + r, words.hash[words.first[r]:words.first[r + 1]]


def member(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def item_blocks(items: DataFrame, block_bytes: int):
    """Lists of (id, text) of bounded size that cover all items with an id and a text."""
    items = items.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).dropna()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        yield [tuple(x) for x in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()]


def _scan(shared):
    def run(batches):
        test, reader, mask = TestSuffixes.of(shared.value), SpanHasher(), word_bytes()
        for batch in batches:
            n_words, n_hit, found = [], [], []
            before = batch["matches"].to_pylist()
            for i, j, data, offsets in text_slices(batch["text"]):
                words = Words(data, offsets, mask, reader)
                first = words.first
                place, size, item, start = test.matches(words)
                row = np.searchsorted(first, place, "right") - 1
                mine = [list(x) for x in before[i:j]]
                for r, p, s, k, o in zip(row.tolist(), (place - first[row]).tolist(), size.tolist(), item.tolist(), start.tolist()):
                    mine[r].append({"item_id": test.ids[k], "start": p, "words": s, "item_start": o})
                cover = np.zeros(len(words.start) + 1, np.int64)
                for r, x in enumerate(mine):
                    for m in x:
                        cover[first[r] + m["start"]] += 1
                        cover[first[r] + m["start"] + m["words"]] -= 1
                hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
                n_words += np.diff(first).tolist()
                n_hit += (hit[first[1:]] - hit[first[:-1]]).tolist()
                found += mine
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text"], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                 pa.array(found, batch["matches"].type)], ["doc_id", "text", "n_words", "n_hit", "matches"])
    return run


def benchmark_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_hit, matches)`` per row of ``docs(doc_id, text)``:
    its longest verbatim matches with ``items(item_id, text)`` and their places."""
    spark = docs.sparkSession
    arrow_batches(spark)
    out = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.expr(f"CAST(array() AS {MATCH})").alias("matches"))
    kind = dict(docs.dtypes)["doc_id"]
    for block in item_blocks(items, block_bytes):
        shared = spark.sparkContext.broadcast(vars(TestSuffixes(block, window)))
        out = out.select("doc_id", "text", "matches").mapInArrow(
            _scan(shared), f"doc_id {kind}, text string, n_words bigint, n_hit bigint, matches {MATCH}")
    return out.drop("text")


def digest(matches: DataFrame) -> DataFrame:
    """Per document: words, hit words, items found and whether any was."""
    ids = F.sort_array(F.array_distinct("matches.item_id"))
    return matches.select("doc_id", "n_words", "n_hit", F.size(ids).cast("bigint").alias("n_items"),
                          F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _clean(shared):
    def run(batches):
        test, reader, mask = TestSuffixes.of(shared.value), SpanHasher(), word_bytes()
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for i, _, data, offsets in text_slices(batch["text"]):
                words = Words(data, offsets, mask, reader)
                place = test.matches(words)[0]
                keep[i + np.searchsorted(words.first, place, "right") - 1] = False
            yield batch.filter(pa.array(keep))
    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without any window of any item; all columns stay."""
    spark = docs.sparkSession
    arrow_batches(spark)
    for block in item_blocks(items, block_bytes):
        docs = docs.mapInArrow(_clean(spark.sparkContext.broadcast(vars(TestSuffixes(block, window)))), docs.schema)
    return docs
