"""Operator 13: stretches of words that repeat with a period.

A run is a stretch of consecutive words with smallest period ``q`` and at least
``max(SHORTEST, 2 * q)`` words that no neighbouring word extends.  Each of its
words occurs in it twice at least, so a word that occurs once in a segment of a
text lies in no run there: such words split the segment, the parts are counted
again, and so on until no part changes; parts of fewer than ``SHORTEST`` words
go.  What survives is scanned by lag: a lag below ``DIRECT`` by comparing the
words with themselves moved by it, all segments of a slice at once.  For lags
from ``2 * s`` to ``4 * s`` only the pairs of places are looked at where the
same ``s`` words stand, one of them at a multiple of ``s``; a run of such a
period has one of these, and its ends follow by bisection over span hashes.
A place inside a run of shorter period is not followed through that run, so the
pairs of a scale are at most twice the words, also in a text of one word.

All of it is array work on slices of whole texts inside tasks; texts are not
shuffled, so a hot source or copies of a text need no care, and memory is a
slice or the longest single text.  Words are compared by 64-bit hashes.

Defined results: null, empty and blank texts have no words, no runs and an
empty collapsed text; repeated rows each get their own result; rows without id
are searched too; an empty table gives an empty table; only ``doc_id`` and
``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches
from .words import SpanHasher, not_space, random_words, text_slices

SHORTEST = 12              # words of a run, at least
DIRECT = 32                # lags below it are compared word by word
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
SPACES = r"[\x20\x09-\x0D]+"


def word_spans(data: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the words of a slice, and the first word of each row."""
    inside = mask[data]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] = inside[edges]
    stop[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(stop) + 1, np.searchsorted(start, offsets)


def surviving(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that may lie in runs, ascending, and the end (as an index
    of these places) of the segment that each lies in."""
    live = np.arange(len(word))
    seg = np.repeat(np.arange(len(first) - 1), np.diff(first))
    kept, top = [], int(word.max(initial=0)) + 1
    while len(live):
        cut = np.flatnonzero((np.diff(live) != 1) | (np.diff(seg) != 0)) + 1
        size = np.diff(np.concatenate([[0], cut, [len(live)]]))
        long = size >= SHORTEST
        live = live[np.repeat(long, size)]
        seg = np.repeat(np.arange(int(long.sum())), size[long])
        _, at, count = np.unique(seg * top + word[live], return_inverse=True, return_counts=True)
        rare = count[at] < 2
        splits = np.bincount(seg[rare], minlength=len(size)) > 0
        mine = ~splits[seg]
        kept.append((live[mine], seg[mine] + (len(kept) << 40)))  # segments of different rounds differ
        go = splits[seg] & ~rare
        live, seg = live[go], seg[go]
    if not kept:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    live = np.concatenate([k[0] for k in kept])
    part = np.concatenate([k[1] for k in kept])
    order = np.argsort(live, kind="stable")
    live, part = live[order], part[order]
    last = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1 if len(live) else np.zeros(0, np.int64)
    return live, np.repeat(last, np.diff(np.concatenate([[0], last])))


class Scan:
    """Runs of the surviving segments of a slice; places are indexes of ``word``."""

    def __init__(self, word: np.ndarray, end: np.ndarray, hasher: SpanHasher):
        self.word, self.end, self.hasher = word, end, hasher
        self.begin = np.zeros(len(end), np.int64)
        if len(end):
            new = np.append(True, end[1:] != end[:-1])
            self.begin = np.maximum.accumulate(np.where(new, np.arange(len(end)), 0))
        hasher.table = random_words(int(word.max(initial=0)) + 1, 7)
        self.sums = hasher.sums(word)
        self.start, self.stop, self.period = (np.zeros(0, np.int64) for _ in range(3))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        longest = int((self.end - self.begin).max(initial=0))
        for q in range(1, min(DIRECT, longest // 2 + 1)):
            self._add(*self._short(q), q)
        s = DIRECT // 2
        while 4 * s <= longest:
            a, b = self._pairs(s)
            left, right = self._reach(a, b)
            self._add(a - left, b + right, b - a)
            s *= 2
        return self.start, self.stop, self.period

    def _add(self, start, stop, period) -> None:
        """Keeps what is long enough; of equal stretches the one with the smallest period."""
        period = np.broadcast_to(period, start.shape)
        ok = stop - start >= np.maximum(SHORTEST, 2 * period)
        new = (np.concatenate(x) for x in ((self.start, start[ok]), (self.stop, stop[ok]), (self.period, period[ok])))
        start, stop, period = new
        order = np.lexsort((period, stop, start))
        start, stop, period = start[order], stop[order], period[order]
        fresh = np.append(True, (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])) if len(start) else np.zeros(0, bool)
        self.start, self.stop, self.period = start[fresh], stop[fresh], period[fresh]

    def _short(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        same = np.zeros(len(self.word) + 2 - min(q, len(self.word)), np.int8)
        same[1:-1] = (self.word[q:] == self.word[:-q]) & (self.end[q:] == self.end[:-q])
        edge = np.flatnonzero(np.diff(same))
        return edge[::2], edge[1::2] + q

    def _pairs(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Places a < b, a at a multiple of ``s``, with the same ``s`` words and 2 s <= b - a < 4 s."""
        n = len(self.word)
        at = np.flatnonzero((self.end - self.begin >= 4 * s))
        at = at[at + s <= self.end[at]]
        _, gram = np.unique(self.hasher.spans(self.sums, at, at + s), return_inverse=True)
        key = gram * n + at
        anchor = np.flatnonzero(at % s == 0)
        a, key = at[anchor], np.sort(key)
        lo = a + 2 * s
        known = np.flatnonzero(self.period <= s)                      # runs that an anchor may lie in, by their start
        if len(known):
            reach = np.maximum.accumulate(self.stop[known])
            k = np.searchsorted(self.start[known], a, "right") - 1
            far = np.where(k >= 0, reach[np.maximum(k, 0)], 0)
            lo = np.where(far >= a + s, np.maximum(lo, far - s + 1), lo)
        hi = np.minimum(a + 4 * s, self.end[a])
        base = gram[anchor] * n
        lo = np.searchsorted(key, base + np.minimum(lo, hi), "left")
        count = np.searchsorted(key, base + hi, "left") - lo
        a = np.repeat(a, count)
        b = key[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(len(a))] % n
        return a, b

    def _reach(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words before and from ``a`` and ``b`` on are the same."""
        span = lambda x, y: self.hasher.spans(self.sums, x, y)
        right = bisect(self.end[b] - b, lambda m: span(a, a + m) == span(b, b + m))
        left = bisect(a - self.begin[a], lambda m: span(a - m, a) == span(b - m, b))
        return left, right


def bisect(most: np.ndarray, holds) -> np.ndarray:
    """Largest number up to ``most`` for which ``holds`` (true up to some number) is true."""
    lo, hi = np.zeros(len(most), np.int64), most.copy()
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        ok = holds(mid)
        lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
    return lo


def slice_runs(data: np.ndarray, offsets: np.ndarray, mask: np.ndarray, words: SpanHasher, places: SpanHasher):
    """Word counts, runs (row, start, length, period; by row, start and period) and the
    collapsed texts (bytes and their offsets) of a slice of whole texts."""
    start, end, first = word_spans(data, offsets, mask)
    _, word = np.unique(words.hash(data, start, end), return_inverse=True)
    live, seg_end = surviving(word, first)
    lo, hi, period = Scan(word[live], seg_end, places).runs()
    size, lo = hi - lo, live[lo]
    row = np.searchsorted(first, lo, "right") - 1
    order = np.lexsort((period, lo))
    lo, size, period, row = lo[order], size[order], period[order], row[order]
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, lo + period, 1)
    np.add.at(cover, lo + size, -1)
    keep = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
    # kept words of each row, joined by one space: each word brings the space before it, the first of a row none
    n = end[keep] - start[keep]
    of = np.searchsorted(first, keep, "right") - 1
    lead = np.append(False, of[1:] == of[:-1]) if len(of) else np.zeros(0, bool)
    take = n + lead
    out_end = np.cumsum(take)
    at = np.arange(int(out_end[-1]) if len(out_end) else 0) - np.repeat(out_end - n, take) + np.repeat(start[keep], take)
    out = data[np.maximum(at, 0)] if len(data) else np.zeros(0, np.uint8)
    out[(out_end - take)[lead]] = 32
    bounds = np.concatenate([[0], out_end])[np.searchsorted(of, np.arange(len(offsets)), "left")] if len(of) else np.zeros(len(offsets), np.int64)
    return np.diff(first), (row, lo - first[row], size, period), out, bounds


def _runs(batches):
    mask, words, places = not_space(), SpanHasher(), SpanHasher(1)
    for batch in batches:
        for i, j, data, offsets in text_slices(batch["text"]):
            n, (row, start, size, period), out, bounds = slice_runs(data, offsets, mask, words, places)
            runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, size, period)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(j - i + 1)), pa.int32()), runs)
            text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].slice(i, j - i), pa.array(n, pa.int64()), runs, text.cast(pa.large_string()).cast(batch["text"].type)],
                ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` of ``docs(doc_id, text)``: all runs by start and
    period, and the words joined by one space without those that a run repeats."""
    arrow_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _runs, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words bigint, runs {RUNS}, collapsed string")


def repeat_tails(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` where a tenth of the documents, chosen by the checksum of the
    id, goes on repeating the words from one place on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.col("text"), SPACES), lambda w: w != "")
    g = F.floor(h / 10)
    return (docs.select("doc_id", F.col("text").cast("string").alias("text"))
            .withColumn("words", F.when(h % 10 == 0, words))
            .withColumn("n", F.size("words"))
            .withColumn("a", F.when(F.col("n") > 0, g % F.col("n")).cast("int"))
            .withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
            .select("doc_id", F.when(F.col("n") > 0, F.expr(
                "array_join(transform(words, (w, i) -> IF(i < a, w, words[a + (i - a) % p])), ' ')"))
                .otherwise(F.col("text")).alias("text")))


def digest(found: DataFrame) -> DataFrame:
    """Per document: its number of runs, the longest one, and checksums of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("bigint").alias("n_runs"),
                    (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
                    F.floor(F.expr("best.length * 1000 div -best.period")).cast("bigint").alias("exponent_milli"),
                    F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256")))
