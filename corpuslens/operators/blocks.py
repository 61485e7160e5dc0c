"""Dot products between blocks of vectors.

A block is one row: the vectors of up to ``BLOCK_DOCS`` documents (``BLOCK_ROWS``
postings, or one longer document), packed term by term.  A pair of blocks is one
row of a join, so Spark deals the pairs out over the tasks; a numpy kernel forms
the dot products of all their documents in memory, and only what the caller keeps
of them (a best neighbour, a sum, a row per pair) leaves the task.  Partial dot
products are never shuffled: what is moved or staged follows the postings, and a
task holds two blocks and one matrix of ``BLOCK_DOCS`` squared, whatever the input.

Every block meets every other (every partition with every other, no shuffle).  Each
document is in one block, once, with the groups it belongs to (its LSH buckets); where
only documents of one group count, the kernel leaves the products of others out.
Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BLOCK_DOCS, BLOCK_ROWS = 2048, 1 << 18       # documents are numbered in 16 bits
FLUSH_ROWS = 1 << 22      # postings that a task gathers before it packs them
MATCHES = 1 << 21         # products formed at once
DENSE_CELLS = 1 << 22     # of a block as a dense matrix
PACKED = {"docs": np.int64, "periods": np.int32, "terms": np.int64, "starts": np.int32, "places": np.int16, "weights": np.float64,
          "groups": np.int64, "members": np.int16}
SCHEMA = "no long, " + ", ".join(f"{c} binary" for c in PACKED)


def pack(postings: DataFrame, docs: DataFrame, key: Column | None = None) -> DataFrame:
    """``postings(doc_id, term, weight)`` and ``docs(doc_id, period, groups ARRAY<BIGINT>)`` -> one
    row per block, staged (both sides of a join must see the same blocks).
    ``key``: the 64-bit key of a term."""
    key = F.xxhash64("term") if key is None else key
    block_docs, block_rows, flush_rows = BLOCK_DOCS, BLOCK_ROWS, FLUSH_ROWS

    def blocks(doc, period, term, weight, member, group):
        order = np.argsort(term, kind="stable")
        doc, period, term, weight = (x[order] for x in (doc, period, term, weight))
        ids, at, place = np.unique(doc, return_index=True, return_inverse=True)
        order = np.lexsort((member, group))
        member, group = np.searchsorted(ids, member[order]), group[order]
        fresh = np.append(True, (member[1:] != member[:-1]) | (group[1:] != group[:-1]))[:len(group)]
        member, group = member[fresh], group[fresh]
        sizes, lo = np.cumsum(np.bincount(place, minlength=len(ids))), 0
        while lo < len(ids):                                       # whole documents only
            done = sizes[lo - 1] if lo else 0
            hi = min(max(int(np.searchsorted(sizes, done + block_rows, side="right")), lo + 1), lo + block_docs)
            mine, of = (place >= lo) & (place < hi), (member >= lo) & (member < hi)
            t = term[mine]
            starts = np.append(np.flatnonzero(np.append(True, t[1:] != t[:-1])), len(t))
            yield (ids[lo:hi], period[at[lo:hi]].astype(np.int32), t[starts[:-1]], starts.astype(np.int32),
                   (place[mine] - lo).astype(np.int16), weight[mine], group[of], (member[of] - lo).astype(np.int16))
            lo = hi

    def packed(parts, no):
        for k, b in enumerate(blocks(*[np.concatenate([p[i] for p in parts]) for i in range(6)]), no):
            cols = [pa.array([k], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in b]]
            yield pa.RecordBatch.from_arrays(cols, names=["no", *PACKED])

    def run(batches):
        parts, gathered, no = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            doc, period = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for lo in range(0, batch.num_rows, 256):
                g, t, w = (batch.column(i).slice(lo, 256) for i in range(2, 5))
                n_groups, n_terms = (np.diff(c.offsets.to_numpy()) for c in (g, t))
                here = slice(lo, lo + 256)
                parts.append([np.repeat(doc[here], n_terms), np.repeat(period[here], n_terms), t.flatten().to_numpy(zero_copy_only=False),
                              w.flatten().to_numpy(zero_copy_only=False), np.repeat(doc[here], n_groups), g.flatten().to_numpy(zero_copy_only=False)])
                gathered += int(n_terms.sum())
                if gathered >= flush_rows:
                    for out in packed(parts, no):
                        no += 1
                        yield out
                    parts, gathered = [], 0
        if gathered:
            yield from packed(parts, no)

    vectors = postings.groupBy("doc_id").agg(F.collect_list(F.struct(key.alias("t"), F.col("weight").cast("double").alias("w"))).alias("v"))
    rows = vectors.join(docs, "doc_id").select(F.col("doc_id").cast("bigint"), F.col("period").cast("int"), "groups",
                                               F.col("v.t").alias("terms"), F.col("v.w").alias("weights"))
    return materialize(rows.mapInArrow(run, SCHEMA), "table")


def pairs(blocks: DataFrame) -> DataFrame:
    """Every unordered pair of blocks once, a block with itself too: columns ``a_*`` and ``b_*``."""
    a, b = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in "ab")
    return a.hint("shuffle_replicate_nl").join(b, F.col("a_no") <= F.col("b_no"))


def unpacked(batch, row: int, side: str) -> dict:
    return {c: np.frombuffer(batch.column(f"{side}_{c}")[row].as_buffer(), dtype=kind) for c, kind in PACKED.items()}


def mates(a: dict, b: dict) -> np.ndarray:
    """Which documents of two blocks have a group in common."""
    out = np.zeros((len(a["docs"]), len(b["docs"])), bool)
    (ga, sa), (gb, sb) = (np.unique(s["groups"], return_index=True) for s in (a, b))
    ma, mb = (np.split(s["members"], starts[1:]) for s, starts in ((a, sa), (b, sb)))
    for i, j in zip(*np.intersect1d(ga, gb, assume_unique=True, return_indices=True)[1:]):
        out[np.ix_(ma[i], mb[j])] = True
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


def _meetings(a: dict, b: dict, pa_: np.ndarray, start: np.ndarray, length: np.ndarray, matches: int):
    """``(cells, postings of a, postings of b)`` of the meetings at common terms, about ``matches`` at once."""
    ends, lo, m = np.cumsum(length), 0, len(b["docs"])
    while lo < len(pa_):
        done = ends[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(ends, done + matches, side="right")), lo + 1)
        k = length[lo:hi]
        pb = _ranges(start[lo:hi], k)
        p = np.repeat(pa_[lo:hi], k)
        yield np.repeat(a["places"][pa_[lo:hi]].astype(np.int64) * m, k) + b["places"][pb], p, pb
        lo = hi


def met_dots(a: dict, b: dict, among: np.ndarray, matches: int = MATCHES) -> tuple[np.ndarray, np.ndarray]:
    """``(cells, dot products)`` of the pairs of documents ``among`` that have a common term, by cell."""
    at = np.searchsorted(b["terms"], a["terms"])
    at[at == len(b["terms"])] = 0
    common = np.flatnonzero(b["terms"][at] == a["terms"])
    at = at[common]
    here, there = (np.diff(s["starts"])[k].astype(np.int64) for s, k in ((a, common), (b, at)))
    among, cells, values = among.ravel(), np.zeros(0, np.int64), np.zeros(0)
    for cell, p, q in _meetings(a, b, _ranges(a["starts"][common], here), np.repeat(b["starts"][at], here), np.repeat(there, here), matches):
        k = np.flatnonzero(among[cell])
        cells, values = np.append(cells, cell[k]), np.append(values, a["weights"][p[k]] * b["weights"][q[k]])
        if len(cells):                                             # sums so far: no more than there are cells
            order = np.argsort(cells)
            cells = cells[order]
            first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
            cells, values = cells[first], np.add.reduceat(values[order], first)
    return cells, values


def _ranks(a: dict, b: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places of the documents of two blocks in their common (period, id) order; equal ones share a place."""
    period, doc = (np.concatenate([a[c], b[c]]) for c in ("periods", "docs"))
    order = np.lexsort((doc, period))
    period, doc = period[order], doc[order]
    rank = np.empty(len(order), np.int32)
    rank[order] = np.cumsum(np.append(0, (period[1:] != period[:-1]) | (doc[1:] != doc[:-1])))
    return rank[:len(a["docs"])], rank[len(a["docs"]):]


def dots(a: dict, b: dict, counted: bool = False, only: np.ndarray | None = None, matches: int = MATCHES):
    """Matrix of the dot products of two blocks (and, with ``counted``, of their common terms);
    ``only``: which terms of ``a`` count."""
    n, m = len(a["docs"]), len(b["docs"])
    out, met = np.zeros(n * m), np.zeros(n * m, dtype=np.int64) if counted else None
    at = np.searchsorted(b["terms"], a["terms"])
    at[at == len(b["terms"])] = 0
    common = np.flatnonzero((b["terms"][at] == a["terms"]) & (True if only is None else only))
    at = at[common]
    here, there = (np.diff(s["starts"])[k].astype(np.int64) for s, k in ((a, common), (b, at)))

    pa_, c = _ranges(a["starts"][common], here), len(common)
    if c and c * (n + m) <= DENSE_CELLS and (here * there).sum() * 16 > n * m * c:
        # most documents hold most common terms: a matrix product
        pb, col = _ranges(b["starts"][at], there), np.arange(c)
        x, y = (s["places"][p].astype(np.int64) * c + np.repeat(col, k) for s, p, k in ((a, pa_, here), (b, pb, there)))
        out = np.bincount(x, a["weights"][pa_], minlength=n * c).reshape(n, c) @ np.bincount(y, b["weights"][pb], minlength=m * c).reshape(m, c).T
        if counted:
            met = np.bincount(x, minlength=n * c).reshape(n, c).astype(float) @ np.bincount(y, minlength=m * c).reshape(m, c).T.astype(float)
        return (out, met) if counted else out
    for k, (cell, p, q) in enumerate(_meetings(a, b, pa_, np.repeat(b["starts"][at], here), np.repeat(there, here), matches)):
        part = np.bincount(cell, a["weights"][p] * b["weights"][q], minlength=n * m)
        out = out + part if k else part
        if counted:
            met += np.bincount(cell, minlength=n * m)
    return (out.reshape(n, m), met.reshape(n, m)) if counted else out.reshape(n, m)


def over_pairs(joined: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """``kernel(batch, row) -> columns`` on every joined row."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                cols = kernel(batch, row)
                for i in range(0, len(cols[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i:i + (1 << 16)]) for c in cols], names=names)
    return joined.mapInArrow(run, schema)


class Best:
    """Of each document of a block the best neighbour so far."""

    def __init__(self, docs: np.ndarray):
        self.docs, n = docs.copy(), len(docs)
        self.key, self.ids, self.dot = np.zeros(n), np.full(n, np.iinfo(np.int64).max), np.zeros(n)

    def offer(self, row: np.ndarray, key: np.ndarray, ids: np.ndarray, dot: np.ndarray) -> None:
        """Neighbours ``ids`` for the documents at ``row``: the highest ``key``, then the lowest id stays."""
        fit = np.flatnonzero((key > self.key[row]) | (key == self.key[row]) & (ids < self.ids[row]))
        fit = fit[np.lexsort((ids[fit], -key[fit], row[fit]))]
        fit = fit[np.append(True, row[fit][1:] != row[fit][:-1])[:len(fit)]]
        at = row[fit]
        self.key[at], self.ids[at], self.dot[at] = key[fit], ids[fit], dot[fit]


def best_earlier(joined: DataFrame, digits: int, schema: str, grouped: bool = True) -> DataFrame:
    """Per document and task its best earlier one among its mates (all documents, unless ``grouped``),
    ``(doc_id, neighbor_id, dot)``: the highest dot product above 0 rounded to ``digits``, then the
    lowest id.  A task keeps one neighbour for each document of its blocks, so what it returns does
    not follow its pairs."""
    scale, names = 10.0 ** digits, [f.split()[0] for f in schema.split(",")]

    def offer(best, d, ids):
        """To the documents of the rows; a block's ids ascend.  Few rows of ``d`` reach what is known already."""
        top = np.floor(d.max(axis=1) * scale + 0.5)
        row = np.flatnonzero((top > 0) & (top >= best.key))
        col = (np.floor(d[row] * scale + 0.5) >= top[row, None]).argmax(axis=1)     # the lowest of equal ones
        best.offer(row, top[row], ids[col], d[row, col])

    def meet_all(a, b, best_a, best_b):
        d, (rank_a, rank_b) = dots(a, b), _ranks(a, b)
        if np.isnan(d.max()):
            d = np.nan_to_num(d)
        earlier = rank_b[None, :] < rank_a[:, None]
        offer(best_a, np.where(earlier, d, 0.0), b["docs"])
        if best_a is not best_b:
            d[earlier | (rank_b[None, :] == rank_a[:, None])] = 0.0
            offer(best_b, d.T, a["docs"])

    def meet(a, b, best_a, best_b):
        cell, d = met_dots(a, b, mates(a, b))
        x, y = np.divmod(cell, len(b["docs"]))
        key, da, db, pa_, pb = np.floor(d * scale + 0.5), a["docs"][x], b["docs"][y], a["periods"][x], b["periods"][y]
        earlier = (pb < pa_) | (pb == pa_) & (db < da)
        k = np.flatnonzero(earlier & (key > 0))
        best_a.offer(x[k], key[k], db[k], d[k])
        if best_a is not best_b:                                   # a block with itself has both cells of a pair
            k = np.flatnonzero(~earlier & (db != da) & (key > 0))
            best_b.offer(y[k], key[k], da[k], d[k])

    def run(batches):
        found: dict[int, Best] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = unpacked(batch, row, "a"), unpacked(batch, row, "b")
                of = [found.setdefault(batch.column(f"{c}_no")[row].as_py(), Best(s["docs"])) for c, s in (("a", a), ("b", b))]
                (meet if grouped else meet_all)(a, b, *of)
        for best in found.values():
            k = np.flatnonzero(best.key > 0)
            yield pa.RecordBatch.from_arrays([pa.array(c[k]) for c in (best.docs, best.ids, best.dot)], names=names)
    return joined.mapInArrow(run, schema)


def once(a: dict, b: dict, batch, row: int):
    """Which cells of a pair of blocks are the pairs of documents to be met."""
    if batch.column("a_no")[row].as_py() != batch.column("b_no")[row].as_py():
        return True
    return a["docs"][:, None] < b["docs"][None, :]


def all_pairs(batch, row):
    """Kernel: ``(doc_a, doc_b, dot)`` of every pair of documents with a common term, ``doc_a < doc_b``."""
    a, b = unpacked(batch, row, "a"), unpacked(batch, row, "b")
    d, met = dots(a, b, counted=True)
    i, j = np.nonzero((met > 0) & once(a, b, batch, row))
    x, y = a["docs"][i], b["docs"][j]
    return [np.minimum(x, y), np.maximum(x, y), d[i, j]]


def side_key(reference: Column) -> Column:
    """64-bit keys of terms on two sides: even for the reference, odd for ours."""
    return F.xxhash64("term").bitwiseAND(F.lit(-2)).bitwiseOR(F.when(reference, 0).otherwise(1))


def cell_errors(batch, row):
    """Kernel: ``(doc_a, doc_b, error)`` for every pair whose reference vectors share a term and
    whose reference value is a number; keys as :func:`side_key` makes them."""
    a, b = unpacked(batch, row, "a"), unpacked(batch, row, "b")
    ours = dots(a, b, only=a["terms"] & 1 == 1)
    value, met = dots(a, b, counted=True, only=a["terms"] & 1 == 0)
    i, j = np.nonzero((met > 0) & ~np.isnan(value) & once(a, b, batch, row))
    x, y = a["docs"][i], b["docs"][j]
    return [np.minimum(x, y), np.maximum(x, y), np.abs((1.0 - ours[i, j]) - (1.0 - value[i, j]))]
