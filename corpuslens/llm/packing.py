"""Operator 5: packing documents into sequences by bin completion.

Documents become token ids and are cut into pieces of at most ``capacity``.
How pieces combine depends on their lengths only, so the search runs on the
histogram of lengths (at most ``capacity`` numbers, whatever the corpus):
around the largest length left, undominated fillings are enumerated (no
member can be swapped for a larger free one, none can be added), the one with
the least waste first and only as far as the search asks for them; bitsets of
the sums that the free lengths can reach keep the enumeration free of dead
ends.  A filling is applied to as many sequences at once as the counts allow,
then to half as many, down to one.  A best-fit-decreasing solution is the
first incumbent; branches whose waste cannot beat the incumbent are pruned,
and the search ends at a lower bound (the larger of ceil(tokens / capacity) and
the bound that counts lengths which cannot share a sequence), when the tree is
exhausted, or after ``nodes`` fillings (20 000, a parameter): then the best solution so
far stands, and a filling that the budget cut short is never used.

Pieces then take their places: range-partitioned by (length, doc_id, piece),
a piece's rank among its length follows from its position in its partition
and the counts of the partitions before, and the rank says which copy of
which filling it belongs to.  The lookup tables have a row per partition and
length and per filling and length, so their size does not follow the corpus.
A length that a third of all rows share is split by the range partitioning.

Defined results: null and empty texts are one piece with only the closing id
0; repeated rows are packed each; rows without id are packed too; an empty
table gives an empty table; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, staged
from .pretokens import Known, PreTokens, code_classes, text_lists, tokenizer_file
from .token_counts import VOCABULARY, RankMerger

CAPACITY = 2048
END = 0                       # id that closes a document
NODES = 20_000                # fillings tried in the search
LIVE = 64                     # enumerations held open; deeper ones are begun anew when needed

Filling = tuple[int, ...]     # lengths, largest first


def reachable(sizes: list[int], free: list[int], room: int) -> list[int]:
    """Entry k: the sums up to ``room`` that the first k sizes can make, as bits."""
    mask, sums = (1 << room + 1) - 1, 1
    out = [sums]
    for s in sizes:
        left, n = min(free[s], room // s), 1
        while left:
            n = min(n, left)
            sums |= sums << s * n & mask
            left -= n
            n *= 2
        out.append(sums)
    return out


def exact(sums: list[int], sizes: list[int], free: list[int], target: int, k: int) -> Iterator[Filling]:
    """Every way to make ``target`` of the first ``k`` sizes, those of small members first
    (extremes kept for later leave fewer sequences that nothing fills)."""
    if not target:
        yield ()
        return
    k = min(k, bisect_right(sizes, target))
    if not sums[k] >> target & 1:
        return
    first = bisect_left(range(k + 1), True, key=lambda j: bool(sums[j] >> target & 1))
    for j in range(first - 1, k):
        s = sizes[j]
        for n in range(min(free[s], target // s), 0, -1):
            if sums[j] >> target - n * s & 1:
                for rest in exact(sums, sizes, free, target - n * s, j):
                    yield (s,) * n + rest


def fillings(room: int, sizes: list[int], free: list[int], most_waste: int) -> Iterator[Filling | None]:
    """Undominated ways to fill ``room`` from ``sizes`` (ascending, with ``free``
    counts by length) with at most ``most_waste`` places empty, least waste first;
    ``None`` stands for a dominated one, so that a budget can count it."""
    sizes = sizes[:bisect_right(sizes, room)]
    sums = reachable(sizes, free, room)
    ends = sums[-1]

    def dominated(members: Filling, waste: int) -> bool:
        return any(free[s] > members.count(s)
                   for m in {0, *members} for s in sizes[bisect_right(sizes, m):bisect_right(sizes, m + waste)])

    while ends:
        target = ends.bit_length() - 1
        if room - target > most_waste:
            return
        ends ^= 1 << target
        for members in exact(sums, sizes, free, target, len(sizes)):
            yield None if dominated(members, room - target) else members


def best_fit(counts: list[int], capacity: int) -> list[tuple[int, Filling]]:
    """Best-fit decreasing on the histogram: after the largest, always the
    largest that still fits; ``(copies, lengths)`` of each kind of sequence."""
    free, out = list(counts), []
    sizes = [s for s in range(1, capacity + 1) if free[s]]
    while sizes:
        members, rest, k = [sizes[-1]], capacity - sizes[-1], len(sizes) - 1
        while k >= 0:
            s = sizes[k]
            n = min(rest // s, free[s] - members.count(s))
            members += [s] * n
            rest -= s * n
            k = min(k, bisect_right(sizes, rest)) - 1
        out.append(_take(free, members))
        sizes = [s for s in sizes if free[s]]
    return out


def _take(free: list[int], members: list[int]) -> tuple[int, Filling]:
    copies = min(free[s] // members.count(s) for s in set(members))
    for s in members:
        free[s] -= copies
    return copies, tuple(members)


def least_sequences(counts: list[int], capacity: int) -> int:
    """A lower bound: for each ``small``, lengths over half share no sequence, and
    those from ``small`` to half only fill what lengths up to capacity - small leave."""
    n = np.array(counts, np.int64)
    number, tokens = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * np.arange(len(n))))
    half, best = capacity // 2, -(-int(tokens[-1]) // capacity)
    for small in range(1, half + 1):
        top = capacity - small
        paired = int(number[top + 1] - number[half + 1])
        room = paired * capacity - int(tokens[top + 1] - tokens[half + 1])
        over = int(tokens[half + 1] - tokens[small]) - room
        best = max(best, int(number[-1] - number[half + 1]) + max(0, -(-over // capacity)))
    return best


class Level:
    """One choice of the search: the fillings of the largest length left, each in ever fewer copies."""

    def __init__(self, free: list[int], capacity: int, most_waste: int):
        self.capacity, self.most_waste = capacity, most_waste
        self.asked, self.ways = 0, None
        self.copies, self.filling = 0, ()
        self.largest = next(s for s in range(capacity, 0, -1) if free[s])

    def _open(self, free: list[int]) -> Iterator[Filling | None]:
        rest = list(free)
        rest[self.largest] -= 1
        sizes = [s for s in range(1, self.largest + 1) if rest[s]]
        return islice(fillings(self.capacity - self.largest, sizes, rest, self.most_waste), self.asked, None)

    def advance(self, free: list[int]) -> bool | None:
        """Give back the present choice and take the next one; None: it was dominated, False: there is none."""
        for s in self.filling:
            free[s] += self.copies
        if self.copies > 1:
            self.copies //= 2
        else:
            self.ways = self.ways or self._open(free)
            way = next(self.ways, False)
            self.asked += 1
            if not isinstance(way, tuple):
                self.filling, self.copies = (), 0
                return way
            self.filling = (self.largest, *way)
            self.copies = min(free[s] // self.filling.count(s) for s in set(self.filling))
        for s in self.filling:
            free[s] -= self.copies
        return True

    def waste(self) -> int:
        return self.copies * (self.capacity - sum(self.filling)) if self.copies else 0


def search(counts: list[int], capacity: int, best: list[tuple[int, Filling]], nodes: int) -> list[tuple[int, Filling]]:
    """Branch and bound from the incumbent ``best``, over at most ``nodes`` fillings."""
    total = sum(s * n for s, n in enumerate(counts))
    bound = least_sequences(counts, capacity)
    incumbent = sum(n for n, _ in best)
    free, levels, deeper = list(counts), [], True
    while incumbent > bound and nodes > 0:
        spare = (incumbent - 1) * capacity - total - sum(v.waste() for v in levels)
        if deeper and not any(free):
            best, deeper = [(v.copies, v.filling) for v in levels], False
            incumbent = sum(n for n, _ in best)
            continue
        if deeper:
            levels.append(Level(free, capacity, spare))
            if len(levels) > LIVE:
                levels[-LIVE - 1].ways = None
        elif not levels:
            break
        taken = levels[-1].advance(free)
        nodes -= 1
        deeper = bool(taken) and sum(v.waste() for v in levels) <= (incumbent - 1) * capacity - total
        if taken is False:
            levels.pop()
    return best


def bin_completion(counts: list[int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[int, Filling]]:
    """``(copies, lengths)`` of sequences that hold ``counts[length]`` pieces of each length."""
    return search(counts, capacity, best_fit(counts, capacity), nodes)


class Encoder:
    """Token ids of whole texts, with a cache of the ids of pre-tokens."""

    def __init__(self, tokenizer_json: str, classes):
        self.merger, self.splitter = RankMerger(tokenizer_json), PreTokens(tokenizer_json, classes)
        self.known = Known(self._fresh, self._forget)

    def _forget(self) -> None:
        self.ids, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _fresh(self, texts: list[str]) -> None:
        ids, size = self.merger.merge([t.encode("utf-8", "replace") for t in texts])
        self.start = np.append(self.start, len(self.ids) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.ids = np.append(self.ids, ids.astype(np.uint32))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with the closing id."""
        pieces = self.splitter.split(texts)
        slots = self.known.slots(pieces)
        size = self.size[slots]
        total = np.bincount(pieces.row, weights=size, minlength=len(texts)).astype(np.int64) + 1
        end = np.cumsum(total)
        out = np.full(int(end[-1]), END, np.uint32)
        before = np.cumsum(size) - size
        k = np.arange(int(size.sum()))
        out[k + np.repeat(pieces.row, size)] = self.ids[k + np.repeat(self.start[slots] - before, size)]
        rows = [out[e - n:e] for e, n in zip(end.tolist(), total.tolist())]
        for i, parts in pieces.extra.items():
            ids = [np.array([p], np.uint32) if not isinstance(p, str) else self._one(p) for p in parts]
            rows[i] = np.concatenate([*ids, np.array([END], np.uint32)])
        return rows

    def _one(self, text: str) -> np.ndarray:
        s = self.known.one(text)
        return self.ids[self.start[s]:self.start[s] + self.size[s]]


def _pieces(shared, capacity: int, with_ids: bool):
    def run(batches):
        encoder = Encoder(shared.value, code_classes())
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for first, texts in text_lists(batch["text"]):
                for r, x in enumerate(encoder.encode(texts)):
                    cuts = [0, *range(len(x) % capacity or capacity, len(x) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append(first + r)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(x[a:b].astype("<u4").tobytes()))
                        if with_ids:
                            ids.append(x[a:b].astype("<u4").tobytes())
            out = {"doc_id": batch["doc_id"].take(pa.array(rows, pa.int64())), "piece": pa.array(piece, pa.int32()),
                   "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                   "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                out["ids"] = pa.array(ids, pa.binary())
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))
    return run


def token_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: each document's ids and a
    closing 0, cut into pieces of ``capacity`` of which the first may be shorter.
    ``ids``: little-endian unsigned 32-bit numbers."""
    spark = docs.sparkSession
    arrow_batches(spark)
    with open(tokenizer_file(vocabulary), encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # the vocabulary file: a few MB, whatever the input
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _pieces(shared, capacity, with_ids),
        f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


class Places:
    """Where the r-th piece of a length goes, for a list of fillings."""

    def __init__(self, kinds: list[tuple[int, Filling]], runs: list[tuple[int, int, int, int]]):
        """``runs``: (partition, length, first position, pieces) of the sorted pieces."""
        used: dict[int, int] = {}
        rows, base = [], 0
        for copies, members in kinds:
            offset = 0
            for s in dict.fromkeys(members):
                each = members.count(s)
                rows.append((s, used.get(s, 0), base, each, offset))
                used[s] = used.get(s, 0) + each * copies
                offset += each * s
            base += copies
        rows.sort()
        self.length, self.rank, self.base, self.each, self.offset = (np.array(x, np.int64) for x in zip(*rows))
        self.at = self.length << 44 | self.rank
        before: dict[int, int] = {}
        found = []
        for part, s, first, n in sorted(runs):
            found.append((part << 16 | s, first - before.get(s, 0)))
            before[s] = before.get(s, 0) + n
        self.run, self.shift = (np.array(x, np.int64) for x in zip(*sorted(found)))

    def of(self, position: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = position - self.shift[np.searchsorted(self.run, (position >> 33) << 16 | length)]
        k = np.searchsorted(self.at, length << 44 | rank, "right") - 1
        within = rank - self.rank[k]
        return self.base[k] + within // self.each[k], self.offset[k] + within % self.each[k] * length


def _assign(shared):
    def run(batches):
        places = Places(*shared.value)
        for batch in batches:
            where = places.of(batch["position"].to_numpy(), batch["length"].to_numpy())
            cols = {n: batch[n] for n in batch.schema.names if n != "position"}
            cols |= {"sequence_id": pa.array(where[0], pa.int64()), "offset": pa.array(where[1], pa.int64())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``capacity``) plus ``sequence_id`` and ``offset``."""
    order = [c for c in ("length", "doc_id", "piece", "ids_crc32") if c in pieces.columns]
    placed = staged(staged(pieces).repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("position", F.monotonically_increasing_id()))
    runs = [tuple(r) for r in placed.groupBy(F.shiftright("position", 33).alias("part"), "length")
            .agg(F.min("position"), F.count(F.lit(1))).collect()]  # at most partitions + lengths rows
    counts = [0] * (capacity + 1)
    for _, s, _, n in runs:
        counts[s] += n
    out = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id bigint, offset bigint"
    if not runs:
        return pieces.select("*", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")).limit(0)
    shared = pieces.sparkSession.sparkContext.broadcast((bin_completion(counts, capacity, nodes), runs))
    return placed.mapInArrow(_assign(shared), out)


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs(doc_id, text)`` with their places; ``with_ids`` keeps the ids."""
    return pack(token_pieces(docs, vocabulary, capacity, with_ids), capacity)
