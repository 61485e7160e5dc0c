"""Operator 11: the best documents for each query, by Block-Max MaxScore.

A first pass counts documents with terms (N) and all terms (L).  A second one
makes the index: each shard (about ``SHARD_BYTES`` of whole texts in a task) is
one row with its sorted terms and, for each, postings in blocks of ``BLOCK``
documents, as variable-length bytes of document gaps and frequencies, next to each
block's last document and largest impact.  The index is a staged table, so a
lost executor's shards are read again, not made again.

The queries go to the tasks in blocks of bounded size with the weights of their
terms (document frequencies summed over the shards).  A task keeps a heap of
the ``k`` best for each query over all its shards.  In a shard, lists stand by
their bound (weight times largest impact); those are essential without which a
document's bound cannot fall below the threshold, the larger of the heap's last
score and the k-th best partial sum so far.  Essential lists are added up; what
lies only in others is no candidate.  Of the candidates, those are rejected
whose sum with the maxima of the blocks they would lie in stays below the
threshold; only blocks with a candidate left are decompressed, list by list,
and the bounds shrink with each.  Equal scores are kept until ids decide, so the
result is that of a full evaluation.

The heaps of all tasks meet in two window levels, so the rows of a query in one
task are about the square root of the tasks' number times ``k``.  Texts never move;
hot words make longer lists in each shard, never a larger group.

Terms are compared by 64-bit hashes.  Defined results: null and texts without
terms count in nothing and are never found; a query without text, terms or id
finds nothing; queries that repeat an id and text count once; repeated
documents are ranked each; a document without id is ranked after others of its
score; empty tables give no rows; only ``doc_id``, ``item_id`` and ``text`` are
read, so other columns cannot clash.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import arrow_batches
from .words import SpanHasher, Words, text_slices, word_bytes

SHARD_BYTES = 4 << 20
BLOCK = 128
QUERY_BYTES = 1 << 20         # text of the queries that go to the tasks at a time
TOP = 10
NO_ID = np.iinfo(np.int64).max
INDEX = ("docs binary, norm binary, terms binary, df binary, first binary, last binary, most binary, at binary, postings binary")


# ------------------------------------------------------------------ index

def variable_bytes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, low ones first, the last one below 128; and each one's length."""
    size = np.ones(len(x), np.int64)
    for k in range(7, 63, 7):
        size += x >= (1 << k)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        more = np.flatnonzero(size > k)
        out[at[more] + k] = ((x[more] >> (7 * k)) & 127) | np.where(size[more] > k + 1, 128, 0)
    return out, size


def numbers(data: np.ndarray) -> np.ndarray:
    """The inverse of ``variable_bytes``."""
    ends = np.flatnonzero(data < 128)
    begin = np.append(0, ends[:-1] + 1) if len(ends) else ends
    k = np.arange(len(data)) - np.repeat(begin, ends - begin + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * k), begin) if len(ends) else np.zeros(0, np.int64)


def norms(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """``8 * m`` of documents with ``n`` terms, in whole numbers."""
    return 8 * (100 - 75 + (75 * n * documents) // terms)


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + norm)


class Building:
    """Postings of a shard while its texts come in."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.docs: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        self.size = self.bytes = 0

    def add(self, doc_ids: np.ndarray, words: Words) -> None:
        rows = len(words.first) - 1
        row = np.repeat(np.arange(rows), np.diff(words.first))
        term, at = np.unique(words.hash, return_inverse=True)
        key, tf = np.unique(at * rows + row, return_counts=True)
        self.parts.append((term[key // rows], key % rows + self.size, tf))
        self.docs.append(doc_ids)
        self.n.append(np.diff(words.first))
        self.size += rows
        self.bytes += len(words.data)

    def row(self, documents: int, terms: int) -> dict[str, bytes]:
        term, doc, tf = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        order = np.argsort(term, kind="stable")                 # documents of a term stay in order
        term, doc, tf = term[order], doc[order], tf[order]
        norm = norms(np.concatenate(self.n), documents, terms)
        fresh = np.append(True, term[1:] != term[:-1]) if len(term) else np.zeros(0, bool)
        begin = np.flatnonzero(fresh)
        df = np.diff(np.append(begin, len(term)))
        place = np.arange(len(term)) - np.repeat(begin, df)
        lead = np.flatnonzero(place % BLOCK == 0)               # first posting of each block
        gap = np.diff(doc, prepend=0)
        gap[lead] = doc[lead]
        both = np.empty(2 * len(doc), np.int64)
        both[::2], both[1::2] = gap, tf
        data, size = variable_bytes(both)
        at = np.append(np.cumsum(size)[::2] - size[::2], len(data))
        ends = np.append(lead[1:], len(doc)) - 1 if len(lead) else lead
        most = np.maximum.reduceat(impacts(tf, norm[doc]), lead) if len(lead) else lead
        first = np.concatenate([[0], np.cumsum(-(-df // BLOCK))])
        kinds = {"docs": (np.concatenate(self.docs), "<i8"), "norm": (norm, "<i8"), "terms": (term[begin], "<u8"), "df": (df, "<i4"),
                 "first": (first, "<i4"), "last": (doc[ends], "<i4"), "most": (most, "<i4"),
                 "at": (at[np.append(lead, len(doc))], "<i8"), "postings": (data, "u1")}
        return {k: np.asarray(v).astype(t).tobytes() for k, (v, t) in kinds.items()}


def _index(documents: int, terms: int):
    names = [c.split()[0] for c in INDEX.split(", ")]

    def out(building: Building) -> pa.RecordBatch:
        row = building.row(documents, terms)
        return pa.RecordBatch.from_arrays([pa.array([row[n]], pa.binary()) for n in names], names)

    def run(batches):
        building, hasher, mask = Building(), SpanHasher(), word_bytes()
        for batch in batches:
            ids = batch["doc_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in text_slices(batch["text"]):
                building.add(ids[i:j], Words(data, offsets, mask, hasher))
                if building.bytes >= SHARD_BYTES:
                    yield out(building)
                    building = Building()
        if building.size:
            yield out(building)
    return run


def _totals(batches):
    mask = word_bytes()
    mask[65:91] = True
    documents = terms = 0
    for batch in batches:
        for _, _, data, offsets in text_slices(batch["text"]):
            inside = mask[data]
            begin = inside.copy()
            begin[1:] &= ~inside[:-1]
            edges = offsets[1:-1]
            edges = edges[(edges > 0) & (edges < len(data))]
            begin[edges] = inside[edges]
            n = np.diff(np.searchsorted(np.flatnonzero(begin), offsets))
            documents += int((n > 0).sum())
            terms += int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([terms], pa.int64())], ["documents", "terms"])


class Index:
    """A staged index and the totals that its impacts follow."""

    def __init__(self, shards: DataFrame, documents: int, terms: int):
        self.shards, self.documents, self.terms = shards, documents, terms


def build_index(docs: DataFrame) -> Index:
    """The sharded index of ``docs(doc_id, text)``, staged below the shared checkpoint folder."""
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    row = docs.select("text").mapInArrow(_totals, "documents bigint, terms bigint").agg(F.sum("documents"), F.sum("terms")).first()
    documents, terms = row[0] or 0, row[1] or 0
    path = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    # a row is some megabytes: row groups are closed by size after each row, as readers hold a group of rows at a time
    (docs.mapInArrow(_index(documents, max(1, terms)), INDEX).write.option("parquet.block.size", 4 * SHARD_BYTES)
     .option("parquet.page.size.row.check.min", 1).option("parquet.enable.dictionary", "false").parquet(path))
    return Index(spark.read.schema(INDEX).parquet(path), documents, terms)


# ------------------------------------------------------------------ search

class Queries:
    """A block of queries as flat arrays: terms (sorted hashes) and, per query, term numbers and repeats."""

    def __init__(self, items: list[tuple[str, str]]):
        hasher, mask = SpanHasher(), word_bytes()
        hashes = []
        for _, _, data, offs in text_slices(pa.array([t for _, t in items], pa.large_string())):
            w = Words(data, offs, mask, hasher)
            hashes += [w.hash[a:b] for a, b in zip(w.first, w.first[1:])]
        self.terms = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
        self.first, term, times = [0], [], []
        for h in hashes:
            t, n = np.unique(np.searchsorted(self.terms, h), return_counts=True)
            term.append(t)
            times.append(n)
            self.first.append(self.first[-1] + len(t))
        self.term = np.concatenate([*term, np.zeros(0, np.int64)]).astype(np.int64)
        self.times = np.concatenate([*times, np.zeros(0, np.int64)])
        self.weight = np.zeros(len(self.terms), np.int64)

    @classmethod
    def of(cls, state: dict) -> "Queries":
        """From a broadcast ``vars()`` (plain arrays, so workers need no module)."""
        self = cls.__new__(cls)
        self.__dict__.update(state)
        return self


class Shard:
    """One row of the index; lists are decompressed at most once."""

    def __init__(self, row: dict[str, bytes], terms: np.ndarray):
        view = lambda k, t: np.frombuffer(row[k], t)
        self.docs, self.norm, self.last, self.most = view("docs", "<i8"), view("norm", "<i8"), view("last", "<i4"), view("most", "<i4")
        self.at, self.postings, self.first = view("at", "<i8"), view("postings", "u1"), view("first", "<i4")
        mine = view("terms", "<u8")
        at = np.minimum(np.searchsorted(mine, terms), max(0, len(mine) - 1))
        self.number = np.where(mine[at] == terms, at, -1) if len(mine) else np.full(len(terms), -1)
        self.bound = np.zeros(len(terms), np.int64)             # largest impact of each query term's list
        if len(mine):
            most = np.maximum.reduceat(self.most, self.first[:-1]).astype(np.int64)
            self.bound = np.where(self.number >= 0, most[self.number], 0)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.decompressed = 0

    def blocks(self, term: int) -> tuple[int, int]:
        k = self.number[term]
        return int(self.first[k]), int(self.first[k + 1])

    def decode(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of some blocks, in their order."""
        self.decompressed += len(blocks)
        lo, n = self.at[blocks], self.at[blocks + 1] - self.at[blocks]
        take = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
        data = self.postings[take]
        x = numbers(data)
        gap, tf = x[::2], x[1::2]
        pairs = np.add.reduceat(data < 128, np.cumsum(n) - n) // 2 if len(n) else n
        begin = np.cumsum(pairs) - pairs
        total = np.cumsum(gap)
        doc = total - np.repeat(total[begin] - gap[begin], pairs)
        return doc, impacts(tf, self.norm[doc])

    def whole(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        if term not in self.lists:
            self.lists[term] = self.decode(np.arange(*self.blocks(term)))
        return self.lists[term]

    def search(self, term: np.ndarray, value: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (places) and scores of all that may be among the ``k`` best: a document that
        scores ``least`` or more, or as much as the k-th of this shard, is among them.
        ``value``: weight times repeats of each term."""
        bound = value * self.bound[term]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        term, value, bound = term[order], value[order], bound[order]
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0)       # of this list and all after it
        least, n = max(least, 1), len(term)
        if rest[0] < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        score, j = np.zeros(len(self.docs), np.int64), 0
        while j < n and rest[j] >= least:                       # essential lists
            doc, impact = self.whole(int(term[j]))
            score[doc] += value[j] * impact
            j += 1
            if len(score) > k and (j < 8 or j % 4 == 0 or j == n):
                least = max(least, int(np.partition(score, -k)[-k]))
        found = np.flatnonzero((score > 0) & (score + rest[j] >= least))
        # maxima of the blocks that the candidates would lie in
        where, most = [], []
        for t, v in zip(term[j:].tolist(), value[j:].tolist()):
            lo, hi = self.blocks(t)
            at = lo + np.searchsorted(self.last[lo:hi], found)
            where.append(at)
            most.append(np.where(at < hi, v * self.most[np.minimum(at, hi - 1)].astype(np.int64), 0))
        if where:
            where, most = np.stack(where), np.stack(most)
            high = score[found] + most.sum(axis=0)
            for x, (t, v) in enumerate(zip(term[j:].tolist(), value[j:].tolist())):
                keep = high >= least
                found, high, where, most = found[keep], high[keep], where[:, keep], most[:, keep]
                need = most[x] > 0
                if not need.any():
                    continue
                doc, impact = self.lists[t] if t in self.lists else self.decode(np.unique(where[x][need]))
                at = np.minimum(np.searchsorted(doc, found), len(doc) - 1)
                got = np.where(doc[at] == found, v * impact[at], 0)
                score[found] += got
                high += got - most[x]
        found = found[score[found] >= least]
        return found, score[found]


def _search(shared, k: int):
    def run(batches):
        ids, state = shared.value
        queries = Queries.of(state)
        spans = list(zip(queries.first, queries.first[1:]))
        terms = [queries.term[a:b] for a, b in spans]
        values = [queries.weight[queries.term[a:b]] * queries.times[a:b] for a, b in spans]
        heaps = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]     # ids and scores, best first
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, queries.terms)
                for q, (doc, score) in enumerate(heaps):
                    least = int(score[k - 1]) if len(score) >= k else 0
                    found, new = shard.search(terms[q], values[q], least, k)
                    if len(found):
                        doc, score = np.append(doc, shard.docs[found]), np.append(score, new)
                        best = np.lexsort((doc, -score))[:k]
                        heaps[q] = doc[best], score[best]
        item = [i for i, (doc, _) in zip(ids, heaps) for _ in doc]
        query = np.repeat(np.arange(len(ids)), [len(doc) for doc, _ in heaps])
        doc = np.concatenate([*(d for d, _ in heaps), np.zeros(0, np.int64)])
        score = np.concatenate([*(s for _, s in heaps), np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(query, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())],
                                         ["item_id", "query", "doc_id", "score"])
    return run


def _frequencies(shared):
    def run(batches):
        terms = shared.value
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                mine = np.frombuffer(row["terms"], "<u8")
                if len(mine):
                    at = np.minimum(np.searchsorted(mine, terms), len(mine) - 1)
                    df += np.where(mine[at] == terms, np.frombuffer(row["df"], "<i4")[at], 0)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], ["term", "df"])
    return run


def query_blocks(items: DataFrame, block_bytes: int):
    """Lists of (id, text) of bounded size that cover all queries with an id and a text."""
    items = items.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).dropna().distinct()
    total = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        yield sorted(tuple(x) for x in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect())


def best_of(found: DataFrame, k: int, salts: int) -> DataFrame:
    """The ``k`` best rows of each query out of the tasks' heaps, in two levels."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    found = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    some = Window.partitionBy("item_id", "query", "salt").orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k)
    every = Window.partitionBy("item_id", "query").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(every)).filter(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = TOP, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents for each row of ``items(item_id, text)``."""
    spark = items.sparkSession
    parts = []
    salts = max(1, math.isqrt(index.shards.rdd.getNumPartitions()))
    for b, block in enumerate(query_blocks(items, query_bytes)):
        queries = Queries(block)
        hashes = spark.sparkContext.broadcast(queries.terms)   # below the block's bytes: a hash takes 8, a word of a text 2 or more
        df = (index.shards.select("terms", "df").mapInArrow(_frequencies(hashes), "term bigint, df bigint")
              .groupBy("term").agg(F.sum("df")).collect())       # at most a row for each term of the block
        for t, n in df:
            queries.weight[t] = math.floor(1000 * math.log((2 * index.documents + 2) / (2 * n + 1)))
        shared = spark.sparkContext.broadcast(([i for i, _ in block], vars(queries)))
        found = index.shards.mapInArrow(_search(shared, k), "item_id string, query bigint, doc_id bigint, score bigint")
        found = found.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
        parts.append(best_of(found, k, salts).select(F.col("item_id"), "rank", "doc_id", "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    kind = dict(items.dtypes)["item_id"]
    return out.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    return search(build_index(docs), items, k)


#: The same ranking in SQL, for the oracle.
SQL = r"""
WITH term_rows AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
query_rows AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM term_rows GROUP BY doc_id),
totals AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS len FROM lengths),
wanted AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM query_rows GROUP BY item_id, term),
tfs AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM term_rows SEMI JOIN wanted USING (term) GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
            FROM tfs, totals GROUP BY term),
scored AS (
  SELECT item_id, doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // len))))) AS BIGINT) AS score
  FROM wanted JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id),
ordered AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ordered WHERE rank <= 10
"""
