"""Operator 8: near-duplicate groups by an LSH forest over MinHash signatures.

Every text becomes a set of word shingles.  Texts with equal sets form one
class and go on as one row.  A class has one short signature per tree; each
tree is the list of all classes sorted by signature (range-partitioned, so a
signature shared by a third of all rows is split like any other stretch).
A class's candidates are the rows before it in that order, as far as the common
prefix reaches the depth of the region: the least depth at which fewer than
``BACK`` rows before it share its prefix, so a sparse stretch is compared at
``LEAST_DEPTH`` and a crowded one deeper; the row just before it is a candidate
in any case.  A pair goes on if its two classes are
candidates in two orders, or in one with a long common prefix; by chance
neither happens to unlike texts.  Pairs are compared on their full sets.  A
first round compares each class with its best partner only.  Where candidates
still lie between two groups so found, a further round compares them with the
other group's hubs (its classes with the most confirmed links), which finds
borderline members that are like the group's original only.  That goes on until
no link is found; then all candidates that still lie between two groups are compared.

The orders only find most links early.  What they leave out is found exactly:
with the shingles of each set in one global order, rare ones first, two sets
at the asked similarity share a shingle among the first fifth or so of both.
All pairs of classes in different groups that share one there, and that length
and place do not rule out, are compared.  Pairs inside a group add nothing and
are not formed, so a shingle that a large group shares costs its few rows from
elsewhere times its many, not the square.  So the groups are those of all links.
Linked pairs are joined into groups by least-label propagation with pointer
jumping.

Defined results: null and empty texts have an empty set and are linked with
nothing; texts below ``size`` words have one shingle, the whole sequence;
rows with equal sets are in one group whatever their ids; a row without id is
its own group (``component_id`` null) and is kept; a group's ``component_id``
is its least ``doc_id`` and one text of that id is kept, so if an id repeats with
unlike texts, each goes by its own group; an empty table gives an empty table.  Only ``doc_id`` and ``text`` are read, so other columns cannot
clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_small
from .common import arrow_batches, staged
from .words import SpanHasher, Words, distinct_in_rows, mix64, not_space, random_words, shingle_hashes, text_slices

TREES, DEPTH = 32, 8          # signature orders, values per signature
LEAST_DEPTH, DEEP = 4, 6      # shortest common prefix; prefix that suffices alone
MEETINGS = 2                  # orders in which a pair must meet else
BACK = 4                      # rows looked back at in each order, as far as the region's depth allows
FIRST = 3                     # first common shingles that a pair must have met in
HUBS = 8                      # classes of a group that its doubtful members are compared with
COUNTERS, CHUNKS = 21, 64     # bits of the counters that put rare shingles first (any order is right); parts they are summed in
HASHED_AT_ONCE = 1 << 16      # shingles whose hashes stay in a core's cache


def shingle_sets(reader: SpanHasher, column: pa.Array, size: int):
    """Per slice of the column: ``(distinct shingle hashes, row starts)``."""
    mask = not_space()
    for _, _, data, offsets in text_slices(column):
        yield distinct_in_rows(*shingle_hashes(Words(data, offsets, mask, reader), size))


def set_key(values: np.ndarray) -> bytes:
    """128-bit digest of a set, by two sums of differently mixed members."""
    a, b = mix64(values), mix64(values ^ np.uint64(0x5851F42D4C957F2D))
    return np.array([a.sum(dtype=np.uint64), b.sum(dtype=np.uint64)]).tobytes()


def signatures(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values of 16 bits for each row; all rows are non-empty."""
    seeds = random_words(2 * n, 11)
    mult, add = (seeds[:n] | np.uint64(1)).astype(np.uint32), seeds[n:].astype(np.uint32)
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts) - 1, n), np.uint32)
    i = 0
    while i < len(starts) - 1:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + HASHED_AT_ONCE, "right")) - 1)
        part, at = x[starts[i]:starts[j]], starts[i:j] - starts[i]
        v = np.empty_like(part)
        for k in range(n):
            np.multiply(part, mult[k], out=v)
            v += add[k]
            out[i:j, k] = np.minimum.reduceat(v, at)
        i = j
    return (mix64(out) >> np.uint64(48)).astype(">u2")


def _sign(size: int, trees: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = SpanHasher()
        for batch in batches:
            n, keys, sigs = [], [], []
            for values, starts in shingle_sets(reader, batch["text"], size):
                count = np.diff(starts)
                full = np.flatnonzero(count)
                sig = signatures(values, np.append(starts[:-1][full], starts[-1]), trees * depth) if len(full) else None
                at = {int(r): i for i, r in enumerate(full)}
                n += count.tolist()
                keys += [set_key(values[starts[r]:starts[r + 1]]) if r in at else None for r in range(len(count))]
                sigs += [sig[at[r]].tobytes() if r in at else None for r in range(len(count))]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_key"], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "set_key", "signature"])
    return run


def _neighbours(back: int, least: int, depth: int):
    """Sorted ``(tree, prefix, node)`` rows -> pairs of near rows with their common prefix."""
    def run(batches):
        kept = None
        for batch in batches:
            tree = batch["tree"].to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(batch["prefix"].to_pylist()), np.uint16).reshape(-1, depth)
            node = batch["node"].to_numpy(zero_copy_only=False)
            fresh = len(node)
            if kept is not None:
                tree, sig, node = (np.concatenate(x) for x in zip(kept, (tree, sig, node)))
            first, pairs = len(node) - fresh, []
            crowd = np.zeros(len(node), np.int64)       # prefix that the row ``back`` places before still shares
            for d in range(back, 0, -1):
                b = np.arange(max(first, d), len(node))
                same = np.logical_and.accumulate(sig[b - d] == sig[b], axis=1).sum(axis=1)
                same[tree[b - d] != tree[b]] = 0
                if d == back:
                    crowd[b] = same
                region = np.maximum(least, crowd[b] + 1) if d > 1 else least
                ok = (same >= region) & (node[b - d] != node[b])
                pairs.append((np.minimum(node[b - d], node[b])[ok], np.maximum(node[b - d], node[b])[ok], same[ok]))
            kept = tree[-back:], sig[-back:], node[-back:]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*pairs)], ["a", "b", "same"])
    return run


def candidates(nodes: DataFrame, trees: int = TREES, depth: int = DEPTH, back: int = BACK,
               least: int = LEAST_DEPTH) -> DataFrame:
    """``(a, b, trees, same)`` for ``nodes(node, signature)``: pairs a < b that are
    neighbours in ``trees`` orders, and the longest prefix that they share there."""
    width = 2 * depth
    rows = (nodes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
            .select("tree", F.expr(f"substring(signature, tree * {width} + 1, {width})").alias("prefix"), "node"))
    order = ["tree", "prefix", "node"]
    pairs = (rows.repartitionByRange(*order).sortWithinPartitions(*order)
             .mapInArrow(_neighbours(back, least, depth), "a bigint, b bigint, same bigint"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("trees"), F.max("same").alias("same"))


def _sets(size: int):
    def run(batches):
        reader = SpanHasher()
        for batch in batches:
            sets = []
            for values, starts in shingle_sets(reader, batch["text"], size):
                sets += [values[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(sets, pa.binary())], ["node", "members"])
    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, big = (x, y) if len(x) <= len(y) else (y, x)
                if 100 * len(small) < percent * len(big):
                    ok.append(False)
                    continue
                at = np.minimum(np.searchsorted(big, small), len(big) - 1)
                both = int((big[at] == small).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([batch["a"].take(pa.array(keep)), batch["b"].take(pa.array(keep))], ["a", "b"])
    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of their full sets."""
    pairs = pairs.select("a", "b")

    def side(c: str, name: str) -> DataFrame:           # only the sets that these pairs ask for are moved
        mine = join_small(sets, staged(pairs.select(F.col(c).alias("node")).distinct()), "node", "left_semi")
        return mine.select(F.col("node").alias(c), F.col("members").alias(name))

    return (pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
            .mapInArrow(_confirm(percent), "a bigint, b bigint"))


def ends(pairs: DataFrame) -> DataFrame:
    """``(node)``: a row for each end of each pair."""
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)``: the least node reachable from each node of ``edges(a, b)``.

    In each round a node takes the least of its neighbours and itself, choices are followed
    to their end, and the edges are drawn anew between the ends: those inside a group go, and
    at most half of the nodes still have edges, so later rounds see only what is still apart."""
    rounds, left = [], staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not rounds or left.limit(1).count():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        label = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
        moved = True
        while moved:                                                # each step doubles the length that is followed
            new = _pointed(label, label)
            moved = new.filter("old <> label").limit(1).count()
            label = new.select("node", "label")
        rounds.append(label)
        to = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}"))
        drawn = left.join(to("a"), "a").join(to("b"), "b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"))
        left = staged(drawn.filter("a <> b").distinct())
    labels = rounds.pop()
    while rounds:                                                   # the few nodes of the last rounds first
        labels = _pointed(rounds.pop(), labels).select("node", "label")
    return labels


def _pointed(labels: DataFrame, further: DataFrame) -> DataFrame:
    """``(node, old, label)``: each label of ``labels`` and its own label in ``further``, if it has one."""
    up = further.select(F.col("node").alias("label"), F.col("label").alias("up"))
    return staged(labels.join(up, "label", "left").select("node", F.col("label").alias("old"), F.coalesce("up", "label").alias("label")))


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Labels after new links: only the groups that the links join are walked."""
    mine = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}"))
    groups = found.join(mine("a"), "a", "left").join(mine("b"), "b", "left").select(
        F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).filter("a <> b").distinct()
    moved = components(groups).select(F.col("node").alias("label"), F.col("label").alias("new"))
    alone = ends(found).distinct().join(labels, "node", "left_anti")
    every = labels.select("node", "label").union(alone.select("node", F.col("node").alias("label")))
    return staged(every.join(moved, "label", "left").select("node", F.coalesce("new", "label").alias("label")))


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs that lie between two groups (``of_a`` and ``of_b``)."""
    mine = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}"))
    return staged(pairs.select("a", "b").join(mine("a"), "a", "left").join(mine("b"), "b", "left")
                  .withColumns({"of_a": F.coalesce("of_a", "a"), "of_b": F.coalesce("of_b", "b")}).filter("of_a <> of_b"))


def _hub_pairs(doubtful: DataFrame, links: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of each doubtful class and the hubs of the group it may belong to."""
    degree = ends(links).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("links"), "node"))
    hubs = (labels.join(degree, "node").withColumn("rank", rank).filter(F.col("rank") <= HUBS)
            .select(F.col("label").alias("group"), F.col("node").alias("hub")))
    ask = (doubtful.select(F.col("a").alias("node"), F.col("of_b").alias("group"))
           .union(doubtful.select("b", "of_a")).distinct())
    return ask.join(hubs, "group").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _count_shingles(size: int, salts: int):
    def run(batches):
        reader, total = SpanHasher(), np.zeros(1 << COUNTERS, np.int64)
        for batch in batches:
            for values, _ in shingle_sets(reader, batch["text"], size):
                total += np.bincount((values >> np.uint64(64 - COUNTERS)).astype(np.int64), minlength=len(total))
        few = np.minimum(total, 65535).astype("<u2").reshape(CHUNKS, -1)
        salt = TaskContext.get().partitionId() % salts
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([salt] * CHUNKS, pa.int32()),
                                          pa.array([x.tobytes() for x in few], pa.binary())], ["chunk", "salt", "counts"])
    return run


def _add_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, "<u2").astype(np.int64) for x in pdf["counts"])
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "counts": [np.minimum(total, 65535).astype("<u2").tobytes()]})


def _prefixes(size: int, percent: int, shared):
    """``(node, set_key, text)`` -> of the texts with that set, the shingles of which two
    sets of the asked similarity share one: the rarest, in one order for all sets."""
    def run(batches):
        reader, counts = SpanHasher(), shared.value
        for batch in batches:
            keys, row, n, first, at = batch["set_key"].to_pylist(), [], [], [], 0
            for values, starts in shingle_sets(reader, batch["text"], size):
                often = counts[(values >> np.uint64(64 - COUNTERS)).astype(np.int64)]
                for a, b in zip(starts[:-1], starts[1:]):
                    if b > a and set_key(values[a:b]) == keys[at]:
                        few = b - a + (-percent * (b - a)) // 100 + 1
                        row.append(at)
                        n.append(int(b - a))
                        first.append(values[a:b][np.lexsort((values[a:b], often[a:b]))[:few]].view(np.int64))
                    at += 1
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["node"].take(at), batch["copies"].take(at), pa.array(n, pa.int64()), pa.array(first, pa.list_(pa.int64()))],
                ["node", "copies", "n", "shingles"])
    return run


def prefixes(texts: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """``(node, n, shingles)``: size and rarest shingles of each class's set."""
    kind = "chunk int, counts binary"
    salts = 1 + math.isqrt(texts.rdd.getNumPartitions())       # as many counts meet in the first sum as in the second
    parts = texts.mapInArrow(_count_shingles(size, salts), "chunk int, salt int, counts binary").groupBy("chunk", "salt").applyInPandas(_add_counts, kind)
    found = sorted(parts.groupBy("chunk").applyInPandas(_add_counts, kind).collect())  # 4 MB, whatever the input
    counts = np.frombuffer(b"".join(r["counts"] for r in found), "<u2") if found else np.zeros(1 << COUNTERS, "<u2")
    mine = join_small(texts, classes.select("doc_id", "text_key", "node", "set_key", "copies"), ["doc_id", "text_key"])
    rows = staged(mine.mapInArrow(_prefixes(size, percent, texts.sparkSession.sparkContext.broadcast(counts)),
                                  "node bigint, copies bigint, n bigint, shingles array<bigint>"))
    once, repeated = rows.filter("copies = 1"), rows.filter("copies > 1").dropDuplicates(["node"])
    return once.unionByName(repeated).drop("copies")


def pairs_left(firsts: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: every pair of classes in different groups that may reach ``percent``.

    Of the groups that meet in a shingle the largest is not paired with itself."""
    rows = (firsts.join(labels, "node", "left").select("node", "n", F.coalesce("label", "node").alias("label"), F.posexplode("shingles").alias("at", "shingle")))
    # the only move of all shingles; a row without a next or last row near enough in size has no partner in its list
    every = Window.partitionBy("shingle")
    by_size = every.orderBy("n")
    near = lambda other: 100 * F.least("n", other) >= percent * F.greatest("n", other)
    shared = staged(rows.repartition("shingle")
                    .withColumns({"below": F.lag("n").over(by_size), "above": F.lead("n").over(by_size)})
                    .withColumns({"low": F.min("label").over(every), "high": F.max("label").over(every)})
                    .filter(F.col("low") != F.col("high")).filter(near(F.col("below")) & F.col("below").isNotNull() | near(F.col("above")) & F.col("above").isNotNull())
                    .select("shingle", "node", "label", "n", "at"))
    most = (shared.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("rows"))
            .groupBy("shingle").agg(F.max(F.struct("rows", "label")).alias("m")).select("shingle", F.col("m.label").alias("most")))
    sided = staged(join_small(shared, staged(most), "shingle"))
    x, y = sided.filter("label <> most").alias("x"), sided.alias("y")
    least, largest = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    rest = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))  # common shingles from here on
    total = F.col("x.n") + F.col("y.n")
    asked = F.ceil((percent * total) / (100 + percent))                         # common shingles of a link, at least
    may = ((F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.label") != F.col("y.label"))
           & ((F.col("y.label") == F.col("y.most")) | (F.col("x.node") < F.col("y.node")))
           & (100 * least >= percent * largest) & (rest > asked - FIRST))
    meets = x.join(y, may).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"),
                                  (asked - F.ceil(percent * largest / 100) + 1).alias("inside"))
    # of a link's first common shingles, those not behind the longer set's list are in both lists: FIRST of them are met
    return (meets.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.first("inside").alias("inside"))
            .filter(F.col("common") >= F.least(F.lit(FIRST), F.col("inside"))).select("a", "b"))


def sets_of(texts: DataFrame, classes: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """``(node, members)`` of the classes in ``pairs``."""
    wanted = staged(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node"))
    rows = staged(classes.select("doc_id", "text_key", "node").join(wanted, "node"))
    sets = join_small(texts, rows, ["doc_id", "text_key"]).mapInArrow(_sets(size), "node bigint, members binary")
    return staged(sets.dropDuplicates(["node"]))


def text_key(docs: DataFrame) -> Column:
    """Tells the texts of one id apart."""
    return F.unhex(F.md5(docs["text"].cast("string")))


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``.

    ``size``: words per shingle; ``percent``: least similarity of a link."""
    return _decided(docs, size, percent, trees, depth).drop("text_key")


def _decided(docs: DataFrame, size: int, percent: int, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """The rows of ``near_groups`` with their ``text_key``; equal rows are decided alike."""
    arrow_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        text_key(docs).alias("text_key"))
    signed = staged(texts.mapInArrow(_sign(size, trees, depth),
                                     "doc_id bigint, text_key binary, n_shingles bigint, set_key binary, signature binary"))
    classes = staged(signed.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key")
                     .agg(F.min(F.struct("doc_id", "text_key")).alias("least"), F.first("signature").alias("signature"), F.count(F.lit(1)).alias("copies"))
                     .select("set_key", "least.*", "signature", "copies", F.monotonically_increasing_id().alias("node")))
    met = (F.col("trees") >= MEETINGS) | (F.col("same") >= DEEP)
    pairs = staged(candidates(classes.select("node", "signature"), trees, depth).filter(met))
    sets = sets_of(texts, classes, pairs, size)

    best = pairs.groupBy("b").agg(F.max(F.struct("trees", "same", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    links = staged(confirmed(best, sets, percent))
    labels = components(links)
    asked, hubs_left = best, True
    while True:
        pairs = _between(pairs, labels)
        ask = _hub_pairs(pairs, links, labels) if hubs_left else pairs.select("a", "b")
        ask = staged(ask.join(asked, ["a", "b"], "left_anti"))
        found = staged(confirmed(ask, sets, percent))
        news = found.limit(1).count()
        if news:
            links, asked = links.union(found), asked.union(ask)
            labels = _merged(labels, found)
        if not hubs_left:
            break
        hubs_left = bool(news)                # else hubs bring no more: the pairs themselves

    pairs = staged(pairs_left(prefixes(texts, classes, size, percent), labels, percent).join(asked, ["a", "b"], "left_anti"))
    found = staged(confirmed(pairs, sets_of(texts, classes, pairs, size), percent))
    if found.limit(1).count():
        labels = _merged(labels, found)

    least = F.struct("doc_id", "text_key")
    linked = classes.select("node", least.alias("least")).join(labels, "node")
    heads = linked.groupBy("label").agg(F.min("least").alias("head"))
    heads = join_small(linked.select("node", "label"), staged(heads), "label").select("node", "head")
    ids = (classes.select("set_key", "node", least.alias("least")).join(heads, "node", "left")
           .select("set_key", F.coalesce("head", "least").alias("head")))
    rows = signed.select("doc_id", "text_key", "n_shingles", "set_key")
    out = ["doc_id", "text_key", "n_shingles", "component_id", "kept"]
    grouped = (rows.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").join(ids, "set_key")
               .withColumns({"component_id": F.col("head.doc_id"), "kept": least == F.col("head")}))
    alone = rows.filter("set_key IS NULL OR doc_id IS NULL").withColumns({"component_id": F.col("doc_id"), "kept": F.lit(True)})
    return grouped.select(*out).unionByName(alone.select(*out))


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group one text of the
    least ``doc_id`` stays (one row, if rows repeat that id and text); rows without
    an id all stay.  All columns of ``docs`` are returned unchanged."""
    key = "text_key_of_near_copies"
    while key in docs.columns:
        key += "_"
    drop = _decided(docs, size, percent).filter("NOT kept").select("doc_id", F.col("text_key").alias(key)).distinct()
    with_id = docs.withColumn(key, text_key(docs)).filter("doc_id IS NOT NULL").join(drop, ["doc_id", key], "left_anti")
    return with_id.dropDuplicates(["doc_id", key]).select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))
