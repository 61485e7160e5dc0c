"""Distributed greedy maximisation over a ``cells`` table.

Gains live in a table ``gains(doc_id, gain, n_cells)`` that every pick brings up
to date (:class:`GainTable`): only the cells of the last pick change their
cover, so only the rows of those cells are joined, and

    gain(d) += sum over shared cells of  C(new cover + d) - C(new cover)
                                       - C(old cover + d) + C(old cover)

The cells are partitioned by document once and the gains with them, so a round
moves nothing but the pick's cells: an inner join with these, a sum per document,
the new table, and top-1 by (round(gain, 9) desc, doc_id asc) in one job.  What is
broadcast are the picks' cells, whose number the driver knows exactly; above the
limit they are joined by shuffle.  Tables of gains stay cached, and every ``CUT`` rounds one is staged in the shared
checkpoint folder, so neither plans nor recomputation grow with k.  Only the picks
reach the driver.

The lazy variant keeps upper bounds (stale gains) in a table and evaluates a few
documents at a time, several picks a job; it returns exactly the same picks.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.objectives import EXACTLY_ONE, INFLUENCE, KINDS, MAX, SQRT_COUNT, influence_contribution, influence_segments
from ..session import DEFAULT_BROADCAST_ROWS, join_small, materialize
from .local_greedy import certified_picks

SELECTION_SCHEMA = T.StructType([
    T.StructField("rank", T.IntegerType(), False),
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("gain", T.DoubleType(), False),
    T.StructField("score", T.DoubleType(), False),
])
GAIN_DIGITS = 9  # tie rule: highest round(gain, 9), then lowest doc_id


def contribution(kind: Column, theta: Column, value: Column, cmax: Column, ccnt: Column, kinds: set[str] = frozenset(KINDS)) -> Column:
    """Marginal value of one (doc, cell) row given the cover of the cell."""
    c = F.coalesce(ccnt, F.lit(0))
    base = F.greatest(F.lit(0.0), F.coalesce(cmax, F.lit(0.0)))
    if kinds == {MAX}:
        return theta * F.greatest(F.lit(0.0), value - base)
    return (F.when(kind == MAX, theta * F.greatest(F.lit(0.0), value - base))
            .when(kind == SQRT_COUNT, theta * (F.sqrt((c + 1).cast("double")) - F.sqrt(c.cast("double"))))
            .when(kind == EXACTLY_ONE, theta * F.when(c == 0, F.lit(1.0)).when(c == 1, F.lit(-1.0)).otherwise(F.lit(0.0)))
            .otherwise(F.lit(0.0)))


def prepare_cells(cells: DataFrame, cache: str = "checkpoint") -> DataFrame:
    """Materialise the cells once for the k rounds.

    The cells are checkpointed as they come (lineage cut, survives executor
    loss), then hash-partitioned by doc_id, sorted by doc_id inside each
    partition and cached.  The cache keeps ``HashPartitioning(doc_id)``, so
    every round's per-document sum is partition-local (no exchange), and the
    sort gives each cached column batch a narrow doc_id range, so the
    ``doc_id IN (...)`` scans of the cover and of lazy re-evaluation skip
    almost all batches by their min/max statistics.  A lost cached block is
    rebuilt from the checkpoint files."""
    if "t" not in cells.columns:
        cells = cells.withColumn("t", F.lit(None).cast("int"))
    base = materialize(cells.select("doc_id", "cell", "kind", "theta", "value", "t"), cache)
    if cache == "none":
        return base
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = base.repartition(n, "doc_id").sortWithinPartitions("doc_id").persist(StorageLevel.MEMORY_AND_DISK)
    # one job fills the cache and lists the combiner kinds for the engine
    out._corpuslens_kinds = {r[0] for r in out.groupBy("kind").count().collect()}
    base.unpersist()
    return out


class _Engine:
    def __init__(self, cells: DataFrame, broadcast_rows: int = DEFAULT_BROADCAST_ROWS):
        self.cells = cells
        self.broadcast_rows = broadcast_rows
        self.selected: list[int] = []
        self.cover_bound = 0  # sum of the selected docs' cell counts
        self._covers: dict[str, DataFrame] = {}  # this round's covers, cached on first use
        kinds = getattr(cells, "_corpuslens_kinds", None)
        if kinds is None:
            kinds = {r[0] for r in cells.select("kind").distinct().collect()}
        if unknown := kinds - set(KINDS):
            raise ValueError(f"unknown kinds of cells: {sorted(map(str, unknown))}")
        self.kinds = kinds
        self.has_std = kinds != {INFLUENCE}
        self.has_inf = INFLUENCE in kinds

    def _standard(self, c: DataFrame) -> DataFrame:
        if self.has_inf:
            c = c.filter(F.col("kind") != INFLUENCE)
        if self.selected:
            cover = self._cover("std", lambda: self.cells.filter(F.col("doc_id").isin(self.selected))
                                .groupBy("cell").agg(F.max("value").alias("cmax"), F.count(F.lit(1)).alias("ccnt")))
            c = join_small(c, cover, "cell", "left", self.broadcast_rows, known_rows=self.cover_bound)
            contrib = contribution(F.col("kind"), F.col("theta"), F.col("value"), F.col("cmax"), F.col("ccnt"), self.kinds)
        else:
            contrib = contribution(F.col("kind"), F.col("theta"), F.col("value"), F.lit(None), F.lit(None), self.kinds)
        return c.groupBy("doc_id").agg(F.sum(contrib).alias("gain"), F.count(F.lit(1)).alias("n_cells"))

    def _influence(self, c: DataFrame) -> DataFrame:
        c = c.filter(F.col("kind") == INFLUENCE)
        n = F.count(F.lit(1)).alias("n_cells")
        if not self.selected:
            return c.groupBy("doc_id").agg(F.sum(F.col("value") * F.col("theta")).alias("gain"), n)
        seg = self._cover("inf", lambda: influence_segments(
            self.cells.filter(F.col("doc_id").isin(self.selected) & (F.col("kind") == INFLUENCE))))
        # one row per (candidate cell, segment of its term); a term outside the
        # cover keeps one row with null segment -> value * tail
        j = join_small(c, seg, "cell", "left", self.broadcast_rows, known_rows=2 * self.cover_bound)
        contrib = influence_contribution(F.col("t"), F.col("value"), F.col("theta"), F.col("lo"), F.col("t_lo"),
                                         F.col("hi"), F.coalesce(F.col("t_hi"), F.lit(0.0)),
                                         F.coalesce(F.col("m"), F.lit(0.0)))
        return j.groupBy("doc_id").agg(F.sum(contrib).alias("gain"), F.countDistinct("cell").alias("n_cells"))

    def gains(self, only: list[int] | None = None, due: DataFrame | None = None) -> DataFrame:
        """``(doc_id, gain, n_cells)`` for unselected docs (or just the ids of
        ``only``, a short list, or of ``due(doc_id)``)."""
        c = self.cells
        if only is not None:
            c = c.filter(F.col("doc_id").isin(only))
        if due is not None:
            c = c.join(due, "doc_id", "left_semi")
        if self.selected:
            c = c.filter(~F.col("doc_id").isin(self.selected))
        parts = ([self._standard(c)] if self.has_std else []) + ([self._influence(c)] if self.has_inf else [])
        if len(parts) == 1:
            return parts[0]
        return parts[0].unionByName(parts[1]).groupBy("doc_id").agg(
            F.sum("gain").alias("gain"), F.sum("n_cells").alias("n_cells"))

    def _cover(self, name: str, build) -> DataFrame:
        """The cover of the current selection; cached (filled by the first job
        that uses it) so re-evaluation steps of one round reuse it."""
        if name not in self._covers:
            self._covers[name] = build().persist(StorageLevel.MEMORY_AND_DISK)
        return self._covers[name]

    def release(self):
        for df in self._covers.values():
            df.unpersist()
        self._covers = {}

    def select(self, doc_id: int, n_cells: int):
        self.selected.append(int(doc_id))
        self.cover_bound += int(n_cells)
        for df in self._covers.values():
            df.unpersist()
        self._covers = {}


class GainTable:
    """Gains of all documents that are not picked, kept by the change of each round."""

    CUT = 5  # rounds after which a table is staged

    def __init__(self, cells: DataFrame, broadcast_rows: int = DEFAULT_BROADCAST_ROWS):
        self.engine = _Engine(cells, broadcast_rows)
        self.cells, self.broadcast_rows = cells, broadcast_rows
        self.selected: list[int] = []
        self.bound = self.mine = self.rounds = 0
        self.table = self.engine.gains().persist(StorageLevel.MEMORY_AND_DISK)

    def add(self, picks: list[tuple[int, int]]) -> None:
        """Picks of a round ``(doc_id, n_cells)`` that share no cell with each other."""
        new = [int(d) for d, _ in picks]
        self.mine = sum(int(n) for _, n in picks)              # cells of this round's picks
        self.bound += self.mine
        change = self.change(new)
        old = self.table
        self.selected += new
        left = old.filter(~F.col("doc_id").isin(new)).join(change, "doc_id", "left")
        table = left.select("doc_id", (F.col("gain") + F.coalesce("change", F.lit(0.0))).alias("gain"), "n_cells")
        self.rounds += 1
        if self.rounds % self.CUT == 0:     # whatever the cells' cache: plans must not grow with k
            self.table = materialize(table, "table")
        else:
            self.table = table.persist(StorageLevel.MEMORY_AND_DISK)
        self._stale = old

    def taken(self) -> None:
        """Called once the new table has been read: the one before is let go."""
        if self.rounds:
            self._stale.unpersist()

    def change(self, new: list[int]) -> DataFrame:
        """``(doc_id, change)``: what the picks ``new`` do to the other documents' gains."""
        parts = ([self._standard(new)] if self.engine.has_std else []) + ([self._influence(new)] if self.engine.has_inf else [])
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return rows.groupBy("doc_id").agg(F.sum("change").alias("change"))

    def touched(self, new: list[int]) -> DataFrame:
        """The rows of the cells of the picks ``new``: what a round joins."""
        mine = self.cells.filter(F.col("doc_id").isin(new)).select("cell").distinct()
        return join_small(self.cells, mine, "cell", "left_semi", self.broadcast_rows, known_rows=self.mine)

    def _standard(self, new: list[int]) -> DataFrame:
        fresh = F.col("doc_id").isin(new)
        cover = (self.cells.filter(F.col("doc_id").isin(self.selected + new) & (F.col("kind") != INFLUENCE)).groupBy("cell")
                 .agg(F.max(F.when(~fresh, F.col("value"))).alias("cmax"), F.count(F.when(~fresh, 1)).alias("ccnt"),
                      F.max(F.when(fresh, F.col("value"))).alias("added"), F.count(F.when(fresh, 1)).alias("more"))
                 .filter(F.col("more") > 0))
        cells = self.cells.filter(F.col("kind") != INFLUENCE) if self.engine.has_inf else self.cells
        rows = join_small(cells, cover, "cell", "inner", self.broadcast_rows, known_rows=self.mine)
        kind, theta, value, cmax, ccnt = (F.col(c) for c in ("kind", "theta", "value", "cmax", "ccnt"))
        after = contribution(kind, theta, value, F.greatest("cmax", "added"), ccnt + F.col("more"), self.engine.kinds)
        return rows.select("doc_id", (after - contribution(kind, theta, value, cmax, ccnt, self.engine.kinds)).alias("change"))

    def _influence(self, new: list[int]) -> DataFrame:
        every = self.cells.filter(F.col("doc_id").isin(self.selected + new) & (F.col("kind") == INFLUENCE))
        # per term of a pick: the step functions before (sign -1) and after it (sign 1)
        both = (every.withColumn("sign", F.explode(F.when(F.col("doc_id").isin(new), F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(-1)))))
                .withColumn("mine", F.max(F.when(F.col("doc_id").isin(new), 1).otherwise(0)).over(Window.partitionBy("cell")))
                .filter(F.col("mine") == 1))
        steps = influence_segments(both, ["sign"])
        bare = every.groupBy("cell").agg(F.max(F.when(~F.col("doc_id").isin(new), 1).otherwise(0)).alias("was")).filter(F.col("was") == 0)
        bare = bare.select(F.lit(-1).alias("sign"), "cell", F.lit(None).cast("int").alias("lo"), F.lit(None).cast("double").alias("t_lo"),
                           F.lit(None).cast("int").alias("hi"), F.lit(0.0).alias("t_hi"), F.lit(0.0).alias("m"))
        rows = join_small(self.cells.filter(F.col("kind") == INFLUENCE).withColumnRenamed("t", "mine_t"), steps.unionByName(bare), "cell", "inner",
                          self.broadcast_rows, known_rows=5 * self.bound)
        part = influence_contribution(F.col("mine_t"), F.col("value"), F.col("theta"), F.col("lo"), F.col("t_lo"), F.col("hi"),
                                      F.coalesce(F.col("t_hi"), F.lit(0.0)), F.coalesce(F.col("m"), F.lit(0.0)))
        return rows.select("doc_id", (F.col("sign") * part).alias("change"))

    def release(self) -> None:
        self.table.unpersist()
        self.engine.release()


def _order(gain: str = "gain"):
    return [F.round(F.col(gain), GAIN_DIGITS).desc(), F.col("doc_id").asc()]


def _to_frame(spark, picks) -> DataFrame:
    rows, total = [], 0.0
    for i, (doc_id, gain) in enumerate(picks, start=1):
        total += gain
        rows.append((i, int(doc_id), float(gain), float(total)))
    return spark.createDataFrame(rows, SELECTION_SCHEMA)


def greedy_select(cells: DataFrame, k: int, prepared: bool = False, cache: str = "checkpoint",
                  broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """G1: exact greedy, k rounds, each adding the argmax marginal gain.

    Returns ``selection(rank, doc_id, gain, score)``; ``k`` larger than the
    number of documents returns all of them."""
    c = cells if prepared else prepare_cells(cells, cache)
    gains = GainTable(c, broadcast_rows)
    picks = []
    while len(picks) < k:
        best = gains.table.orderBy(*_order()).limit(1).collect()
        gains.taken()
        if not best:
            break
        picks.append((best[0]["doc_id"], best[0]["gain"]))
        if len(picks) < k:
            gains.add([(best[0]["doc_id"], best[0]["n_cells"])])
    gains.release()
    if not prepared:
        c.unpersist()
    return _to_frame(cells.sparkSession, picks)


class LazyRounds:
    """Greedy picks of one or more parts, several of them a job.

    The first gains of all documents are a staged table of bounds: gains only
    shrink as the selection grows (submodularity).  Of each part, the ``batch``
    documents with the best bounds are *heads*; one task takes their cells and
    those of the documents picked so far, and runs a lazy greedy on them.  A
    pick counts as long as its exact gain comes before the best bound outside
    the heads, so it is the pick of a greedy over all documents.  Exact gains
    come back as the heads' new bounds.  When no pick of a part counts, all gains
    are computed anew on the cluster, after which its best one does.

    The driver and each task hold ``batch`` documents per step, whatever the
    corpus; nothing depends on how many documents share a bound.
    """

    def __init__(self, cells: DataFrame, batch: int, parts: Column | None = None, cache: str = "checkpoint",
                 broadcast_rows: int = DEFAULT_BROADCAST_ROWS):
        part = F.lit(0) if parts is None else parts
        if "t" not in cells.columns:
            cells = cells.withColumn("t", F.lit(None).cast("int"))
        self.spark, self.batch, self.cache = cells.sparkSession, batch, cache
        self.cells = cells.select(part.cast("int").alias("part"), "doc_id", "cell", "kind", "theta", "value", "t")
        self.part = part
        keyed = self.cells.withColumn("cell", F.concat_ws("|", F.col("part"), F.col("cell"))) if parts is not None else self.cells
        self.engine = _Engine(keyed, broadcast_rows)
        if EXACTLY_ONE in self.engine.kinds:
            raise ValueError("lazy greedy needs gains that only shrink; use greedy_select for exactly_one cells")
        self.picks: dict[int, list[tuple[int, float]]] = {}
        self.evaluated: list[int] = []          # per pick: documents evaluated since the one before
        self.pending, self.bounds = 0, None
        self._all_gains()
        self.pending = 0                                                 # the first gains are due in any case

    def _all_gains(self) -> None:
        if self.bounds is not None:
            self.bounds.unpersist()
        gains = self.engine.gains().select("doc_id", self.part.cast("int").alias("part"), "gain", "n_cells")
        self.bounds = materialize(gains, "table" if self.cache == "checkpoint" else self.cache)
        self.known: dict[int, dict[int, tuple[float, int]]] = {}        # part -> document -> (bound, cells)
        self.beyond: dict[int, tuple[float, int] | None] = {}           # part -> key of the best document not known
        self.n_docs = self.bounds.count()
        self.pending += self.n_docs

    def _fill(self, open_parts: set[int] | None) -> None:
        """Takes the next best documents of each part from the table of bounds."""
        low, rows = F.round(F.col("gain"), GAIN_DIGITS), self.bounds
        if open_parts is not None:
            rows = rows.filter(F.col("part").isin(sorted(open_parts)))
            after = F.lit(False)
            for p in open_parts:
                g, d = -self.beyond[p][0], self.beyond[p][1]
                after = after | ((F.col("part") == p) & ((low < g) | ((low == g) & (F.col("doc_id") >= d))))
            rows = rows.filter(after)
        w = Window.partitionBy("part").orderBy(low.desc(), F.col("doc_id"))
        top = rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= self.batch + 1)
        for p in ({r for r in self.beyond} if open_parts is None else open_parts):
            self.beyond[p] = None
        picked = {d for ps in self.picks.values() for d, _ in ps}
        for r in top.collect():                                          # at most batch + 1 rows a part
            if r["place"] > self.batch:
                self.beyond[r["part"]] = (-round(r["gain"], GAIN_DIGITS), r["doc_id"])
            elif r["doc_id"] not in picked:
                self.known.setdefault(r["part"], {})[r["doc_id"]] = (r["gain"], r["n_cells"])
                self.beyond.setdefault(r["part"], None)

    def run(self, k: int) -> dict[int, list[tuple[int, float]]]:
        """``part -> [(doc_id, gain)]`` in pick order, at most ``k`` a part."""
        self._fill(None)
        while True:
            live = {p for p, docs in self.known.items() if docs and len(self.picks.get(p, [])) < k}
            thin = {p for p in live | {p for p in self.beyond if len(self.picks.get(p, [])) < k}
                    if self.beyond.get(p) and len(self.known.get(p, {})) < self.batch}
            if thin:
                self._fill(thin)
                continue
            if not live:
                return self.picks
            if not self._step(live, k):
                self._all_gains()
                self._fill(None)

    def _step(self, live: set[int], k: int) -> bool:
        heads, least, want = {}, {}, {}
        for p in live:
            order = sorted(self.known[p], key=lambda d: (-round(self.known[p][d][0], GAIN_DIGITS), d))
            heads[p] = {d: self.known[p][d][0] for d in order[:self.batch]}
            outside = [(-round(self.known[p][d][0], GAIN_DIGITS), d) for d in order[self.batch:self.batch + 1]]
            outside += [self.beyond[p]] if self.beyond.get(p) else []
            least[p] = min(outside, default=None)
            want[p] = k - len(self.picks.get(p, []))
        chosen = {p: [d for d, _ in self.picks.get(p, [])] for p in live}
        ids = sorted({d for p in live for d in [*heads[p], *chosen[p]]})

        def certify(pdf):
            p = int(pdf["part"].iloc[0])
            return certified_picks(pdf, heads[p], chosen[p], least[p], want[p])

        rows = (self.cells.filter(F.col("doc_id").isin(ids)).groupBy("part")
                .applyInPandas(certify, "part int, doc_id bigint, gain double, place int").collect())
        self.pending += len(rows)
        done = {p: 0 for p in live}
        for r in sorted(rows, key=lambda r: r["place"] or 0):
            if r["place"]:
                _, n = self.known[r["part"]].pop(r["doc_id"])
                self.picks.setdefault(r["part"], []).append((r["doc_id"], r["gain"]))
                self.engine.select(r["doc_id"], n)
                self.evaluated.append(self.pending)
                self.pending = 0
                done[r["part"]] += 1
            else:
                self.known[r["part"]][r["doc_id"]] = (r["gain"], self.known[r["part"]][r["doc_id"]][1])
        return all(done.values())

    def release(self) -> None:
        self.bounds.unpersist()
        self.engine.release()


def lazy_greedy_select(cells: DataFrame, k: int, batch: int = 128, prepared: bool = False,
                       cache: str = "checkpoint", broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                       stats: dict | None = None) -> DataFrame:
    """Batched lazy greedy (:class:`LazyRounds`).  Same picks as :func:`greedy_select`.

    ``stats`` receives the share of documents evaluated per pick after the first
    gains.  Not for ``exactly_one`` cells, whose gains may grow."""
    c = cells if prepared else materialize(cells, cache)
    rounds = LazyRounds(c, batch, None, cache, broadcast_rows)
    n_docs = rounds.n_docs
    picks = rounds.run(k).get(0, [])
    rounds.release()
    if not prepared:
        c.unpersist()
    if stats is not None:
        later = rounds.evaluated[1:]
        stats.update(n_docs=n_docs, evaluated_per_round=rounds.evaluated,
                     share_evaluated=sum(later) / max(1, len(later)) / max(1, n_docs))
    return _to_frame(cells.sparkSession, picks)
