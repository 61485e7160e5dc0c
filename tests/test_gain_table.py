"""Gains kept by change equal gains computed anew; lazy rounds certify the same picks."""
import random

import pytest
from pyspark.sql import functions as F

from corpuslens.functions.objectives import EXACTLY_ONE, INFLUENCE, MAX, SQRT_COUNT
from corpuslens.operators.greedi import greedi_first, part_of
from corpuslens.operators.greedy import GainTable, LazyRounds, greedy_select, lazy_greedy_select, prepare_cells

SCHEMA = "doc_id long, cell string, kind string, theta double, value double, t int"


def mixed(seed: int, kinds, n_docs=40):
    rnd, rows = random.Random(seed), []
    for d in range(n_docs):
        for kind in kinds:
            for c in rnd.sample(range(12), rnd.randrange(1, 7)):
                t = d % 5 if kind == INFLUENCE else None
                theta = {INFLUENCE: 1.0 + 0.25 * (5 - (t or 0))}.get(kind, 0.1 + c / 10)
                rows.append((d, f"{kind}{c}", kind, theta, round(rnd.random(), 3), t))
    return rows


@pytest.mark.parametrize("kinds", [(MAX,), (MAX, SQRT_COUNT), (EXACTLY_ONE,), (INFLUENCE,), (MAX, INFLUENCE, EXACTLY_ONE)])
def test_change_equals_recomputation(spark, kinds):
    cells = prepare_cells(spark.createDataFrame(mixed(1, kinds), SCHEMA), "persist")
    table = GainTable(cells)
    table.CUT = 2
    for _ in range(3):
        kept = {r["doc_id"]: (r["gain"], r["n_cells"]) for r in table.table.collect()}
        anew = {r["doc_id"]: r["gain"] for r in table.engine.gains().collect()}
        assert kept.keys() == anew.keys() and all(abs(kept[d][0] - anew[d]) < 1e-9 for d in anew)
        best = min(kept, key=lambda d: (-round(kept[d][0], 9), d))
        mine = [r for r in mixed(1, kinds) if r[0] == best]
        want = sum(r[1] in {m[1] for m in mine} for r in mixed(1, kinds))
        table.add([(best, kept[best][1])])
        assert table.touched([best]).count() == want       # a round joins the rows of the pick's cells and no others
        table.engine.select(best, kept[best][1])
    table.release()


@pytest.mark.parametrize("batch", [2, 50])
def test_lazy_rounds_by_part(spark, batch):
    cells = spark.createDataFrame(mixed(2, (MAX, INFLUENCE), 24), SCHEMA)
    got = {}
    for r in greedi_first(cells, 4, 3, cache="persist", batch=batch).collect():
        got.setdefault(r["part"], []).append((r["rank"], r["doc_id"], round(r["gain"], 9)))
    for p in range(1, 3):
        mine = cells.filter(part_of(F.col("doc_id"), 3) == p)
        want = [(r["rank"], r["doc_id"], round(r["gain"], 9)) for r in greedy_select(mine, 4, cache="persist").collect()]
        assert got.get(p, []) == want


@pytest.mark.parametrize("batch", [2, 50])
def test_lazy_rounds_to_the_last_document(spark, batch):
    cells = spark.createDataFrame(mixed(4, (MAX, SQRT_COUNT), 9), SCHEMA)
    whole = [r["doc_id"] for r in greedy_select(cells, 60, cache="persist").collect()]
    assert len(whole) == 9
    assert [r["doc_id"] for r in lazy_greedy_select(cells, 60, batch=batch, cache="persist").collect()] == whole


def test_lazy_rounds_refuse_growing_gains(spark):
    with pytest.raises(ValueError):
        LazyRounds(spark.createDataFrame(mixed(3, (EXACTLY_ONE,)), SCHEMA), 4, cache="persist")
    assert lazy_greedy_select(spark.createDataFrame([], SCHEMA), 3, cache="persist").count() == 0
    assert greedi_first(spark.createDataFrame([], SCHEMA), 3, 2, cache="persist").count() == 0
