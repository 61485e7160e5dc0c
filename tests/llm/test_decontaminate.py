import hashlib
import re

from corpuslens.llm import decontaminate as D
from corpuslens.llm import queries

from llm_cases import prose, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(0, len(w) - min(window, len(w)) + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + window]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k:k + n]))):
                    hit.update(range(k, k + n))
                    found |= x
        ids = ",".join(sorted(found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, *names):
    return [[tuple(r) for r in spark.read.parquet(f"{names[0]}/{n}.parquet").select(*c).collect()] for n, c in names[1:]]


def test_query_equals_brute_force(spark, sf_dir):
    docs, items = table(spark, sf_dir, ("documents", ("doc_id", "text")), ("benchmark", ("item_id", "text")))
    assert listed(queries.QUERIES["op7_benchmark_decontamination"](spark, sf_dir)) == brute(docs, items)


def test_edge_cases_short_items_and_blocks(spark, edge, nothing):
    items = [(1, prose(1, 120)[40:300]), (2, "ONE"), (3, None), (4, ""), (5, "über ñandú"), (6, prose(2, 12)), (6, prose(2, 12)), (7, prose(99, 15))]
    table_ = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, matches string")
    want = brute([(r[0], r[1]) for r in rows()], [i for i in items if i[1]])
    assert listed(D.digest(D.benchmark_matches(edge, table_))) == want
    assert listed(D.digest(D.benchmark_matches(edge, table_, block_bytes=100))) == want
    clean = D.drop_contaminated(edge, table_)
    assert clean.columns == edge.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(w[0]) for w in want if not w[5])
    assert D.digest(D.benchmark_matches(nothing, table_)).count() == 0
    none = D.digest(D.benchmark_matches(edge, table_.limit(0))).collect()
    assert len(none) == len(rows()) and not any(r.contaminated for r in none)


def test_longest_matches_and_places(spark):
    passage = prose(5, 30)
    docs = spark.createDataFrame([(1, "start here " + passage + " end"), (2, passage + " " + passage)], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, "before " + passage)], "item_id bigint, text string")
    out = {r.doc_id: sorted((m.start, m.words, m.item_start) for m in r.matches) for r in D.benchmark_matches(docs, items).collect()}
    assert out == {1: [(2, 30, 1)], 2: [(0, 30, 1), (30, 30, 1)]}
