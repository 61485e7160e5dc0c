"""DuckDB SQL for every registered query (the correctness oracle).

Built from CTE snippets that mirror the Spark definitions one to one.  The
tables (documents, events, ...) are the driver's pre-registered views.
Doubles are rounded to 6 places on both sides; greedy rounds rank by
``round(gain, 9) DESC, doc_id``.
"""

from __future__ import annotations

from ..functions.text import ENGLISH_STOP_WORDS

STOP_LIST = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ------------------------------------------------------------------ text

TOKS = f"""toks AS (
  SELECT doc_id, term FROM (
    SELECT doc_id, lang, unnest(regexp_extract_all(
      CASE WHEN lang = 'en' THEN regexp_replace(lower(text), '[''’]s([^\\p{{L}}\\p{{N}}]|$)', '\\1', 'g') ELSE lower(text) END,
      '[\\p{{L}}\\p{{N}}]+', 0)) AS term
    FROM documents) t
  WHERE NOT (lang = 'en' AND term IN ({STOP_LIST})))"""
TF = "tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY doc_id, term)"
WS = "ws AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS wc FROM tf GROUP BY term)"
ND = "nd AS (SELECT count(*) AS n FROM documents)"
SIG = "sig AS (SELECT sqrt(avg(CAST(df AS DOUBLE) * df)) AS s FROM ws)"
KEPT = "kept AS (SELECT ws.term, ws.df, ws.wc FROM ws, sig WHERE ws.wc >= 6 AND ws.df >= 3 AND ws.df <= 3.0 * sig.s)"
RAW = """raw AS (SELECT tf.doc_id, tf.term, sqrt(CAST(tf.tf AS DOUBLE)) * (1 + ln(nd.n / (kept.df + 1.0))) AS w
  FROM tf JOIN kept ON tf.term = kept.term, nd)"""
POSTINGS = "postings AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"
CORPUS = [TOKS, TF, WS, ND, SIG, KEPT, RAW, POSTINGS]

F1_CELLS = """cells AS (SELECT doc_id, term AS cell, 'max' AS kind,
  1.0 / (SELECT count(*) FROM kept) AS theta, weight AS value FROM postings)"""


def weighted_cells(count_col: str = "df", how: str = "sqrt", value: str = "weight", src: str = "postings",
                   name: str = "cells") -> list[str]:
    g = f"sqrt(CAST({count_col} AS DOUBLE))" if how == "sqrt" else f"ln(CAST({count_col} AS DOUBLE))"
    return [f"tw_{name} AS (SELECT term, {g} / (SELECT sum({g}) FROM kept) AS tw FROM kept)",
            f"""{name} AS (SELECT p.doc_id, p.term AS cell, 'max' AS kind, t.tw AS theta, {value} AS value
  FROM {src} p JOIN tw_{name} t ON p.term = t.term)"""]


# ---------------------------------------------------------------- greedy

CONTRIB = """CASE c.kind
      WHEN 'max' THEN c.theta * greatest(0.0, c.value - greatest(0.0, coalesce(v.cmax, 0.0)))
      WHEN 'sqrt_count' THEN c.theta * (sqrt(coalesce(v.ccnt, 0) + 1.0) - sqrt(coalesce(v.ccnt, 0) + 0.0))
      WHEN 'exactly_one' THEN c.theta * (CASE coalesce(v.ccnt, 0) WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0.0 END)
      ELSE 0.0 END"""


def greedy_ctes(k: int, cells: str = "cells", prefix: str = "g", grouped: bool = False) -> list[str]:
    """k unrolled rounds; with ``grouped`` the cells carry a ``part`` column
    (a function of doc_id) and every part picks one doc per round."""
    ctes = []
    part = "c.part, " if grouped else ""
    for r in range(1, k + 1):
        prev = " UNION ALL ".join(f"SELECT doc_id FROM {prefix}{j}" for j in range(1, r))
        if r == 1:
            contrib = CONTRIB.replace("v.cmax", "NULL").replace("v.ccnt", "NULL")
            gains = f"SELECT {part}c.doc_id, sum({contrib}) AS gain FROM {cells} c GROUP BY {part}c.doc_id"
        else:
            xp = "x.part, " if grouped else ""
            on_part = "AND c.part = v.part " if grouped else ""
            cover = (f"SELECT {xp}x.cell, max(x.value) AS cmax, count(*) AS ccnt FROM {cells} x "
                     f"WHERE x.doc_id IN ({prev}) GROUP BY {xp}x.cell")
            gains = (f"SELECT {part}c.doc_id, sum({CONTRIB}) AS gain FROM {cells} c LEFT JOIN ({cover}) v "
                     f"ON c.cell = v.cell {on_part}WHERE c.doc_id NOT IN ({prev}) GROUP BY {part}c.doc_id")
        if grouped:
            pick = (f"SELECT part, doc_id, gain, {r} AS r FROM (SELECT *, row_number() OVER (PARTITION BY part "
                    f"ORDER BY round(gain, 9) DESC, doc_id) AS rn FROM ({gains}) q) q2 WHERE rn = 1")
        else:
            pick = f"SELECT doc_id, gain, {r} AS r FROM ({gains}) q ORDER BY round(gain, 9) DESC, doc_id LIMIT 1"
        ctes.append(f"{prefix}{r} AS ({pick})")
    union = " UNION ALL ".join(f"SELECT * FROM {prefix}{j}" for j in range(1, k + 1))
    ctes.append(f"{prefix}_all AS ({union})")
    return ctes


def selection_select(prefix: str = "g", grouped: bool = False) -> str:
    if grouped:
        return (f"SELECT part, CAST(r AS INTEGER) AS rank, doc_id, round(gain, 6) AS gain, "
                f"round(sum(gain) OVER (PARTITION BY part ORDER BY r), 6) AS score FROM {prefix}_all")
    return (f"SELECT CAST(r AS INTEGER) AS rank, doc_id, round(gain, 6) AS gain, "
            f"round(sum(gain) OVER (ORDER BY r), 6) AS score FROM {prefix}_all")


def greedy_query(cell_ctes: list[str], k: int, cells: str = "cells") -> str:
    return with_(*cell_ctes, *greedy_ctes(k, cells)) + selection_select()


def part_of(p: int) -> str:
    """Part of a document, as ``operators.greedi.part_of``."""
    m = (1 << 31) - 1
    return f"CAST((((((doc_id % {m}) + {m}) % {m}) * 48271 % {m}) // 65536) % {p} AS INTEGER)"


def greedi_query(cell_ctes: list[str], k: int, p: int, cells: str = "cells") -> str:
    """G3 + G4: k rounds per part, then k rounds over the winners."""
    parted = f"pc AS (SELECT *, {part_of(p)} AS part FROM {cells})"
    second = f"sc AS (SELECT * FROM {cells} WHERE doc_id IN (SELECT doc_id FROM f_all))"
    return with_(*cell_ctes, parted, *greedy_ctes(k, "pc", "f", grouped=True), second,
                 *greedy_ctes(k, "sc", "g")) + selection_select()


def score_sql(cells: str, selected: str) -> str:
    """Scalar f(S) for ``selected`` (a query returning doc_id)."""
    return f"""(SELECT coalesce(sum(CASE kind
        WHEN 'max' THEN theta * greatest(0.0, vmax)
        WHEN 'sqrt_count' THEN theta * sqrt(cnt + 0.0)
        WHEN 'exactly_one' THEN CASE WHEN cnt = 1 THEN theta ELSE 0.0 END ELSE 0.0 END), 0.0)
      FROM (SELECT cell, kind, max(theta) AS theta, max(value) AS vmax, count(*) AS cnt
            FROM {cells} WHERE doc_id IN ({selected}) GROUP BY cell, kind) s)"""


# ------------------------------------------------------- random selections

def random_sets(candidates: str, k: int, trials: int = 10, seed: str = "corpuslens", name: str = "rs") -> str:
    """``name(trial, rank, doc_id)`` from a query returning doc_id."""
    return f"""{name} AS (SELECT CAST(trial AS INTEGER) AS trial, CAST(rank AS INTEGER) AS rank, doc_id FROM (
  SELECT t.trial, d.doc_id, row_number() OVER (PARTITION BY t.trial ORDER BY
    md5('{seed}' || ':' || CAST(t.trial AS VARCHAR) || ':' || CAST(d.doc_id AS VARCHAR)), d.doc_id) AS rank
  FROM (SELECT DISTINCT doc_id FROM ({candidates}) c0) d, (SELECT range AS trial FROM range(0, {trials})) t) q
  WHERE rank <= {k})"""


def score_sets(cells: str, sets: str = "rs", set_col: str = "trial", extra: str = "", digits: int | None = 6) -> str:
    """``SELECT set_col, score`` of every set under ``cells``."""
    sc = f"round(coalesce(s.score, 0.0), {digits})" if digits is not None else "coalesce(s.score, 0.0)"
    return f"""SELECT {extra}t.{set_col}, {sc} AS score
FROM (SELECT DISTINCT {set_col} FROM {sets}) t LEFT JOIN (
  SELECT {set_col}, sum(CASE kind
        WHEN 'max' THEN theta * greatest(0.0, vmax)
        WHEN 'sqrt_count' THEN theta * sqrt(cnt + 0.0)
        WHEN 'exactly_one' THEN CASE WHEN cnt = 1 THEN theta ELSE 0.0 END ELSE 0.0 END) AS score
  FROM (SELECT r.{set_col}, c.cell, c.kind, max(c.theta) AS theta, max(c.value) AS vmax, count(*) AS cnt
        FROM {cells} c JOIN (SELECT DISTINCT {set_col}, doc_id FROM {sets}) r ON c.doc_id = r.doc_id
        GROUP BY r.{set_col}, c.cell, c.kind) x
  GROUP BY {set_col}) s ON t.{set_col} = s.{set_col}"""


# ------------------------------------------------------------- inputs

EDGES = "edges AS (SELECT user_id AS doc_id, event_id AS src_id FROM events)"
ADJ = "adj AS (SELECT DISTINCT doc_id, src_id FROM edges)"
LINES = "lines AS (SELECT l_suppkey AS src, l_partkey + 1000000 AS dst FROM lineitem)"
UND = "und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM lines WHERE src <> dst)"
REV = """rev AS (SELECT o_custkey AS doc_id, count(*) AS rev_count,
  CAST(floor(sum(o_totalprice)) AS BIGINT) AS rev_volume FROM orders GROUP BY o_custkey)"""
CATLINKS = """category_links AS (
  SELECT r.r_name AS parent, n.n_name AS child FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  UNION ALL
  SELECT DISTINCT n.n_name, n.n_name || '/' || c.c_mktsegment FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)"""
PAGECATS = """page_categories AS (
  SELECT c.c_custkey AS doc_id, n.n_name AS category FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  UNION ALL
  SELECT c.c_custkey, n.n_name || '/' || c.c_mktsegment FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)"""
DATES = "dates AS (SELECT doc_id, CAST((((doc_id // 100) % 100) + 100) % 100 AS INTEGER) AS period FROM documents)"

GRAPH_CELLS = """gcells AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS cell, 'max' AS kind, 1.0 AS theta, 1.0 AS value FROM (SELECT doc_id FROM adj UNION SELECT doc_id FROM documents) o
  UNION ALL
  SELECT doc_id, CAST(src_id AS VARCHAR), 'max', 1.0, 1.0 FROM adj)"""
CUT_CELLS = """ccells AS (
  SELECT a AS doc_id, CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) AS cell, 'exactly_one' AS kind, 1.0 AS theta, 1.0 AS value FROM und
  UNION ALL
  SELECT b, CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR), 'exactly_one', 1.0, 1.0 FROM und)"""
REV_CELLS = """rcells AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS cell, 'max' AS kind,
  1.0 / (SELECT sum(rev_count) FROM rev) AS theta, CAST(rev_count AS DOUBLE) AS value FROM rev)"""


def boost_cte(name: str = "boost", inl: bool = True, cnt: bool = True, vol: bool = True) -> str:
    f = ["1.0"]
    if inl:
        f.append("(1.0 + coalesce(CAST(i.inlinks AS DOUBLE), 0.0))")
    if cnt:
        f.append("(1.0 + coalesce(CAST(r.rev_count AS DOUBLE), 0.0))")
    if vol:
        f.append("(CASE WHEN r.rev_volume > 0 THEN 1.0 + ln(CAST(r.rev_volume AS DOUBLE)) ELSE 1.0 END)")
    return f"""{name} AS (SELECT d.doc_id, {' * '.join(f)} AS boost
  FROM (SELECT DISTINCT doc_id FROM documents) d
  LEFT JOIN (SELECT doc_id, count(*) AS inlinks FROM adj GROUP BY doc_id) i ON d.doc_id = i.doc_id
  LEFT JOIN rev r ON d.doc_id = r.doc_id)"""


BOOSTED_POSTINGS = """bpost AS (SELECT p.doc_id, p.term, p.weight * coalesce(b.boost, 1.0) AS weight
  FROM postings p LEFT JOIN boost b ON p.doc_id = b.doc_id)"""


# ------------------------------------------------------------------ lsh

def lsh_ctes(bands: int, rows: int, seed: str) -> list[str]:
    n = bands * rows
    return [
        f"""basis AS (SELECT r.row, k.term,
  CASE WHEN substr(md5('{seed}' || ':' || CAST(r.row AS VARCHAR) || ':' || k.term), 32, 1) < '8' THEN 1.0 ELSE -1.0 END AS sign
  FROM kept k, (SELECT CAST(range AS INTEGER) AS row FROM range(0, {n})) r)""",
        """lsig AS (SELECT p.doc_id, b.row, CASE WHEN sum(b.sign * p.weight) > 0 THEN 1 ELSE 0 END AS bit
  FROM postings p JOIN basis b ON p.term = b.term GROUP BY p.doc_id, b.row)""",
        f"""buckets AS (SELECT CAST(row // {rows} AS INTEGER) AS band, CAST(sum(bit << (row % {rows})) AS BIGINT) AS bucket, doc_id
  FROM lsig GROUP BY doc_id, row // {rows})""",
    ]


EARLIER = "(y.period < x.period OR (y.period = x.period AND y.doc_id < x.doc_id))"
NEIGHBORS_LSH = [
    "bd AS (SELECT b.band, b.bucket, b.doc_id, d.period FROM buckets b JOIN dates d ON b.doc_id = d.doc_id)",
    """pb AS (SELECT b.band, b.bucket, p.term, p.doc_id, p.weight, b.period
  FROM postings p JOIN bd b ON p.doc_id = b.doc_id)""",
    """ndots AS (SELECT x.doc_id, y.doc_id AS neighbor_id, sum(x.weight * y.weight) AS dot
  FROM pb x JOIN pb y ON x.band = y.band AND x.bucket = y.bucket AND x.term = y.term
  WHERE """ + EARLIER + """ GROUP BY x.doc_id, y.doc_id, x.band)""",
    """nfb AS (SELECT x.doc_id, min(y.doc_id) AS neighbor_id FROM bd x JOIN bd y
  ON x.band = y.band AND x.bucket = y.bucket AND """ + EARLIER + " GROUP BY x.doc_id)",
    """ncand AS (SELECT doc_id, neighbor_id, max(dot) AS dot FROM (
  SELECT doc_id, neighbor_id, dot FROM ndots UNION ALL SELECT doc_id, neighbor_id, 0.0 FROM nfb) q GROUP BY doc_id, neighbor_id)""",
    """nbr AS (SELECT doc_id, neighbor_id, dot FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
  ORDER BY round(dot, 9) DESC, neighbor_id) AS rn FROM ncand) q WHERE rn = 1)""",
]
NEIGHBORS_EXACT = [
    "pd AS (SELECT p.term, p.doc_id, p.weight, d.period FROM postings p JOIN dates d ON p.doc_id = d.doc_id)",
    """xdots AS (SELECT x.doc_id, y.doc_id AS neighbor_id, sum(x.weight * y.weight) AS dot
  FROM pd x JOIN pd y ON x.term = y.term WHERE """ + EARLIER + " GROUP BY x.doc_id, y.doc_id)",
    "xd AS (SELECT DISTINCT d.doc_id, d.period FROM dates d JOIN postings p ON d.doc_id = p.doc_id)",
    "xfb AS (SELECT x.doc_id, min(y.doc_id) AS neighbor_id FROM xd x JOIN xd y ON " + EARLIER + " GROUP BY x.doc_id)",
    """xcand AS (SELECT doc_id, neighbor_id, max(dot) AS dot FROM (
  SELECT doc_id, neighbor_id, dot FROM xdots UNION ALL SELECT doc_id, neighbor_id, 0.0 FROM xfb) q GROUP BY doc_id, neighbor_id)""",
    """xnbr AS (SELECT doc_id, neighbor_id, dot FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
  ORDER BY round(dot, 9) DESC, neighbor_id) AS rn FROM xcand) q WHERE rn = 1)""",
]


def novelty_cte(nbr: str = "nbr", name: str = "nov", inner: bool = False) -> str:
    j = "JOIN" if inner else "LEFT JOIN"
    return f"""{name} AS (SELECT * FROM (SELECT p.doc_id, p.term, greatest(0.0, p.weight - coalesce(q.weight, 0.0)) AS weight
  FROM postings p {j} {nbr} n ON p.doc_id = n.doc_id LEFT JOIN postings q ON q.doc_id = n.neighbor_id AND q.term = p.term) z
  WHERE weight > 1e-9)"""


SPREAD = """spread AS (SELECT d.period, p.term, sum(p.weight) AS weight FROM postings p JOIN dates d ON p.doc_id = d.doc_id
  GROUP BY d.period, p.term)"""


def influence_cells(nov: str = "nov", name: str = "icells", strict: bool = False) -> str:
    op = ">" if strict else ">="
    return f"""{name} AS (SELECT n.doc_id, n.term || '@' || CAST(s.period AS VARCHAR) AS cell, 'max' AS kind,
  s.weight AS theta, n.weight AS value, s.period AS y
  FROM {nov} n JOIN dates d ON n.doc_id = d.doc_id JOIN spread s ON n.term = s.term AND s.period {op} d.period)"""


LSH_CELLS = """lcells AS (SELECT b.doc_id, CAST(b.band AS VARCHAR) || ':' || CAST(b.bucket AS VARCHAR) AS cell, 'sqrt_count' AS kind,
  sqrt(CAST(z.n AS DOUBLE)) / (SELECT count(*) FROM buckets) AS theta, 1.0 AS value
  FROM buckets b JOIN (SELECT band, bucket, count(*) AS n FROM buckets GROUP BY band, bucket) z ON b.band = z.band AND b.bucket = z.bucket)"""


def combine(parts: list[tuple[str, str, float]], name: str = "mcells") -> str:
    sel = " UNION ALL ".join(
        f"SELECT doc_id, '{label}|' || cell AS cell, kind, theta * {lam} AS theta, value FROM {cells}"
        for label, cells, lam in parts)
    return f"{name} AS ({sel})"


# ---------------------------------------------------------------- pages

def _strip_html(col: str) -> str:
    x = f"regexp_replace({col}, '(?s)<script[^>]*>.*?</script>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<style[^>]*>.*?</style>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    from ..functions.pages import HTML_ENTITIES
    for ent, ch in HTML_ENTITIES:
        x = "replace(" + x + ", '" + ent + "', '" + ch.replace("'", "''") + "')"
    return f"trim(regexp_replace({x}, '[ \\t\\r\\n]+', ' ', 'g'))"


def classified_pages() -> list[str]:
    from ..functions import pages as P
    pg = f"""pg AS (SELECT page_id AS doc_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
  {_strip_html('html')} AS content,
  regexp_matches(html, '{P.REDIRECT_PATTERN}') AS is_redirect,
  regexp_matches(html, '{P.DISAMBIG_PATTERN}') AS is_disambig,
  regexp_matches(html, '{P.STUB_PATTERN}') AS is_stub,
  regexp_matches(html, '{P.ARTICLE_PATTERN}') AS is_article FROM pages)"""
    is_list = " OR ".join(f"starts_with(title, '{p}')" for p in P.LIST_PREFIXES)
    ct = f"""cp AS (SELECT *, CASE
    WHEN is_redirect THEN 'REDIRECT'
    WHEN length(content) = 0 THEN 'EMPTY'
    WHEN is_disambig OR ends_with(title, '{P.DISAMBIGUATION_SUFFIX}') THEN 'DISAMBIGUATION'
    WHEN is_stub THEN 'STUB'
    WHEN is_article AND ({is_list}) THEN 'LIST'
    WHEN is_article AND length(title) > {P.TITLE_SHARE} * length(content) THEN 'OTHER'
    WHEN is_article THEN 'ARTICLE'
    ELSE 'NON_ARTICLE' END AS page_type FROM pg)"""
    return [pg, ct]


LUCENE_CELLS = """lucells AS (SELECT tf.doc_id, tf.term AS cell, 'max' AS kind, sqrt(CAST(ws.wc AS DOUBLE)) AS theta,
  sqrt(CAST(tf.tf AS DOUBLE)) * (1 + ln(nd.n / (ws.df + 1.0))) AS value FROM tf JOIN ws ON tf.term = ws.term, nd)"""
EMB_POSTINGS = """embp AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM (
  SELECT vec_id AS doc_id, CAST(pos - 1 AS VARCHAR) AS term, CAST(v AS DOUBLE) AS w
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) q
  WHERE abs(v) > 1e-5) z)"""


def pair_dots(src: str, name: str) -> str:
    return f"""{name} AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, sum(a.weight * b.weight) AS dot
  FROM {src} a JOIN {src} b ON a.term = b.term WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id)"""
