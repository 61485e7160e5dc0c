"""Operator 1: main text of web pages by union-free wrapper inference.

Pages of a host are read as streams of tags and texts.  A wrapper is a
union-free regular expression over such streams: elements in order, each one
plain, optional ``(...)?`` or repeated ``(...)+``, with text slots.  A page's stream
is first folded (neighbouring stretches of equal form become one repeated
group), then aligned with the wrapper: matched elements are aligned inside,
elements that only one side has become optional, texts that differ become
slots.  Per slot the wrapper keeps how many pages fill it, its characters,
its characters inside links and whether the text ever differs.

A host's slots are then sorted into article and rest: by what their elements
say (navigation, footers, asides, forms, words of class, id and role such as
``ad`` or ``comments``), by the innermost article or main element if a host has
one, and else by where most text without links that differs between pages
lies.  A page's text is that of its article slots in page order.

Wrappers are built in each task over its own pages (no page is shuffled),
then merged per host in two levels, so a host with a third of all pages costs
a partial wrapper per task.  The table of slots is broadcast only below
``BROADCAST_BYTES``; beyond, pages are joined to it by host.

Defined results: a null or empty page has an empty text and 0 characters; a
page without url belongs to the host ''; a page that fills no article slot of
its host is sorted by its own slots; repeated rows get equal results; an empty
table gives an empty table; only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, staged

BROADCAST_BYTES = 32 << 20
SALTS = 32
LONGEST_PERIOD = 4      # elements of a repeated group
LINKED = 0.5            # share of link characters above which a slot is a list of links
CONSTANT_PAGES = 3      # pages after which an unchanged text outside articles is the template's

# Element names by their meaning in HTML
RAW = "script style textarea title iframe noscript xmp noembed template svg math object canvas".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
             "strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
               "main menu nav ol p pre section table ul".split())
SAME_LEVEL = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
              "option": ("select",)}
DROPPED = set("nav footer aside form button select option input dialog menu head fieldset legend datalist".split())
REST_WORDS = set("""ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted nav navbar
navigation menu menubar breadcrumb breadcrumbs sidebar side aside widget widgets footer masthead cookie cookies consent gdpr notice
notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended
recommendations comment comments reply replies respond disqus pagination pager toolbar skip copyright legal disclaimer contentinfo
complementary""".split())
COMMENT_WORDS = {"comment", "comments", "reply", "replies", "respond", "disqus"}
MAIN_WORDS = set("article articlebody post entry story main maincontent postcontent content body text".split())

MARKS, RESTS = "-!+~*", "-!"

TOKENS = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?P<rawattrs>[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)"
                    r"|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
                    r"|<[!?/][^>]*>|(?P<text>[^<]+|<)", re.S | re.I)
ATTR = re.compile(r"""\b(class|id|role|hidden|itemprop|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def element(tag: str, attrs: str) -> str:
    """Form of an element: a mark (``-`` rest, ``!`` rest unless it holds most of the text, ``+`` article,
    ``~`` header, ``*`` likely article), its name, its class words."""
    if not attrs or attrs.isspace():
        words: set[str] = set()
        hidden = False
    else:
        found = [(m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or "") for m in ATTR.finditer(attrs)]
        hidden = any(k == "hidden" or k == "style" and "display:none" in v.replace(" ", "") or k == "aria-hidden" and v == "true"
                     for k, v in found)
        words = {w.lower() for k, v in found if k in ("class", "id", "role", "itemprop") for w in WORDS.findall(v)}
    if hidden or tag in DROPPED and tag != "form":
        mark = "-"
    elif tag in ("article", "main"):
        mark = "-" if words & COMMENT_WORDS else "+"
    elif tag in ("html", "body"):
        mark = ""
    elif tag == "form" or words & REST_WORDS:
        mark = "!"
    elif tag == "header" or words & {"header", "banner"}:
        mark = "~"
    elif tag in ("div", "section", "td") and words & MAIN_WORDS:
        mark = "*"
    else:
        mark = ""
    return f"{mark}{tag}{'.' + '.'.join(sorted(words)) if words else ''}"


def mark_of(form: str) -> str:
    return form[0] if form[0] in MARKS else " "


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], str, int]]:
    """``(path, text, link characters)`` of each block of text in page order."""
    stack: list[tuple[str, str]] = []
    forms: dict[tuple[str, str], str] = {}
    parts: list[str] = []
    links, in_link = 0, 0
    at = 0

    def flush():
        nonlocal links
        if not parts:
            return None
        text = " ".join("".join(parts).split())
        parts.clear()
        n, links = links, 0
        return (tuple(f for t, f in stack if t not in INLINE or mark_of(f) in RESTS), text, min(n, len(text))) if text else None

    for m in TOKENS.finditer(page):
        text = m["text"]
        if text is not None:
            if text.strip() or parts:
                parts.append(entities.unescape(text) if "&" in text else text)
                if in_link:
                    links += len(text)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        block = tag not in INLINE
        if m["close"]:
            if block and (b := flush()):
                yield b
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None and (block or not any(t not in INLINE for t, _ in stack[depth + 1:])):
                if not block and mark_of(stack[depth][1]) in RESTS and (b := flush()):
                    yield b
                del stack[depth:]
            if tag == "a":
                in_link = max(0, in_link - 1)
            continue
        key = (tag, m["attrs"])
        form = forms.get(key)
        if form is None:
            form = forms[key] = element(*key)
        if block or mark_of(form) in RESTS:
            if b := flush():
                yield b
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), None)
            if k is not None and not any(t in ("td", "th", "button", "table") for t, _ in stack[k:]):
                del stack[k:]
                in_link = sum(t == "a" for t, _ in stack)
        if tag in SAME_LEVEL:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in SAME_LEVEL[tag]:
                    break
                if stack[i][0] == tag or tag in ("dt", "dd") and stack[i][0] in ("dt", "dd") or tag in ("td", "th", "tr") and stack[i][0] in ("td", "th"):
                    del stack[i:]
                    break
        if tag == "a":
            in_link += 1
        stack.append((tag, form))
        at += 1
    if b := flush():
        yield b


# ---------------------------------------------------------------- wrappers
# A node is [form, kind, children]: kind "" once, "?" optional, "+" repeated, "*" both;
# form "#" is a text slot, form "()" a group of neighbours.

def tree(rows: list[tuple[tuple[str, ...], str, int]]) -> list:
    """The folded element tree of a page's blocks."""
    root: list = []
    open_: list[list] = []
    for path, _, _ in rows:
        same = 0
        while same < min(len(path), len(open_)) and open_[same][0] == path[same]:
            same += 1
        if same == len(path) and same == len(open_) and same:
            same -= 1                                     # a new block of the same form
        del open_[same:]
        for form in path[same:]:
            node = [form, "", []]
            (open_[-1][2] if open_ else root).append(node)
            open_.append(node)
        (open_[-1][2] if open_ else root).append(["#", "", []])
    return folded(root)


def key(node: list) -> str:
    return node[0] if node[0] != "()" else "(" + " ".join(key(c) for c in node[2]) + ")"


def both(a: str, b: str) -> str:
    loop, gap = "+" in (a + b) or "*" in (a + b), "?" in (a + b) or "*" in (a + b)
    return "*" if loop and gap else "+" if loop else "?" if gap else ""


def folded(nodes: list) -> list:
    """Neighbouring stretches of equal form become one repeated element or group."""
    nodes = [[f, k, folded(c)] for f, k, c in nodes]
    for period in range(1, LONGEST_PERIOD + 1):
        out: list = []
        i = 0
        keys = [key(n) for n in nodes]
        while i < len(nodes):
            j = i + period
            while keys[i:i + period] == keys[j:j + period] and j + period <= len(nodes):
                j += period
            if j == i + period:
                out.append(nodes[i])
                i += 1
                continue
            merged = nodes[i:i + period]
            for k in range(i + period, j, period):
                merged = [join(x, y) for x, y in zip(merged, nodes[k:k + period])]
            out.append([merged[0][0], both(merged[0][1], "+"), merged[0][2]] if period == 1 else ["()", "+", merged])
            i = j
        nodes = out
    return nodes


def join(a: list, b: list) -> list:
    return [a[0], both(a[1], b[1]), aligned(a[2], b[2])]


def aligned(a: list, b: list) -> list:
    """Alignment of two element lists along a longest common subsequence of
    forms; what only one of them has becomes optional."""
    if a == b:
        return a
    x, y = [key(n) for n in a], [key(n) for n in b]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append(join(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], both(a[i][1], "?"), a[i][2]])
            i += 1
        else:
            out.append([b[j][0], both(b[j][1], "?"), b[j][2]])
            j += 1
    return folded(out) if len(out) > max(len(a), len(b)) else out


def expression(nodes: list) -> str:
    """The wrapper as a regular expression."""
    text = []
    for form, kind, inner in nodes:
        body = "#text" if form == "#" else expression(inner) if form == "()" else f"<{form}>{expression(inner)}</>"
        text.append(f"({body}){kind}" if kind else body)
    return " ".join(text)


class Wrapper:
    """Element tree of a host's pages and, per slot, [pages, characters, link characters, text or None if it differs]."""

    def __init__(self, nodes: list | None = None, slots: dict | None = None):
        self.nodes, self.slots, self.known = nodes, slots or {}, set()

    def add_page(self, rows: list[tuple[tuple[str, ...], str, int]]) -> None:
        shape = tuple(path for path, _, _ in rows)
        if hash(shape) not in self.known:                 # pages of a known form change no element
            self.known.add(hash(shape))
            nodes = tree(rows)
            self.nodes = nodes if self.nodes is None else aligned(self.nodes, nodes)
        mine: dict[tuple[str, ...], list] = {}
        for path, text, links in rows:
            s = mine.setdefault(path, [1, 0, 0, text])
            s[1] += len(text)
            s[2] += links
            if s[3] != text:
                s[3] = None
        self._pool(mine)

    def add(self, other: "Wrapper") -> None:
        self.nodes = other.nodes if self.nodes is None else aligned(self.nodes, other.nodes)
        self._pool(other.slots)

    def _pool(self, slots: dict) -> None:
        for path, s in slots.items():
            was = self.slots.get(path)
            self.slots[path] = s if was is None else [was[0] + s[0], was[1] + s[1], was[2] + s[2], s[3] if s[3] == was[3] else None]

    def dumps(self) -> str:
        return json.dumps([self.nodes, [[list(p), s] for p, s in sorted(self.slots.items())]])

    @classmethod
    def loads(cls, text: str) -> "Wrapper":
        nodes, slots = json.loads(text)
        return cls(nodes, {tuple(p): s for p, s in slots})


def article_slots(slots: dict[tuple[str, ...], list]) -> set[tuple[str, ...]]:
    """The paths whose texts are the article."""
    marked = {path: [mark_of(f) for f in path] for path in slots}
    below: dict[tuple[str, ...], int] = {}               # unlinked text of each box that is not the template's
    for path, s in slots.items():
        if "-" not in marked[path] and not (s[3] is not None and s[0] >= CONSTANT_PAGES):
            for i in range(len(path) + 1):
                below[path[:i]] = below.get(path[:i], 0) + s[1] - s[2]

    def rest(path: tuple[str, ...], inside: int, any_box: bool) -> bool:
        """Whether an element on the path takes it out of the article; a box of most text or, if
        nothing else is left, one around an article element does not, comments only around one."""
        for i, m in enumerate(marked[path]):
            if m == "-":
                return True
            if m == "!" or m == "~" and i < inside:
                around = i < inside < len(path)
                most = 2 * below.get(path[:i + 1], 0) > below.get((), 0)
                talk = not COMMENT_WORDS.isdisjoint(path[i].split(".")[1:])
                if not (most and (around or not talk) or any_box and around):
                    return True
        return False

    ranked: dict[tuple[str, ...], int] = {}
    for any_box in (False, True):
        if ranked:
            break
        for path in slots:
            marks = marked[path]
            inside = next((i for i, m in enumerate(marks) if m == "+"), len(marks))
            if not rest(path, inside, any_box):
                names = [f.lstrip(MARKS).split(".")[0] for f in path]
                ranked[path] = 3 if "article" in names else 2 if "+" in marks else 1 if "*" in marks else 0
    top = max(ranked.values(), default=0)
    if top >= 2:
        return {p for p, r in ranked.items() if r == top}
    open_ = {p: s for p, s in slots.items() if p in ranked and s[2] <= LINKED * s[1]
             and not (s[3] is not None and s[0] >= CONSTANT_PAGES)}
    if top == 1 and any(ranked[p] == 1 for p in open_):
        open_ = {p: s for p, s in open_.items() if ranked[p] == 1}
    if not open_:
        return set(ranked)
    held: dict[tuple[str, ...], int] = {}
    for p, s in open_.items():
        for i in range(len(p) + 1):
            held[p[:i]] = held.get(p[:i], 0) + s[1]
    total = held[()]
    box = max((p for p, n in held.items() if 2 * n > total and any(p == q[:len(p)] and len(q) > len(p) for q in open_) or not p),
              key=lambda p: (len(p), held[p], p))
    return {p for p in open_ if p[:len(box)] == box}


def main_text(rows: list[tuple[tuple[str, ...], str, int]], article: set[tuple[str, ...]]) -> str:
    text = " ".join(t for p, t, _ in rows if p in article)
    if text or not rows:
        return text
    alone = Wrapper()
    alone.add_page(rows)
    own = article_slots(alone.slots)
    return " ".join(t for p, t, _ in rows if p in own)


# ---------------------------------------------------------------- Spark

def _partial(batches):
    found: dict[str, Wrapper] = {}
    for batch in batches:
        for host, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist()):
            rows = list(blocks(page or ""))
            if rows:
                found.setdefault(host, Wrapper()).add_page(rows)
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([w.dumps() for w in found.values()], pa.string())], ["host", "wrapper"])


def _pooled(texts) -> Wrapper:
    whole = Wrapper()
    for text in sorted(texts):
        whole.add(Wrapper.loads(text))
    return whole


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [_pooled(pdf["wrapper"]).dumps()]})


def _finish(pdf: pd.DataFrame) -> pd.DataFrame:
    whole = _pooled(pdf["wrapper"])
    paths = sorted(article_slots(whole.slots))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [expression(whole.nodes)], "article": [json.dumps(paths)]})


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))


def wrappers(pages: DataFrame) -> DataFrame:
    """``(host, wrapper, article)``: each host's regular expression and its article slots."""
    arrow_batches(pages.sparkSession)
    parts = with_host(pages).select("host", "html").mapInArrow(_partial, "host string, wrapper string")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    merged = salted.groupBy("host", "salt").applyInPandas(_merge, "host string, wrapper string")
    return merged.groupBy("host").applyInPandas(_finish, "host string, wrapper string, article string")


def _extract(batches):
    known: dict[str, set] = {}
    for batch in batches:
        out = []
        for page, article in zip(batch["html"].to_pylist(), batch["article"].to_pylist()):
            if article not in known:
                if len(known) > 1000:
                    known.clear()
                known[article] = {tuple(p) for p in json.loads(article or "[]")}
            out.append(main_text(list(blocks(page or "")), known[article]))
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
                                         ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row of ``pages(page_id, url, html)``."""
    slots = staged(wrappers(pages).select("host", "article"))
    size = slots.agg(F.sum(F.octet_length("host") + F.octet_length("article"))).first()[0] or 0
    joined = with_host(pages).join(F.broadcast(slots) if size <= BROADCAST_BYTES else slots, "host", "left")
    return joined.select("page_id", "url", "html", "article").mapInArrow(
        _extract, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars bigint")
