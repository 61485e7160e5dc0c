"""Page classification, markup stripping, dates and id rules.

All column expressions (JVM-side).  Regexes use only features shared by
Java and RE2 (no back-references, no look-around).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Page types, in the order the rules are tried.
REDIRECT, EMPTY, DISAMBIGUATION, STUB = "REDIRECT", "EMPTY", "DISAMBIGUATION", "STUB"
LIST, OTHER, ARTICLE, NON_ARTICLE = "LIST", "OTHER", "ARTICLE", "NON_ARTICLE"
# Title prefixes of list pages and the disambiguation suffix.
LIST_PREFIXES = ("List of", "List_of", "Glossary of", "Glossary_of")
DISAMBIGUATION_SUFFIX = "(disambiguation)"
# Fixed value: a page whose title is longer than this share of its content is OTHER.
TITLE_SHARE = 0.01

# Default flag rules for raw HTML pages (arguments of ``html_pages``).
REDIRECT_PATTERN = r'(?i)http-equiv="refresh"|#redirect'
DISAMBIG_PATTERN = r"(?i)may refer to:"
STUB_PATTERN = r'(?i)class="stub"'
ARTICLE_PATTERN = r"<article>"

# The HTML entities decoded by ``strip_html``.
HTML_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def strip_html(html: Column) -> Column:
    """Plain text of an HTML page: drop scripts, styles, comments and tags,
    decode the common entities, collapse white space."""
    x = F.regexp_replace(html, r"(?s)<script[^>]*>.*?</script>", " ")
    x = F.regexp_replace(x, r"(?s)<style[^>]*>.*?</style>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    for ent, ch in HTML_ENTITIES:
        x = F.replace(x, F.lit(ent), F.lit(ch))
    return F.trim(F.regexp_replace(x, r"[ \t\r\n]+", " "))


def template_depth(text: Column) -> Column:
    """How deep templates are nested in wiki markup."""
    signs = F.regexp_extract_all(text, F.lit(r"\{\{|\}\}"), F.lit(0))
    state = lambda now, most: F.struct(now.alias("now"), most.alias("most"))

    def step(a: Column, sign: Column) -> Column:
        now = F.greatest(F.lit(0), a["now"] + F.when(sign == "{{", F.lit(1)).otherwise(F.lit(-1)))
        return state(now, F.greatest(a["most"], now))
    return F.aggregate(signs, state(F.lit(0), F.lit(0)), step, lambda a: a["most"])


def strip_wikitext(text: Column) -> Column:
    """Plain text of wiki markup: templates (from the innermost outwards),
    refs, links, emphasis, headings."""
    x = F.regexp_replace(text, r"(?s)<ref[^>/]*/>|<ref[^>]*>.*?</ref>", " ")
    x = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), template_depth(x))), x,
                    lambda t, _: F.regexp_replace(t, r"\{\{[^{}]*\}\}", " "))
    x = F.regexp_replace(x, r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1")
    x = F.regexp_replace(x, r"\[https?://[^ \]]* ?([^\]]*)\]", "$1")
    x = F.regexp_replace(x, r"'{2,}", "")
    x = F.regexp_replace(x, r"={2,}", " ")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(x, r"[ \t\r\n]+", " "))


def html_pages(pages: DataFrame, redirect: str = REDIRECT_PATTERN, disambig: str = DISAMBIG_PATTERN,
               stub: str = STUB_PATTERN, article: str = ARTICLE_PATTERN) -> DataFrame:
    """Raw ``pages(page_id, url, html)`` -> ``(doc_id, title, content, flags...)``."""
    html = F.col("html")
    return pages.select(
        F.col("page_id").alias("doc_id"),
        F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1).alias("title"),
        strip_html(html).alias("content"),
        html.rlike(redirect).alias("is_redirect"),
        html.rlike(disambig).alias("is_disambig"),
        html.rlike(stub).alias("is_stub"),
        html.rlike(article).alias("is_article"))


def page_type(title: Column, content: Column, is_redirect: Column, is_disambig: Column,
              is_stub: Column, is_article: Column) -> Column:
    """B1: first matching rule wins."""
    is_list = F.lit(False)
    for p in LIST_PREFIXES:
        is_list = is_list | title.startswith(p)
    return (F.when(is_redirect, F.lit(REDIRECT))
            .when(F.length(content) == 0, F.lit(EMPTY))
            .when(is_disambig | title.endswith(DISAMBIGUATION_SUFFIX), F.lit(DISAMBIGUATION))
            .when(is_stub, F.lit(STUB))
            .when(is_article & is_list, F.lit(LIST))
            .when(is_article & (F.length(title) > F.lit(TITLE_SHARE) * F.length(content)), F.lit(OTHER))
            .when(is_article, F.lit(ARTICLE))
            .otherwise(F.lit(NON_ARTICLE)))


def classify_pages(pages: DataFrame) -> DataFrame:
    """B1 over a parsed pages table: adds ``page_type``."""
    return pages.withColumn("page_type", page_type(F.col("title"), F.col("content"), F.col("is_redirect"),
                                                   F.col("is_disambig"), F.col("is_stub"), F.col("is_article")))


def page_type_counts(classified: DataFrame) -> DataFrame:
    """B2: ``(page_type, pages)`` per type plus a TOTAL row."""
    per = classified.groupBy("page_type").agg(F.count(F.lit(1)).alias("pages"))
    total = classified.agg(F.count(F.lit(1)).alias("pages")).select(F.lit("TOTAL").alias("page_type"), "pages")
    return per.unionByName(total)


PAGE_TYPES = (REDIRECT, EMPTY, DISAMBIGUATION, STUB, LIST, OTHER, ARTICLE, NON_ARTICLE)


def write_classified(classified: DataFrame, path: str) -> dict[str, int]:
    """B1 + B2 in one pass: writes the classified pages as Parquet to ``path`` and returns
    the pages of each type (0 where none) and their ``TOTAL``."""
    from ..sources.files import write_counted
    return write_counted(classified, path, {t: F.col("page_type") == t for t in PAGE_TYPES})


def pages_to_text(classified: DataFrame) -> DataFrame:
    """ARTICLE pages only, as ``documents(doc_id, text)``."""
    return classified.filter(F.col("page_type") == ARTICLE).select("doc_id", F.col("content").alias("text"))


def articles_of_dump(dump: DataFrame, fmt: str | None = None) -> DataFrame:
    """B1 + B3 + B4 on a page table of ``read_wiki_dump``: ``(doc_id, text, period)`` of
    its ARTICLE pages; the period is null where the timestamp cannot be read."""
    pages = classify_pages(dump.withColumn("content", strip_wikitext(F.col("text"))))
    return pages.filter(F.col("page_type") == ARTICLE).select(
        "doc_id", F.col("content").alias("text"), document_date(F.col("ts"), fmt).alias("period"))


def document_date(ts: Column, fmt: str | None = None) -> Column:
    """``YEAR * 1000 + DAY_OF_YEAR`` (UTC); strings are parsed leniently
    and unparsable values give null (callers drop those rows)."""
    t = F.try_to_timestamp(ts, F.lit(fmt)) if fmt else ts.try_cast("timestamp")
    return (F.year(t) * 1000 + F.dayofyear(t)).cast("int")


def date_from_id(id_col: str, divisor: int = 10000, modulus: int = 100) -> Column:
    """``pmod(id div divisor, modulus)`` of the named column (integer
    division truncates, the modulus is made non-negative)."""
    return F.pmod(F.expr(f"`{id_col}` div {int(divisor)}"), F.lit(modulus)).cast("int")


def aan_key(name: Column) -> Column:
    """B6 (AAN): ``str(code(name[0]) % 100) || name[1:3] || name[4:8]`` as int."""
    return F.concat((F.ascii(name) % 100).cast("string"), F.substring(name, 2, 2), F.substring(name, 5, 4)).try_cast("bigint")


# The line prefix; the offsets in ``aan_key`` and ``nips_key`` follow the file names' format.
NIPS_PREFIX = "file is ../nipsdata/txt/"


def nips_key(line: Column) -> Column:
    """B6 (NIPS): after the prefix, ``int(s[4:6]) * 10000 + int(s[7:11])``."""
    s = F.substring(line, F.lit(len(NIPS_PREFIX) + 1), F.length(line))
    return (F.substring(s, 5, 2).try_cast("bigint") * 10000 + F.substring(s, 8, 4).try_cast("bigint"))


def partition_of(doc_id: Column, partitions: int) -> Column:
    """``pmod(id, p)`` (safe for negative ids)."""
    return F.pmod(doc_id, F.lit(partitions)).cast("int")
