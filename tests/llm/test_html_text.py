import html
import re

import pytest

from corpuslens.llm import html_text as H
from corpuslens.llm import queries


def brute(page):
    """The generated tables' pages: blocks of the article element."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    parts = [re.sub(r"</?b>", "", x) for x in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))]
    return " ".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_query_equals_brute_force(spark, sf_dir):
    out = {r.page_id: r for r in queries.QUERIES["op1_html_extraction"](spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(out) == len(pages)
    for p in pages:
        r = out[p.page_id]
        assert (r.url, r.text, r.n_chars) == (p.url, brute(p.html), len(brute(p.html)))


def plain(k):
    """A template without article elements."""
    return (f"<html><body><div id=top><ul class='menu'><li><a href=/a>Home</a><li><a href=/b>About {k}</a></ul></div>"
            f"<div class=wrap><h2>Title number {k}</h2><div>First &amp; part of text {k}, rather long so that it counts.</div>"
            f"<div>Second part {k * k} of the same &lt;text&gt;, <i>ital</i>ic.</div></div>"
            f"<div class='site-footer'>Copyright everyone</div><div>Powered by something</div></body></html>")


CASES = {
    "plain": (plain(3), "Title number 3 First & part of text 3, rather long so that it counts. Second part 9 of the same <text>, italic."),
    "rich": ("<body><header>Site name</header><nav>Menu</nav><main><div class='breadcrumbs'>You are here</div><article class='post'>"
             "<header><h1>Head&nbsp;line</h1></header><p>One<p>Two <b>bold</b> &#8212; <a href=x>link</a><!-- <p>no</p> --><script>'<p>x</p>'</script>"
             "<form><input value=a>Sign up</form><div class='ad-box'>Buy</div><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>"
             "<aside>Side</aside><div class='cookie-notice'>We use</div><section id='comments'><p>Nice!</p></section><footer>By me</footer>"
             "</article><article class='comment'>First!</article></main><footer>Foot</footer>",
             "Head line One Two bold — link a b c d"),
    "broken": ("<article><p>open < 3 and > 2<p title='a>b'>next</div></span>end <b>x", "open < 3 and > 2 next end x"),
    "none": ("", ""), "null": (None, ""), "no tags": ("just  text &amp; more", "just text & more"),
}


@pytest.mark.parametrize("case", ["rich", "broken", "none", "no tags"])
def test_single_pages(case):
    page, want = CASES[case]
    assert H.main_text(list(H.blocks(page)), set()) == want


def test_hosts_nulls_and_repeated_rows(spark):
    rows = [(i, f"http://plain.example.org/{i}", plain(i), "x") for i in range(1, 9)]
    rows += [(20, "https://rich.example.com/a", CASES["rich"][0], "x"), (20, "https://rich.example.com/a", CASES["rich"][0], "x"),
             (21, None, CASES["null"][0], "x"), (22, "not a url", CASES["no tags"][0], None), (None, None, CASES["broken"][0], "x"),
             (23, "http://plain.example.org/", "", "x"), (24, "http://big.example.org/", "<article>" + "<p>word " * 50000, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, article string").repartition(3)
    out = H.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((str(r.page_id), r.text) for r in out.collect())
    want = {"3": CASES["plain"][1], "20": CASES["rich"][1], "21": "", "22": CASES["no tags"][1], "None": CASES["broken"][1], "23": "",
            "24": " ".join(["word"] * 50000)}
    assert len(got) == len(rows)
    assert all(text == want[i] for i, text in got if i in want)
    assert H.extract(pages.limit(0)).count() == 0


def test_wrapper_expression(spark):
    pages = spark.createDataFrame([(1, "http://h/1", "<ul><li>a<li>b</ul><p>x</p>"), (2, "http://h/2", "<ul><li>c</ul><h1>t</h1><p>y</p>")],
                                  "page_id bigint, url string, html string")
    r, = H.wrappers(pages).collect()
    assert r.wrapper == "<ul>(<li>#text</>)+</> (<h1>#text</>)? <p>#text</>"


def test_merged_wrappers_do_not_depend_on_the_split():
    pages = [list(H.blocks(plain(k))) for k in range(1, 7)] + [list(H.blocks(CASES["rich"][0]))]
    whole = H.Wrapper()
    for p in pages:
        whole.add_page(p)
    parts = [H.Wrapper() for _ in range(3)]
    for k, p in enumerate(pages):
        parts[k % 3].add_page(p)
    pooled = H._pooled([p.dumps() for p in parts])
    assert pooled.slots == whole.slots
    assert H.article_slots(pooled.slots) == H.article_slots(whole.slots)


BODY = "A rather long text of the article, with more words than the rest of its page has in all its parts."


@pytest.mark.parametrize("page, want", [
    ("<article><svg-icon>i</svg-icon><p>One</p><title-bar>Two</title-bar><style-guide>Three</style-guide></article>", "i One Two Three"),
    (f"<body><app-root><app-content><p>{BODY}</p></app-content></app-root>", BODY),
    (f"<body><div class='page has-sidebar'><article><p>{BODY}</p></article><div class=sidebar>Links</div></div>", BODY),
    (f"<body><form action=/><nav>Menu</nav><main><p>{BODY}</p><form>Sign up</form></main></form>", BODY),
    (f"<body><form action=/><div><p>{BODY}</p><p>{BODY}</p></div><div class=notice>Note</div></form>", f"{BODY} {BODY}"),
    (f"<body><div class='layout-header'><article><p>{BODY}</p></article></div>", BODY),
    (f"<body><div class=comments><p>{BODY}</p></div><div class=post><p>Short</p></div>", "Short"),
])
def test_marks_of_ordinary_markup(page, want):
    assert H.main_text(list(H.blocks(page)), set()) == want
