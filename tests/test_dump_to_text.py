"""From a dump file to article texts and periods, in one call."""

import os

from pyspark.sql import functions as F

from corpuslens.functions.pages import articles_of_dump, classify_pages, strip_wikitext, template_depth
from corpuslens.sources.files import read_wiki_dump

BODY = "word " * 200


def page(i, title, text, ns=0, ts="2012-10-01T00:00:00Z", redirect=False):
    return (f"<page><title>{title}</title><ns>{ns}</ns><id>{i}</id>" + "<redirect title='x'/>" * redirect
            + f"<revision><timestamp>{ts}</timestamp><text>{text}</text></revision></page>")


def test_dump_to_texts(spark, tmp_path):
    path = os.path.join(tmp_path, "dump.xml")
    pages = [page(1, "Plain", "{{Info|a={{nested {{deep}} x}}}}'''Bold''' [[link|shown]] " + BODY), page(2, "Moved", "#REDIRECT", redirect=True),
             page(3, "Small", BODY + "{{geo-stub}}"), page(4, "List of things", BODY), page(5, "Talk", BODY, ns=1), page(6, "Empty", "{{only}}"),
             page(7, "Either", BODY + "{{disambig}}"), page(8, "A long title here", "few words"), page(9, "Undated", BODY, ts="soon")]
    with open(path, "w") as f:
        f.write("<mediawiki>" + "".join(pages) + "</mediawiki>")
    dump = read_wiki_dump(spark, path)
    kinds = {r.doc_id: r.page_type for r in classify_pages(dump.withColumn("content", strip_wikitext(F.col("text")))).collect()}
    assert kinds == {1: "ARTICLE", 2: "REDIRECT", 3: "STUB", 4: "LIST", 5: "NON_ARTICLE", 6: "EMPTY", 7: "DISAMBIGUATION", 8: "OTHER", 9: "ARTICLE"}
    out = {r.doc_id: (r.text, r.period) for r in articles_of_dump(dump).collect()}
    assert out == {1: (("Bold shown " + BODY).strip(), 2012275), 9: (BODY.strip(), None)}


def test_nested_templates(spark):
    deep = "a " + "{{x " * 30 + "y" + " z}}" * 30 + " b }} {{ c"
    r = spark.createDataFrame([(deep,), ("",)], "t string").select(template_depth(F.col("t")).alias("d"), strip_wikitext(F.col("t")).alias("s")).collect()
    assert [x.d for x in r] == [30, 0] and r[0].s == "a b }} {{ c" and r[1].s == ""
