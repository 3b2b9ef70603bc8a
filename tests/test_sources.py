import pytest
from pyspark.sql import functions as F

from listwright.sources import links, pages, union
from listwright.sources.dom import CHARS_AT_ONCE, PAGES_AT_ONCE, _flat_batches, flatten, page_groups

HTML = """<html><body><ul class="joblist"><li class="job"><div><a href="/company/1"><img src=x></a>
<a href="/company/1">Acme Logo</a><h2><a href="/job/1/x">Ops &amp; Strategy Lead</a></h2>
<span>Long Beach, CA, USA</span> <span>92K-164K Annually</span>
<p>A long description that has more than eighty characters so that it is the block taken, ok then.</p>
<a href="https://www.ycombinator.com/companies/acme/jobs/1">Analyst</a>
<a href="/companies/acme">Acme (S15) • Makes things (about 1 month ago)</a> fulltimeBerlin, DE ·x</div>
</li></ul></body></html>"""


def page(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id bigint, html string")


@pytest.mark.parametrize("href,base,want", [
    ("http://x/y", "https://b.test/a/", "http://x/y"), ("/p", "https://b.test/a/b", "https://b.test/p"),
    ("c", "https://b.test/a/b?q#f", "https://b.test/a/c"), ("../c", "https://b.test/a/b/d", "https://b.test/a/c"),
    ("./c/", "https://b.test", "https://b.test/c/"), ("//h/x", "https://b.test/a", "https://h/x"),
    ("?n=1", "https://b.test/a?m", "https://b.test/a?n=1"), ("#z", "https://b.test/a?m#y", "https://b.test/a?m#z"),
    ("", "https://b.test/a", "https://b.test/a"), ("../../../c", "https://b.test/a/b", "https://b.test/c"),
])
def test_resolve_url(value, href, base, want):
    assert value(links.resolve_url, h=href, b=base) == want


def test_flatten_keeps_open_tags_and_skips_scripts():
    import pandas as pd

    out = flatten(pd.Series(['<p><b>x<br><p>y</b> z<script>"<i>no"</script><!-- c --> w', None])).iloc[0]
    assert out["strings"] == ["x", "y", "z", "w"]
    assert out["tag"] == ["[document]", "p", "b", "br", "p", "script"]
    assert out["parent"] == [-1, 0, 1, 2, 2, 1]


def test_flatten_decodes_whole_references_only():
    import pandas as pd

    html = '<a href="?a=1&copy=2&amp;b=3">x&amp;&amp</a><p>&lt;&#39;&#x41;&middot;&unknown; R&D & &am</p>'
    out = flatten(pd.Series([html])).iloc[0]
    assert out["strings"] == ["x&&amp", "<'A·&unknown; R&D & &am"]
    assert out["href"][1] == "?a=1&copy=2&b=3"


def test_pages_are_flattened_a_few_at_a_time():
    import pandas as pd
    import pyarrow as pa

    htmls = [f"<p>{n}<a href='/{n}'>x</a>" for n in range(1_000)] + ["<i>" + "y" * CHARS_AT_ONCE, None, "<b>z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(htmls))), pa.array(htmls)], ["page_id", "html"])
    parts = list(_flat_batches(iter([batch])))
    assert max(part.num_rows for part in parts) == PAGES_AT_ONCE
    rows = [row for part in parts for row in part.to_pylist()]
    assert [row["page_id"] for row in rows] == list(range(len(htmls)))
    assert [row["dom"] for row in rows] == flatten(pd.Series(htmls)).to_dict("records")
    assert list(page_groups([])) == [] and list(page_groups([CHARS_AT_ONCE + 1, 1, 1])) == [(0, 1), (1, 2)]


def test_cards_path(spark):
    row = pages.listings_cards_path(page(spark, HTML), "https://b.test").collect()
    assert len(row) == 1
    got = row[0].asDict()
    assert got["title"] == "Ops & Strategy Lead" and got["company"] == "Acme"
    assert got["location"] == "Long Beach, CA, USA" and got["salary_max"] == 164000.0
    assert got["description"].startswith("A long description") and got["url"] == "https://b.test/job/1/x"


def test_batch_company_first_url_wins_over_pages(spark):
    rows = pages.listings_batch_company(page(spark, HTML, HTML.replace("Analyst", "Other"))).collect()
    assert [(r["page_id"], r["title"], r["company"], r["location"]) for r in rows] == [
        (0, "Analyst", "Acme (S15)", "Berlin, DE")]


def test_climb_past_the_document(spark):
    html = "<body><p><a href='/x'>hi</a></p></body>"
    got = [pages.card_context(page(spark, html), 100, 12, how).first()["card_text"]
           for how in ("highest", "link")]
    assert got == ["hi", "hi"]
    lone = "<p>before</p><a href='/x'>hi</a>"
    got = [pages.card_context(page(spark, lone), 100, 12, how).first()["card_text"]
           for how in ("highest", "link")]
    assert got == ["before hi", "hi"]


def test_union_keeps_order_and_reports_failures(spark):
    def broken():
        return spark.read.parquet("/no/such/folder")

    def some(n):
        return lambda: spark.range(n).withColumnRenamed("id", "seq")

    df, errors = union.union_sources({"b": some(2), "x": broken, "a": some(1)})
    assert [r["source"] for r in df.orderBy("ord").collect()] == ["b", "b", "a"]
    assert len(errors) == 1 and errors[0].startswith("x: ")
    with pytest.raises(union.AllSourcesFailed):
        union.union_sources({"x": broken})


def test_links_agree_with_the_parser(spark):
    df = page(spark, HTML, "<A HREF='/q?a=1&amp;b=2' >  one <b> two</b></A><a name=x>no</a>")
    by_regex = links.extract_links(df).select("page_id", "href", "text")
    by_tree = pages.card_context(df, 10, 3).select("page_id", "href", "text")
    assert by_regex.exceptAll(by_tree).count() == 0 and by_tree.exceptAll(by_regex).count() == 0


def test_first_seen_by_url_with_one_hot_url(spark):
    df = spark.range(300).select(F.col("id").alias("ord"), F.when(
        F.col("id") % 2 == 0, "").otherwise(F.col("id").cast("string")).alias("url"))
    out = links.first_seen_by_url(df)
    assert out.count() == 151 and out.where("url = ''").first()["ord"] == 0
