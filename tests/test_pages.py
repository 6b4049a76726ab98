"""Pages, feeds and registry documents."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from tidewire.functions import html as H
from tidewire.operators import registry as R
from tidewire.operators.facts import recode_history
from tidewire.sources import feeds, pages, registry, tables

BODY = "<article>" + "".join(f"<p>Paragraph {i} has quite a lot of words about the market today.</p>" for i in range(4)) + "</article>"


def page(head="", body=BODY):
    return f"<html><head>{head}</head><body><nav><a href='/news/nav'>n</a></nav>{body}<script>var x = '<p>no</p>';</script></body></html>"


def read(spark, markup, **kwargs):
    df = spark.createDataFrame([(1, "https://site.com/news/1", markup)], "page_id bigint, url string, html string")
    return pages.page_articles(df, **kwargs).first()


def test_title_order(spark):
    og = "<meta property='og:title' content=' From meta '><title>T | Site</title>"
    assert read(spark, page(og, "<h1>Head</h1>" + BODY)).title == "From meta"
    assert read(spark, page("<title>T</title>", "<h1>He<b>ad</b></h1>" + BODY)).title == "Head"
    assert read(spark, page("<title>Story | Site - X</title>")).title == "Story"
    assert read(spark, page(og, "<h1>Head</h1>" + BODY), dynamic=True).title == "Head"
    twitter = "<meta name='twitter:title' content='Tw'><title>T | S</title>"
    assert read(spark, page(twitter), dynamic=True).title == "Tw"
    assert read(spark, page("<title>T | S</title>"), dynamic=True).title == "T | S"
    assert read(spark, page()) is None


def test_dates(spark):
    title = "<title>t</title>"
    meta = "<meta property='article:published_time' content='2025-01-05T09:30:00+08:00'>"
    assert read(spark, page(title + meta)).published_at == datetime(2025, 1, 5, 9, 30)
    bad_then_time = title + "<meta name='date' content='soon'>"
    assert read(spark, page(bad_then_time, "<time datetime='2025-02-01'>x</time>" + BODY)).published_at == datetime(2025, 2, 1)
    ld = title + "<script type='application/ld+json'>" + json.dumps({"@graph": [{"author": {"name": "x"}, "datePublished": "2025-03-01T00:00:00Z"}]}) + "</script>"
    assert read(spark, page(ld)).published_at == datetime(2025, 3, 1, 8)
    assert read(spark, page(title)).published_at is None
    as_of = F.expr("timestamp_ntz'2025-05-05 05:05:05'")
    assert read(spark, page(title), dynamic=True, as_of=as_of).published_at == datetime(2025, 5, 5, 5, 5, 5)
    item = title + "<meta itemprop='datePublished' content='2025-04-04'>"
    assert read(spark, page(item)).published_at is None
    assert read(spark, page(item), site_selectors=F.array(F.lit("meta[itemprop='datePublished']"))).published_at == datetime(2025, 4, 4)


def test_canonical_and_text(spark):
    row = read(spark, page("<title>t</title><link rel='canonical' href='http://site.com/c/#x'>"))
    assert row.canonical_url == "https://site.com/c" and "Paragraph 3" in row.content_text
    assert "nav" not in row.content_text and "var x" not in row.content_text and row.method == "density"
    assert read(spark, page("<title>t</title>")).canonical_url == "https://site.com/news/1"
    assert read(spark, page("<title>t</title>", "<article><p>short</p></article>")) is None
    lines = "<div class='main-content'>" + "".join(f"<span>word {i}</span>" for i in range(20)) + "</div>"
    assert H.main_text(H.parse(page("", lines)))[1] in ("density", "region")
    assert H.main_text(H.parse(""))[1] == "none"


def test_references_without_semicolon(spark):
    """Titles are cut anywhere, also within a reference: `&amp` is then an &, any other name stays as written."""
    for written, title in [("key = &quot", "key = &quot"), ("a &lt", "a &lt"), ("a &amp", "a &"), ("&quotx; &amp;quot &notit;", "&quotx; &quot &notit;"),
                           ("&amp;amp &ampx", "&amp &x"), ("&lt;b&gt; &quot;c&quot; &amp; &eacute;", '<b> "c" & é')]:
        assert read(spark, page("", f"<h1>{written}</h1>" + BODY)).title == title
    text = read(spark, page("<title>t</title><link rel='canonical' href='https://site.com/c?a=1&amp;b=2&lt'>",
                            "<article><p>One &amp two &copy three &quot; four &#169 five.</p>" + BODY[9:]))
    assert text.content_text.startswith('One &amp two &copy three " four © five.') and text.canonical_url == "https://site.com/c?a=1&b=2<"
    ld = "<title>t</title><script type='application/ld+json'>{\"name\": \"a &quot b\", \"datePublished\": \"2025-03-01T00:00:00Z\"}</script>"
    assert read(spark, page(ld)).published_at == datetime(2025, 3, 1, 8)


def test_references_same_as_sql(spark, tmp_path):
    from harness import compare
    import duckdb

    from tidewire.plans import catalog

    catalog.load()
    titles = ["token = &quot", "a &lt", "a &amp", "&amp;amp", "&quot;a&quot; &amp b", "a &quo", "AT&T &am", "&ampx &gt;"]
    # the text of each page is around the 100 characters that it needs
    markup = [f"<html><article><h1>{t}</h1><p>{'w' * (98 - len(t) + more)}</p></article></html>" for t in titles for more in range(8)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [(i, f"https://site.com/{i}", m) for i, m in enumerate(markup)])
    con.execute(f"COPY pages TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    assert compare(spark, con, "page_article", catalog.QUERIES["page_article"], catalog.ORACLES["page_article"], str(tmp_path)) is None


def test_links(spark):
    listing = ("<h2><a href='/news/a'>a</a></h2><div class='post'><a href='http://site.com/blog/b/'>b</a><a href='/news/a#x'>again</a></div>"
               "<h3><a href='/about'>x</a></h3><a href='/news/loose'>l</a><article><a href='https://else.com/news/c'>c</a></article>")
    df = spark.createDataFrame([(1, "https://site.com/list", page("", listing))], "page_id bigint, url string, html string")
    assert [r.link for r in pages.page_links(df).orderBy("at").collect()] == [
        "https://else.com/news/c", "https://site.com/blog/b", "https://site.com/news/a"]
    ruled = df.withColumn("list_selectors", F.array(F.lit("a[href*='/loose']"), F.lit("article a[href]"))).withColumn(
        "allow", F.array(F.lit("/news/"))).withColumn("allowed_domains", F.array(F.lit("site.com")))
    assert [r.link for r in pages.page_links(ruled, rule=True).collect()] == ["https://site.com/news/loose"]
    assert pages.page_links(df, limit=2).count() == 2
    dynamic = pages.page_links_dynamic(df, ["h2 a[href]", "a[href]"], allow=["/news/"]).orderBy("at").collect()
    assert [r.link for r in dynamic] == ["https://site.com/news/a", "https://site.com/news/nav", "https://site.com/news/a#x", "https://site.com/news/loose"]


def test_memory_of_a_worker_does_not_grow_with_the_batch():
    """Pages of one Arrow batch leave nothing behind: results go out by slices, trees go at once."""
    import gc
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql import types as T

    class Pages:                        # keeps what is given to mapInArrow
        schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("html", T.StringType())])

        def withColumn(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    def peak(n):
        page = "<article>" + "".join(f"<p>paragraph {i} of this long page</p>" for i in range(400)) + "</article>"
        batch = pa.RecordBatch.from_arrays(
            [pa.array(range(n)), pa.array([page] * n), pa.array([None] * n, pa.list_(pa.string()))], ["page_id", "html", "_listed"])
        gc.collect()
        tracemalloc.start()
        got = 0
        for part in pages._each_page(Pages(), None, pages._page_reader(True), pages._PAGE)(iter([batch])):
            got += part.num_rows
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got == n
        return most

    gc.disable()
    try:
        assert peak(200) < 1.5 * peak(60) < 10_000_000
    finally:
        gc.enable()


def test_site_rules(spark):
    df = spark.createDataFrame([(1, "https://www.nvidia.com/news", None), (2, "https://x.org/a", "OpenAI.com"), (3, "https://www.x.org/feed.xml", "")],
                               "source_id int, url string, parser string")
    got = {r.source_id: r for r in R.with_site_rule(df).collect()}
    assert got[1].rule_site == "nvidia.com" and got[1].request_url == "https://nvidianews.nvidia.com/news"
    assert got[2].rule_site == "openai.com" and got[3].allowed_domains == ["x.org", "www.x.org"] and got[3].mode == "rss"


def test_feeds(spark, tmp_path):
    rss = """<rss><channel><title>feed</title><item><title> One </title><link>http://a.com/1/</link><pubDate>Mon, 06 Jan 2025 10:00:00 GMT</pubDate>
    <description>&lt;p&gt;Hello&lt;/p&gt;&lt;p&gt;you&lt;/p&gt;</description></item><item><title></title><link>http://a.com/2</link></item></channel></rss>"""
    (tmp_path / "a.xml").write_text(rss)
    as_of = F.expr("timestamp_ntz'2025-05-05 00:00:00'")
    rows = feeds.feed_articles(feeds.read_rss(spark, str(tmp_path / "a.xml")), as_of).collect()
    assert [(r.title, r.url, r.published_at, r.content_text) for r in rows] == [("One", "https://a.com/1", datetime(2025, 1, 6, 18), "Hello you")]
    atom = """<feed><entry><title>Two</title><link href="https://b.com/2"/><updated>2025-01-06T10:00:00Z</updated><content type="html">Body text</content></entry>
    <entry><title>Three</title><link href="https://b.com/3"/><summary>Sum</summary></entry></feed>"""
    (tmp_path / "b.xml").write_text(atom)
    rows = feeds.feed_articles(feeds.read_atom(spark, str(tmp_path / "b.xml")), as_of).orderBy("title").collect()
    assert [(r.title, r.published_at, r.content_text) for r in rows] == [
        ("Three", datetime(2025, 5, 5), "Sum"), ("Two", datetime(2025, 1, 6, 18), "Body text")]


def test_registry_document(spark, tmp_path):
    doc = {"sources": [{"name": "a", "type": "rss", "url": " https://a.com/rss "}, {"name": "b", "type": "dynamic", "url": "https://b.com", "enabled": False}],
           "recipients": [" Ann@Example.com"]}
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=1))
    sources, people = registry.read_registry(spark, str(tmp_path / "r.json"))
    assert [(r.url, r.enabled, r.timeout_sec) for r in sources.orderBy("seq").collect()] == [("https://a.com/rss", True, 30), ("https://b.com", False, 30)]
    assert (people.first().email, people.first().display_name) == ("ann@example.com", "ann")
    good, rest = R.route_sources(sources.withColumn("enabled", F.lit(True)))
    assert (good.count(), rest.first().type) == (1, "dynamic")


def test_recode_both_ways(spark):
    df = spark.createDataFrame([("DOMESTIC", "FINTECH_AI", None), ("国外", "未知", 0.0)], "region string, layer string, finance_relevance double")
    new = recode_history(df)
    assert [tuple(r) for r in new.collect()] == [("国内", "金融大模型技术", 1.0), ("国外", "未知", 0.0)]
    assert recode_history(new, back=True).first().layer == "FINTECH_AI"


def test_missing_tables(spark):
    assert tables.missing_tables(spark, "default").count() == len(tables.TABLES)
    for name, ddl in tables.TABLES.items():
        assert spark.createDataFrame([], ddl).columns, name
