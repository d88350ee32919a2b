import datetime as dt
import gzip

from pyspark.sql import functions as F

from rankloom.settings import Thresholds
from rankloom.sources import keyword_feeds, pages, serp_feeds, sinks, site_facts, sitemaps

T = Thresholds()


def one(df):
    return df.collect()[0]


def test_page_features(spark):
    html = """<?xml version="1.0"?><html><head><title> A  title </title>
    <meta name="description" content=" about  us "><meta name="robots" content="NoIndex">
    <link rel="canonical" href="/home">
    <script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":["Product"]}]}</script></head>
    <body><nav><p>menu text</p></nav><h1>Big <b>head</b></h1><p>First<br>line<p>Second &amp; line
    <ul><li>outer <p>inner</p> tail</li></ul><div class="cookie-bar"><p>cookies</p></div>
    <p>First line</p><a href="/x#y">x</a><a href="https://o.com/">o</a><a href="/x">x</a>
    <form><p>form</p></form><p aria-hidden="true">hidden</p></body></html>"""
    df = spark.createDataFrame([(1, "https://s.com/p", html), (2, "https://s.com/q", "<p>x <b>"), (3, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in pages.page_features(df, T).collect()}
    r = got[1]
    assert r["title"] == "A title" and r["description"] == "about us" and r["metas"] == ["noindex"]
    assert r["text"].split("\n") == ["Big head", "First line", "Second & line", "inner"]
    assert r["headings"] == ["Big head"] and r["schema_type"] == "Product" and r["status"] == "too_short"
    assert r["links"] == ["https://s.com/x", "https://o.com/"] and r["canonical"] == "https://s.com/home"
    assert got[2]["text"] == "x" and got[3]["text"] == ""


def test_serp_pages_rank_from_the_top(spark):
    page1 = '{"organic":[{"link":"https://a.com/","title":"A"},{"position":5,"link":"https://b.com/"}],"peopleAlsoAsk":[{"question":"q?"}],"videos":[]}'
    page2 = '{"organic":[{"link":"https://b.com/"},{"link":"https://c.com/"}],"images":[{"x":1}]}'
    raw = spark.createDataFrame([("r", "k", 1, page1), ("r", "k", 2, page2)], "run_id string, keyword string, page int, body string")
    rows = serp_feeds.result_pages(raw, 10).orderBy("pos").collect()
    assert [(r["rank"], r["url"]) for r in rows] == [(1, "https://a.com/"), (5, "https://b.com/"), (12, "https://c.com/")]
    assert [r["feature"] for r in serp_feeds.page_features(raw).collect()] == ["people_also_ask"]
    assert one(serp_feeds.page_questions(raw))["question"] == "q?"


def test_overview_fills_missing_keywords(spark):
    body = '{"items":[{"keyword":"A b","keyword_info":{"search_volume":90},"keyword_properties":{},"search_intent_info":{"main_intent":"commercial"}}]}'
    raw = spark.createDataFrame([(body,)], "body string")
    wanted = spark.createDataFrame([("a  B",), ("zz",)], "keyword string")
    got = {r["keyword"]: (r["volume"], r["difficulty"], r["intent"]) for r in keyword_feeds.keyword_overview(raw, wanted).collect()}
    assert got == {"a b": (90, None, "commercial"), "zz": (0, None, "unknown")}


def test_suggestion_list_and_dates(spark):
    raw = spark.createDataFrame([("k", '["k",["K a"," k  a","b",null]]'), ("n", None)], "keyword string, body string")
    got = {r["keyword"]: r["list"] for r in keyword_feeds.suggestion_lists(raw).collect()}
    assert got["n"] is None and got["k"][:2] == ["k a", "b"]
    df = spark.createDataFrame([("/Date(1790380800000)/",), ("x",)], "t string")
    assert [r[0] for r in df.select(keyword_feeds.wcf_date(F.col("t"))).collect()] == [dt.date(2026, 9, 26), None]


def test_sitemap_bytes_and_index(spark):
    xml = b'<?xml version="1.0"?><sitemapindex xmlns="http://s"><sitemap><loc> https://x.com/a.xml </loc></sitemap><sitemap><loc/></sitemap></sitemapindex>'
    df = spark.createDataFrame([("x.com", "f", bytearray(gzip.compress(xml))), ("x.com", "bad", bytearray(b"<html></html>"))], "site string, file string, raw binary")
    files = df.select("site", "file", sitemaps.unpack(F.col("raw")).alias("content"))
    rows = sitemaps.sitemap_entries(files).collect()
    assert [(r["kind"], r["url"], r["lastmod"]) for r in rows] == [("index", "https://x.com/a.xml", "")]


def test_read_sitemap_files(spark, tmp_path):
    text = '<urlset xmlns="http://s"><url><loc>https://x.com/1</loc><lastmod>2024-01-01</lastmod></url><url><loc></loc></url></urlset>'
    with gzip.open(tmp_path / "s.xml.gz", "wt") as f:
        f.write(text)
    rows = sitemaps.read_sitemap_files(spark, str(tmp_path)).collect()
    assert [(r["url"], r["lastmod"]) for r in rows] == [("https://x.com/1", "2024-01-01")]


def test_site_facts(spark):
    vit = '{"record":{"metrics":{"cumulative_layout_shift":{"percentiles":{"p75":"0.05"}},"other":{"percentiles":{"p75":1}}},"collectionPeriod":{"firstDate":{"year":2026,"month":9,"day":1},"lastDate":{"year":2026,"month":9,"day":28}}}}'
    raw = spark.createDataFrame([("o", "PHONE", vit), ("e", "PHONE", "{}")], "origin string, form_factor string, body string")
    rows = site_facts.web_vitals(raw)
    assert one(rows)["p75"] == 0.05 and one(rows)["first_day"] == dt.date(2026, 9, 1)
    assert {r["origin"]: r["status"] for r in site_facts.vitals_status(raw, rows).collect()} == {"o": "ok", "e": "no_data"}
    boot = spark.createDataFrame([('{"services":[[["COM","net"],["http://a/","https://b"]],[["com"],["https://c/"]]]}',)], "body string")
    assert {r["tld"]: r["server"] for r in site_facts.registry_servers(boot).collect()} == {"com": "https://b/", "net": "https://b/"}
    cap = spark.createDataFrame([("d", '[["timestamp","original"],["x","y"],["20180102030405","http://d/"]]'), ("n", "[]")], "domain string, body string")
    got = {r["domain"]: (r["first_seen"], r["first_seen_url"]) for r in site_facts.first_captures(cap).collect()}
    assert got == {"d": (dt.date(2018, 1, 2), "http://d/"), "n": (None, None)}


def test_safe_cells_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", -5, None), ("ok", 2, "@x")], "a string, n int, b string")
    rows = sinks.safe_cells(df).collect()
    assert [tuple(r) for r in rows] == [("'=1+1", "-5", ""), ("ok", "2", "'@x")]
    sinks.write_csv(sinks.safe_cells(df), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["a", "n", "b"]


def test_title_cut_inside_a_reference(spark):
    page = "<head><title>{}</title></head><body><h1>{}</h1></body>"
    cut = ["a &amp; b&amp", "x &lt;b&gt; &#233;&#x41; &nosuch; &am", "&amp;lt;"]
    rows = [(i, "https://s.com/", page.format(t, t)) for i, t in enumerate(cut)] + [(9, "https://s.com/", "<title>open &amp; end")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["title"], r["text"]) for r in pages.page_features(df, T).collect()}
    assert [got[i][0] for i in range(3)] == ["a & b&amp", "x <b> éA &nosuch; &am", "&lt;"]
    assert got[0][1] == "a & b&" and got[9][0] == "open & end"


def test_lines_cut_inside_a_reference_or_a_tag(spark):
    lines = ["token = &quot", "a &copy b &lt; c &amp", "x &am", "q &#34;&#3", "in <br"]
    rows = [(i, "https://s.com/", f"<h1>{line}</h1><p>next &quot; one</p>") for i, line in enumerate(lines[:4])]
    rows += [(4, "https://s.com/", "<p>" + lines[4]), (5, "https://s.com/", "<p>end &quot"), (6, "https://s.com/", "<p>a</p><p>b</")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n") for r in pages.page_features(df, T).collect()}
    assert [got[i][0] for i in range(4)] == ["token = &quot", "a &copy b < c &", "x &am", 'q "&#3']
    assert all(got[i][1] == 'next " one' for i in range(4))
    assert got[4] == ["in"] and got[5] == ["end &quot"] and got[6] == ["a", "b"]
