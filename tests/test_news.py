"""Entity tags by the rule itself, and what articles state about themselves."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from marketloom.functions.text import normalize_text
from marketloom.operators import news

PAGES = {
    1: '<html lang="en"><head><title>One</title><script type="application/ld+json">{"@graph":[{"@type":"WebSite"},{"datePublished":"2024-05-01T10:00:00+05:30","author":{"name":"Ann Lee"}}]}</script></head><article><p>text</p></article>',
    2: '<head><meta content="Fri, 03 May 2024 08:00:00 +0000" name="pubdate"><meta property="article:author" content="By Bo Ray and SECTIONS of"></head><h1>Two</h1><body>body</body>',
    3: '<title>Three</title><time datetime="2024-05-04">x</time><span class="post byline"><a>By Cy Ng, Di Poe 2</a></span>' + "<p>word</p>" * 90,
    4: '<title>Four</title><script type="application/ld+json">not json</script><script type="application/ld+json">[{"datePublished":"","author":["E F",{"name":"G H"}]},{"datePublished":"2024-05-05"}]</script>',
    5: "<title> </title><nav>menu</nav>", 6: None, 7: "", 8: '<title>Eight</title><meta name="date" content="never">',
}


def test_articles(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", h, "c") for i, h in PAGES.items()] + [(9, None, "<title>Nine</title>", "c")], "page_id int, url string, html string, body string")
    lastmod = spark.createDataFrame([("http://x/8", dt.datetime(2024, 6, 1)), ("http://x/8", dt.datetime(2024, 6, 2)), ("http://x/1", dt.datetime(2020, 1, 1))], "url string, lastmod timestamp")
    got = {r["page_id"]: r for r in news.extract_article(pages, lastmod).collect()}
    assert {i: r["published"] for i, r in got.items()} == {1: dt.datetime(2024, 5, 1, 4, 30), 2: dt.datetime(2024, 5, 3, 8), 3: dt.datetime(2024, 5, 4), 4: dt.datetime(2024, 5, 5), 8: dt.datetime(2024, 6, 2), **dict.fromkeys((5, 6, 7, 9))}
    assert {i: r["date_source"] for i, r in got.items() if r["date_source"]} == {1: "page_meta", 2: "page_meta", 3: "page_meta", 4: "page_meta", 8: "sitemap_lastmod"}
    assert {i: r["authors"] for i, r in got.items() if r["authors"]} == {1: "Ann Lee", 2: "By Bo Ray", 3: "Cy Ng", 4: "E F, G H"}
    assert {i: (r["status"], r["failure_reason"]) for i, r in got.items()} == {
        1: ("partial", None), 2: ("partial", None), 3: ("full", None), 4: ("headline_only", None), 5: ("failed", "no headline or body"), 6: ("failed", "no page"), 7: ("failed", "no headline or body"), 8: ("headline_only", None), 9: ("headline_only", None)}
    assert got[2]["title"] == "Two" and got[3]["words"] >= 90 and got[1]["language"] == "en"


def test_pages_that_share_a_link_are_dated_by_their_own_entry(spark, tmp_path):
    from marketloom.plans.book_queries import i6_extract_article

    rows = [(i, "http://x/same", f"<html lang='en'><head><title>T{i}</title></head><article>a</article></html>") for i in (3, 7, 11, 15)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["date_source"], r["dated"]) for r in i6_extract_article(spark, str(tmp_path)).collect()}
    assert got == {3: ("sitemap_lastmod", 1704067200), 7: (None, None), 11: ("sitemap_lastmod", 1704067200), 15: (None, None)}


def test_crawled_articles_by_month(spark, tmp_path):
    long = "<p>" + "tata steel rises " * 20 + "</p>"
    rows = [(1, "u1", '<title>A</title><meta name="date" content="2024-02-03">' + long, dt.datetime(2024, 3, 1)), (2, "u2", "<title>B</title>" + long, dt.datetime(2024, 3, 1)), (3, "u3", "<title>short</title>", dt.datetime(2024, 3, 1))]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, captured timestamp")
    aliases = spark.createDataFrame([("tata steel", "TS")], "alias string, symbol string")
    path = str(tmp_path / "articles")
    for _ in range(2):
        news.write_articles(news.crawl_articles(pages, aliases), path)
    got = {r["page_id"]: (r["year"], r["month"], r["symbols"], len(r["excerpt"])) for r in spark.read.parquet(path).collect()}
    assert got.keys() == {1, 2} and got[1][:3] == (2024, 2, "TS") and got[2][:3] == (2024, 3, "TS")
    assert sorted(p.name for p in (tmp_path / "articles" / "year=2024").iterdir() if "=" in p.name) == ["month=2", "month=3"]


def test_entities_by_the_rule(spark):
    """Against the alternation with bounds that isn't letters or digits, longest alias first."""
    rnd = random.Random(1)
    parts = ["tata", "steel", "l&t", "m&m", "&", "a", "x1", "sons", "bank", "of"]
    aliases = {" ".join(rnd.choices(parts, k=rnd.randrange(1, 4))): f"S{i % 9}" for i in range(25)} | {"tata": "T", "l&t": "L", "& a": "AA"}
    texts = [" ".join(rnd.choices(parts, k=rnd.randrange(0, 14))).replace(" & ", rnd.choice([" & ", "&", "& "])) for _ in range(300)] + ["tata&sons", "TATA-steel", "atata", None, "", "& a& a"]
    table = spark.createDataFrame([(a, s) for a, s in aliases.items()], "alias string, symbol string").select(normalize_text(F.col("alias")).alias("alias"), "symbol").where("alias <> ''").distinct()
    named = {}
    for r in table.collect():
        named.setdefault(r["alias"], set()).add(r["symbol"])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rule = re.compile("(?<![a-z0-9])(" + "|".join(map(re.escape, sorted(named, key=lambda a: (-len(a), a)))) + ")(?![a-z0-9])")
    want = {}
    for r in docs.select("doc_id", normalize_text(F.col("text")).alias("t")).collect():
        found = {s for m in rule.finditer(r["t"] or "") for s in named[m[1]]}
        if found:
            want[r["doc_id"]] = ",".join(sorted(found))
    got = {r["doc_id"]: r["symbols"] for r in news.entity_match(docs, table).collect()}
    assert got == want and len(want) > 200
    assert news.entity_match(docs, table.limit(0)).count() == 0 and news.entity_match(docs.limit(0), table).columns == ["doc_id", "symbols"]
