"""Articles: de-duplication, entity tags, extraction, crawl work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import byline_names, canonical_url, completeness, normalize_text, strip_html
from ..sources.lake import settled, upsert_parquet


def article_dedup(articles: DataFrame) -> DataFrame:
    """The first row of each link and day partition."""
    rows = articles.withColumn("url", canonical_url(F.col("url")))
    first = Window.partitionBy("day", "url").orderBy("published", "article_id")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def dedup_counts(articles: DataFrame) -> DataFrame:
    rows = articles.withColumn("url", canonical_url(F.col("url")))
    return rows.groupBy("day").agg(F.count("*").alias("articles"), F.countDistinct("url").alias("unique_urls"), F.countDistinct("feed").alias("feeds"))


def build_aliases(manual: DataFrame, names: DataFrame, stop: tuple[str, ...] = (), least: int = 6) -> DataFrame:
    """(alias, symbol): manual aliases always, normalised names when long enough and not in the stop list."""
    named = names.select(normalize_text(F.col("name")).alias("alias"), "symbol").where(F.length("alias") >= least)
    if stop:
        named = named.where(~F.col("alias").isin(*stop))
    return manual.select(normalize_text(F.col("alias")).alias("alias"), "symbol").unionByName(named).where("alias <> ''").distinct()


#: a run of letters and digits or one sign, with the blank before it
_TOKEN = "( ?)([a-z0-9]+|&)"


def _tokens(normalized: Column) -> Column:
    return F.regexp_extract_all(normalized, F.lit(_TOKEN), F.lit(0))


def alias_index(aliases: DataFrame) -> DataFrame:
    """(first, lengths): for each token that opens an alias how many tokens its aliases have."""
    opened = aliases.select(_tokens(F.col("alias")).alias("t")).where(F.size("t") > 0)
    return opened.groupBy(F.ltrim(F.col("t")[0]).alias("first")).agg(F.sort_array(F.collect_set(F.size("t"))).alias("lengths"))


#: an alias table of no more rows is sent to all tasks
SENT_ALIASES = 200_000


def alias_hits(docs: DataFrame, aliases: DataFrame, key: str, text: str) -> DataFrame:
    """(_k, at, n, alias): the longest alias that stands at each token of a text, `n` tokens long.

    An alias stands between signs, blanks or ends of the text, never inside a run of letters and digits. Only tokens that
    open an alias are followed further; a dictionary of any size is an equi-join, and up to `SENT_ALIASES` rows of it the texts
    stay where they are.
    """
    names = aliases.select("alias").distinct()
    index = settled(alias_index(names))
    longest, count = index.agg(F.max(F.array_max("lengths")), F.count("*")).first()
    longest = longest or 0
    if count <= SENT_ALIASES and names.count() <= SENT_ALIASES:
        index, names = F.broadcast(index), F.broadcast(names)
    w = docs.select(F.col(key).alias("_k"), _tokens(normalize_text(F.col(text))).alias("w")).where(F.size("w") > 0)
    # each token with the one before it and those that the longest alias and the bound behind it need
    shifted = [F.slice("w", i + 1, F.size("w")).alias(f"t{i}") for i in range(longest + 1)]
    row = w.select("_k", F.posexplode(F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), F.slice("w", 1, F.size("w") - 1)).alias("before"), *shifted)).alias("at", "t"))
    t = [F.col(f"t.t{i}") for i in range(longest + 1)]
    # a sign opens an alias only where no letter or digit stands right before it
    free = (t[0] != "&") | F.coalesce(F.ltrim("t.before") == "&", F.lit(True))
    found = row.where(free).withColumn("first", F.ltrim(t[0])).join(index, "first").select("_k", "at", "t", F.explode("lengths").alias("n"))
    run, fits = F.lit(None).cast("string"), F.lit(False)
    for n in range(1, longest + 1):
        last, after = t[n - 1], t[n]
        ends = last.isNotNull() & ((F.ltrim(last) != "&") | F.coalesce(F.startswith(after, F.lit(" ")) | (after == "&"), F.lit(True)))
        run, fits = F.when(F.col("n") == n, F.ltrim(F.concat(*t[:n]))).otherwise(run), F.when(F.col("n") == n, ends).otherwise(fits)
    runs = found.where(fits).select("_k", "at", "n", run.alias("alias")).join(names, "alias")
    return runs.groupBy("_k", "at").agg(F.max(F.struct("n", "alias")).alias("m")).select("_k", "at", "m.n", "m.alias")


def entity_match(docs: DataFrame, aliases: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, symbols): sorted symbols whose aliases occur; hits are leftmost, longest first, without overlap.

    A hit counts unless a chosen hit before it covers its start. Texts without a hit have no row.
    """
    aliases = settled(aliases.select("alias", "symbol").distinct())
    hits = alias_hits(docs, aliases, key, text)
    lists = hits.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("at", "n", "alias"))).alias("h"))
    start = F.struct(F.lit(0).alias("free"), F.expr("cast(array() as array<string>)").alias("out"))
    step = lambda a, x: F.when(x["at"] >= a["free"], F.struct((x["at"] + x["n"]).alias("free"), F.array_append(a["out"], x["alias"]).alias("out"))).otherwise(a)
    chosen = lists.select("_k", F.explode(F.array_distinct(F.aggregate("h", start, step, lambda a: a["out"]))).alias("alias"))
    return chosen.join(aliases, "alias").groupBy(F.col("_k").alias(key)).agg(F.array_join(F.sort_array(F.collect_set("symbol")), ",").alias("symbols"))


def _first(*columns: Column) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns])


def _meta(html: Column, names: tuple[str, ...]) -> Column:
    """Content of the first `meta` tag with one of these names or properties, whichever attribute comes first."""
    named = rf"(?is)<meta\b[^>]*?\b(?:name|property|itemprop)\s*=\s*[\"'](?:{'|'.join(names)})[\"']"
    after = F.regexp_extract(html, named + r"[^>]*?\bcontent\s*=\s*[\"']([^\"'<>]*)", 1)
    before = F.regexp_extract(html, rf"(?is)<meta\b[^>]*?\bcontent\s*=\s*[\"']([^\"'<>]*)[\"'][^>]*?\b(?:name|property|itemprop)\s*=\s*[\"'](?:{'|'.join(names)})[\"']", 1)
    return _first(after, before)


_LINKED = "struct<datePublished: string, headline: string, author: string>"
# Names of the tags that state when and by whom a page was published.
DATE_NAMES = ("article:published_time", "og:published_time", "datepublished", "publish-date", "pubdate", "parsely-pub-date", "dc.date.issued", "date")
AUTHOR_NAMES = ("author", "article:author", "parsely-author", "dc.creator")


def linked_data(html: Column) -> Column:
    """An array of the objects in a page's JSON-LD blocks: single ones, lists, and graphs."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    graphs = F.flatten(F.filter(F.transform(blocks, lambda b: F.from_json(b, f"struct<`@graph`: array<{_LINKED}>>")["@graph"]), lambda g: g.isNotNull()))
    # a list is read as it is, a single object as a list of one
    flat = F.flatten(F.filter(F.transform(blocks, lambda b: F.from_json(b, f"array<{_LINKED}>")), lambda g: g.isNotNull()))
    return F.concat(flat, graphs)


def _names(author: Column) -> Column:
    """Names of an `author` of JSON-LD: a text, an object with a name, or a list of either, as one byline."""
    one = lambda a: F.when(F.startswith(a, F.lit("{")), F.get_json_object(a, "$.name")).otherwise(a)
    many = F.transform(F.from_json(author, "array<string>"), one)
    return F.when(F.startswith(author, F.lit("[")), F.array_join(many, ",")).otherwise(one(author))


def page_time(text: Column) -> Column:
    """A stated time as a timestamp; null if no known form fits."""
    forms = ("yyyy-MM-dd'T'HH:mm:ssXXX", "EEE, dd MMM yyyy HH:mm:ss Z", "dd MMM yyyy HH:mm:ss Z", "MMM d, yyyy", "MMMM d, yyyy", "d MMMM yyyy", "dd/MM/yyyy", "yyyyMMddHHmmss", "yyyyMMdd")
    plain = F.regexp_replace(text, "^[A-Za-z]{3}, ", "")
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(plain, F.lit(f)) for f in forms if not f.startswith("EEE")])


def extract_article(pages: DataFrame, lastmod: DataFrame | None = None) -> DataFrame:
    """One row for each page: id, title, body, language, publication, authors, and how complete it is.

    Time and authors come from JSON-LD, then `meta` tags, then a `time` tag and an element that is named as byline or author.
    `lastmod` (url, lastmod) of a site map dates pages that don't state a time; date_source says which it was. With (page_id, lastmod)
    only the pages that are named are dated, not others of the same link. A page that gives neither title nor body is a `failed`
    row with its reason.
    """
    html = F.col("html")
    title = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"[ \t\r\n]+", " "))
    head = strip_html(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    article = F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1)
    body = strip_html(F.when(article != "", article).otherwise(F.regexp_replace(html, r"(?is)<title[^>]*>.*?</title>", " ")))
    rows = pages.select("page_id", "url", "html", linked_data(html).alias("linked"))
    pick = lambda field: F.get(F.filter(F.transform("linked", lambda x: x[field]), lambda x: F.trim(x) != ""), F.lit(0))
    stated = _first(pick("datePublished"), _meta(html, DATE_NAMES), F.regexp_extract(html, r"(?is)<time\b[^>]*?\bdatetime\s*=\s*[\"']([^\"']*)", 1))
    signed = strip_html(F.regexp_extract(html, r"(?is)<(?:span|div|p|a|address)\b[^>]*?\b(?:class|rel|itemprop)\s*=\s*[\"'][^\"'>]*\b(?:byline|author)\b[^\"'>]*[\"'][^>]*>(.*?)</(?:span|div|p|a|address)>", 1))
    byline = _first(_names(pick("author")), _meta(html, AUTHOR_NAMES), F.regexp_replace(signed, "(?i)^by\\s+", ""))
    rows = rows.select(
        "page_id", "url", F.substring(F.sha1(F.coalesce("url", F.lit("")).cast("binary")), 1, 16).alias("article_id"), F.coalesce(_first(title, pick("headline"), head), F.lit("")).alias("title"),
        F.coalesce(body, F.lit("")).alias("body"), F.coalesce(F.regexp_extract(html, r'(?is)<html[^>]*\blang="([^"]*)"', 1), F.lit("")).alias("language"), page_time(stated).alias("stated"),
        F.coalesce(F.array_join(byline_names(byline), ", "), F.lit("")).alias("authors"), html.isNull().alias("missing"))
    if lastmod is None:
        rows = rows.withColumn("lastmod", F.lit(None).cast("timestamp"))
    else:
        key = "page_id" if "page_id" in lastmod.columns else "url"
        rows = rows.join(lastmod.groupBy(key).agg(F.max("lastmod").alias("lastmod")), key, "left")
    status = completeness(F.col("body"), F.col("title"))
    reason = F.when(F.col("missing"), "no page").when(status == "failed", "no headline or body")
    source = F.when(F.col("stated").isNotNull(), "page_meta").when(F.col("lastmod").isNotNull(), "sitemap_lastmod")
    words = F.when(F.col("body") == "", 0).otherwise(F.size(F.split("body", " ")))
    return rows.select("page_id", "article_id", "url", "title", "body", "language", "authors", F.coalesce("stated", "lastmod").alias("published"), source.alias("date_source"), status.alias("status"), reason.alias("failure_reason"), words.alias("words"))


def crawl_worklist(captures: DataFrame, done: DataFrame, since_year: int, limit: int | None = None) -> DataFrame:
    """The earliest capture of each link since a year, less what has been fetched or has failed."""
    first = captures.where(F.year("captured") >= since_year).groupBy("url").agg(F.min_by(F.struct("captured", "capture_id"), F.struct("captured", "capture_id")).alias("c"))
    left = first.select("url", "c.captured", "c.capture_id").join(done.select("url").distinct(), "url", "left_anti")
    return left.orderBy("captured", "url").limit(limit) if limit else left


def crawl_articles(pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """Captured pages (page_id, url, html, captured) as tagged articles.

    Texts of 120 characters or more, cut at 8000, with an excerpt of 500; published when the page says so, else when it was
    captured, with year and month of that. Entities are looked for in title, excerpt and the first 1500 characters.
    """
    texts = extract_article(pages).where(F.length("body") >= 120).drop("article_id", "date_source", "status", "failure_reason", "words")
    texts = texts.join(pages.select("page_id", "captured"), "page_id").withColumn("published", F.coalesce("published", "captured"))
    texts = texts.withColumn("text", F.substring("body", 1, 8000)).withColumn("excerpt", F.substring("body", 1, 500)).drop("body")
    tags = entity_match(texts.select("page_id", F.concat_ws(" ", "title", "excerpt", F.substring("text", 1, 1500)).alias("blob")), aliases, "page_id", "blob")
    return texts.join(tags, "page_id", "left").withColumn("year", F.year("published")).withColumn("month", F.month("published"))


def write_articles(articles: DataFrame, path: str) -> None:
    """Articles by year and month of publication; months that come again are merged by page."""
    upsert_parquet(articles, path, ["page_id"], ["year", "month"], ["page_id"])
