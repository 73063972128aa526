"""Main text of web pages by consensus paths of their hosts.

Each page's containers are scored by the text they hold outside links and boilerplate; the densest container that keeps
most of the page's text is its candidate. Its generalised path (tags with their first class, digits removed) is a vote,
weighed by the logarithm of the text. Spark sums the votes by host; the paths with a good share of a host's votes
win. Every page is then extracted again from the containers on its host's winning paths; a page that has none of them
keeps its own candidate.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden parts and reader comments are left
out by tag, role and class words. A header inside an article stays, since it holds the title.

Defined results: null html gives empty text; a null or odd url is a host of its own; broken markup (missing ends, cut
pages, quotes left open) is read as far as it goes; repeated rows are extracted alike; other columns are ignored.

Scale: votes are combined before the shuffle, so a hot host costs one row for each task and path. Winners are sent to all
tasks while they are few (`SENT_ROWS` hosts), and page texts are then not shuffled. Beyond that pages are joined by host,
a hot host's being split over `SALTS` keys. Paths inside a page are numbered, so deep nesting costs no more than its tags.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SENT_ROWS = 100_000
SALTS = 64
WINNING_SHARE = 0.25
DENSE = 0.7

# Elements by what becomes of them.
_RAW = "script|style|noscript|template|iframe|object|svg|math|canvas|select|textarea|title|audio|video"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("head nav header footer aside form button menu dialog fieldset label datalist".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
# Class, id or role words that mark boilerplate, and those that mark an article.
_BAD = frozenset("ad ads adv advert adverts advertisement advertising adsense banner banners cookie cookies consent gdpr notice notices popup modal overlay promo promotion sponsor sponsored sidebar aside rail comment comments commentlist disqus respond reply replies share sharing social related recommended recommendation breadcrumb breadcrumbs pagination pager menu nav navbar navigation navigations footer header masthead topbar newsletter subscribe subscription signup login widget widgets toolbar skip alert complementary contentinfo search searchform".split())
# Of the boilerplate words those that also mark a single paragraph; other words may be about its subject.
_BAD_BLOCK = frozenset("ad ads advert adverts advertisement advertising adsense cookie consent gdpr sponsor sponsored newsletter promo promotion".split())
_GOOD = frozenset("article content main post entry story body text articlebody maincontent hentry".split())

_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Further elements of the language; any other name in a tag that does not close is taken for text.
_KNOWN = _VOID | _DROP | _INLINE | _HEADINGS | frozenset("html body main article section div p span ul ol li dl dt dd table thead tbody tfoot tr td th caption colgroup blockquote pre address figure figcaption details summary center hgroup search legend optgroup option output progress meter map picture font frame frameset noframes".split()) | frozenset(_RAW.split("|"))
# a quote reaches to its partner, however far that is; nothing of it is given back
_QUOTED = r"\"[^\"]*+\"|'[^']*+'"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    rf"|<(?P<raw>{_RAW})\b[^>]*?(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>[^<>\"']*(?:(?:{_QUOTED})[^<>\"']*)*)/?>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*)>|<[!?/][^>]*>|<(?P<cut>/?[a-zA-Z!][a-zA-Z0-9:-]*)[^<>]*\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_WORDS = re.compile(r"[a-z]+")


class Page:
    """Containers and text blocks of one page."""

    def __init__(self, html: str):
        self.parent, self.path, self.good_name, self.dropped = [-1], [0], [False], [False]
        # paths by number: the number of the path above and the last name; the first is the page's own
        self.names: list[tuple[int, str]] = [(-1, "")]
        self.numbers: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters in links
        self._read(html)

    def _open(self, tag: str, attrs: str, above: int, in_article: bool) -> int:
        name, bad, good = tag, False, tag in ("article", "main")
        if attrs:
            for key, value in _ATTR.findall(attrs):
                key, value = key.lower(), value.strip("\"'").lower()
                if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
                    bad = True
                elif key in ("class", "id", "role"):
                    words = set(_WORDS.findall(value))
                    bad |= bool(words & (_BAD_BLOCK if tag == "p" else _BAD)) and tag not in _HEADINGS
                    good |= bool(words & _GOOD)
                    if key == "class" and words:
                        name = f"{tag}.{re.sub(r'[0-9>]+', '', value.split()[0])}"
        if tag == "header" and in_article:
            bad = False
        elif tag in _DROP or bad and tag not in ("html", "body", "article", "main"):
            bad = True
        else:
            bad = False
        self.parent.append(above)
        step = (self.path[above], name)
        number = self.numbers.setdefault(step, len(self.names))
        if number == len(self.names):
            self.names.append(step)
        self.path.append(number)
        self.good_name.append(good)
        self.dropped.append(self.dropped[above] or bad)
        return len(self.parent) - 1

    def path_text(self, number: int) -> str:
        names = []
        while number > 0:
            number, name = self.names[number]
            names.append(name)
        return ">".join(["", *names[::-1]])

    def path_number(self, text: str) -> int:
        """The number of a path, -1 if the page does not have it."""
        number = 0
        for name in text.split(">")[1:]:
            number = self.numbers.get((number, name), -1)
            if number < 0:
                return -1
        return number

    def _read(self, html: str) -> None:
        stack, parts, at, in_link, links = [("", 0)], [], 0, False, 0
        articles = 0
        opened: dict[str, int] = {}  # how often each tag is on the stack
        skip, owner = -1, 0  # where the text of an inline element that is left out begins, and the container around it

        def flush() -> None:
            nonlocal links, skip
            if skip >= 0:
                del parts[skip:]
            c = owner if skip >= 0 else stack[-1][1]
            if parts:
                text = " ".join(unescape("".join(parts)).split())
                if text and not self.dropped[c]:
                    self.blocks.append((c, text, links))
                parts.clear()
            links, skip = 0, -1

        def push(tag: str, c: int) -> None:
            stack.append((tag, c))
            opened[tag] = opened.get(tag, 0) + 1

        def cut(k: int) -> None:
            nonlocal articles
            for t, _ in stack[k:]:
                opened[t] -= 1
                articles -= t in ("article", "main")
            del stack[k:]

        pos = 0
        while m := _TOKEN.search(html, pos):
            name = m["tag2"] or (m["cut"] or "").lstrip("/")
            if name and name[0] != "!" and name.lower() not in _KNOWN and "-" not in name and ":" not in name:
                pos = m.start() + 1  # a sign in the text, not a tag
                continue
            pos = m.end()
            if m.start() > at:
                parts.append(html[at : m.start()])
                if in_link:
                    links += m.start() - at
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if tag is None:
                continue
            tag, end, attrs = tag.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"]
            if tag == "a":
                in_link = not end
                continue
            if tag in _VOID:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    parts.append(" ")
                continue
            if tag in _INLINE and not (attrs and not end) and not any(t == tag for t, _ in stack[-3:]):
                continue
            if end:
                if not opened.get(tag):
                    if tag == "p":
                        flush()
                    continue
                k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag)
                if tag not in _INLINE:
                    flush()
                elif skip >= 0:
                    del parts[skip:]
                    skip = -1
                cut(k)
                continue
            if tag in _INLINE:
                if _ATTR.search(attrs):
                    c = self._open(tag, attrs, stack[-1][1], articles > 0)
                    if self.dropped[c] and not self.dropped[stack[-1][1]]:
                        skip, owner = len(parts), stack[-1][1]
                        push(tag, c)
                continue
            flush()
            if tag == "body":
                cut(2 if len(stack) > 1 and stack[1][0] == "html" else 1)
            while len(stack) > 1 and (stack[-1][0] == "p" or stack[-1][0] in _HEADINGS):
                cut(len(stack) - 1)  # these can't hold a block
            if tag in ("li", "tr", "td", "th", "dt", "dd", "option") and stack[-1][0] == tag:
                cut(len(stack) - 1)
            if tag in ("article", "main"):
                articles += 1
            if (tag == "p" or tag in _HEADINGS) and not attrs:
                push(tag, stack[-1][1])  # its text belongs to the container around it
            else:
                push(tag, self._open(tag, attrs, stack[-1][1], articles > 0))
        if at < len(html):
            parts.append(html[at:])
        flush()

    def weights(self) -> list[float]:
        """Text of each container with what it holds, links taken off."""
        out = [0.0] * len(self.parent)
        for c, text, links in self.blocks:
            out[c] += max(0, len(text) - 2 * links)
        for c in range(len(out) - 1, 0, -1):
            out[self.parent[c]] += out[c]
        return out

    def candidate(self) -> tuple[int, float]:
        """Number of the path and weight of the densest container that keeps most of the text.

        An article keeps all that is in it, so it is left only for a container with the very same text.
        """
        weights = self.weights()
        children: dict[int, list[int]] = {}
        for c in range(1, len(weights)):
            children.setdefault(self.parent[c], []).append(c)
        at = 0
        while own := children.get(at):
            best = max(own, key=lambda c: (weights[c] * (1.5 if self.good_name[c] else 1.0), -c))
            tag, above = (self.names[self.path[c]][1].partition(".")[0] for c in (best, at))
            if not self.good_name[at]:
                share = 0.4 if self.good_name[best] else DENSE
            elif above != "article" and (tag in ("article", "main") or self.good_name[best]):
                share = DENSE
            else:
                share = 1.0
            if weights[best] <= 0 or weights[best] < share * weights[at] or tag == "p" or tag in _HEADINGS or tag in ("li", "ul", "ol", "td", "tr", "blockquote", "pre"):
                break
            at = best
        return self.path[at], weights[at]

    def text(self, path: int) -> str:
        """Blocks in containers on that path or below one, in page order."""
        inside = [p == path for p in self.path]
        for c in range(1, len(inside)):
            inside[c] |= inside[self.parent[c]]
        return "\n\n".join(text for c, text, _ in self.blocks if inside[c])

    def extract(self, winners: list[str]) -> str:
        own, weight = self.candidate()
        found = sorted({n for w in winners if (n := self.path_number(w)) >= 0})
        if weight <= 0 or not found or own in found:
            return self.text(own)
        weights, by = self.weights(), {}
        for c, p in enumerate(self.path):
            if p in found:
                by[p] = by.get(p, 0) + weights[c]
        best = max(found, key=lambda p: (by[p], p))
        return self.text(best if by[best] > 0 else own)


def host(url) -> object:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[^/?#]*//([^/?#]*)", 1), F.lit("")))


def host_paths(pages: DataFrame, share: float = WINNING_SHARE) -> DataFrame:
    """(host, paths): the paths with at least that share of their host's votes, most votes first."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes: dict[tuple[str, str], float] = {}
        for batch in batches:
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(html)
                number, weight = page.candidate()
                path = page.path_text(number)
                if weight > 0:
                    votes[name, path] = votes.get((name, path), 0.0) + math.log1p(weight)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), pa.array(list(votes.values()), pa.float64())], ["host", "path", "votes"])

    votes = pages.where("html is not null").select(host(F.col("url")).alias("host"), "html").mapInArrow(vote, "host string, path string, votes double")
    votes = votes.groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    votes = votes.withColumn("all", F.sum("votes").over(Window.partitionBy("host"))).where(F.col("votes") >= share * F.col("all"))
    return votes.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path"))), lambda x: x["path"]).alias("paths"))


def _extract(html: pd.Series, paths: pd.Series) -> pd.Series:
    return pd.Series(["" if h is None else Page(h).extract([] if p is None else list(p)) for h, p in zip(html, paths, strict=True)], dtype=object)


def extract(pages: DataFrame, share: float = WINNING_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    from .session import settle

    winners = settle(host_paths(pages, share))
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    if winners.count() <= SENT_ROWS:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        winners = winners.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = rows.join(winners, ["host", "salt"], "left")
    return joined.withColumn("text", F.pandas_udf(_extract, "string")("html", "paths")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
