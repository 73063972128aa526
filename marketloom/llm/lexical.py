"""Exact lexical ranking of documents by a sparse ball tree.

A document is a sparse vector over the terms that occur in the items: a term's component is (1000000000 * tf) div
(1000 * tf + 8 * m), an item's component is its weight w, both whole numbers, and a score is their inner product. Vectors of
similar documents are brought together and cut into trees of balls: a ball has a centroid c (over the terms its documents
hold, in single precision) and a radius R, the largest distance of a document from that centroid as it is stored. No
document of a ball scores above q.c + |q'| R, where q' is the part of the item on terms that the ball holds; that bound is
raised by more than all rounding can cost. An item visits balls best-first and drops what can't reach its bar, the score of
its k-th document so far; leaves are scored in whole numbers, so bounds decide the work and never the result.

Terms are the maximal runs of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]`, only A-Z lower-cased, compared as strings.
N, L, df and lengths are taken over all documents. A first visit of each tree down to one leaf for each item gives bars for the
whole search of all trees.

Defined results: a document is a row, so rows that repeat a doc_id are ranked each; a null text has no terms, is not counted
and never found; equal scores go by doc_id, null last; an item without terms, or whose terms no document holds, has no
rows; repeated rows of an item are ranked each under the same item_id, a null item_id is carried; empty tables give an
empty result; other columns are ignored.

Scale: texts are read once, tokenised inside tasks and never shuffled; vectors over the items' terms are dealt by nearest
pivot and length in ranges that split hot groups of copies, and cut into trees of at most `TREE_TERMS` components. Sent to all
tasks are the items, their terms and weights, of at most `ITEM_BYTES` of text a time: a larger set of items is dealt over
several searches of the same vectors. Pivots come from about `SAMPLE` documents, at most twice as many, and only bring neighbours together.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packed import buffer, chunks
from .session import hash_share, partitions, settle

K = 10
PIVOTS = 32
SAMPLE = 2000  # documents that pivots are chosen from
TREE_TERMS = 1 << 20  # components of a tree
LEAF = 32
ITEM_BYTES = 64 << 20
_TERM = np.ones(256, bool)
_TERM[:128] = False
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of all texts, one after the other, and the text that each stands in."""
    data, offsets = buffer(column)
    inside = _TERM[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = inside[begins]
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    places = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(places), pa.py_buffer(_LOWER[data[inside]]))
    return words, np.searchsorted(offsets, start, "right") - 1


def counted(column: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length of each text in terms, row, term of `vocabulary`, times), the last three sorted by row and term."""
    words, row = terms(column)
    place = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy()
    known = place >= 0
    key, times = np.unique(row[known] * max(len(vocabulary), 1) + place[known], return_counts=True)
    row_of, term = np.divmod(key, max(len(vocabulary), 1))
    return np.bincount(row, minlength=len(column)), row_of, term, times


class Items:
    """Items of one search: their terms as places in the sorted vocabulary of all."""

    def __init__(self, ids: list, texts: list[str]):
        words, row = terms(pa.array(texts, pa.large_string()))
        self.ids = ids
        self.vocabulary = pc.unique(words).sort()
        place = pc.index_in(words, value_set=self.vocabulary).to_numpy()
        key = np.unique(row * max(len(self.vocabulary), 1) + place)
        owner, self.terms = np.divmod(key, max(len(self.vocabulary), 1))
        self.bounds = np.searchsorted(owner, np.arange(len(ids) + 1))


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def impacts(lengths: np.ndarray, owner: np.ndarray, times: np.ndarray, n: int, total: int) -> np.ndarray:
    """Components of the terms that occur `times` in texts of those lengths; products beyond 64 bits are taken in full."""
    known, which = np.unique(lengths, return_inverse=True)
    m = np.array([10 + 90 * int(x) * n // total for x in known.tolist()], np.int64)[which][owner]
    return 1_000_000_000 * times // (1000 * times + 8 * m)


class Tree:
    """A ball tree over sparse vectors: (ids, bounds of each vector, term, component)."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, term: np.ndarray, x: np.ndarray):
        self.own = np.unique(term)
        # balls as (terms held, centroid on them, radius), and below each two balls or the documents of a leaf
        self.ids, self.nodes, self.kids, self.leaves = ids, [], [], []
        self.bounds, self.term, self.x = bounds, np.searchsorted(self.own, term), x
        self._split(np.arange(len(ids)))

    def _gather(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.bounds[docs + 1] - self.bounds[docs]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.bounds[docs], n)
        return np.repeat(np.arange(len(docs)), n), self.term[at], self.x[at]

    def _split(self, docs: np.ndarray) -> int:
        """Adds the ball of these documents and those below it; the ball's number."""
        row, term, x = self._gather(docs)
        centre = (np.bincount(term, x, len(self.own)) / len(docs)).astype(np.float32)
        held = np.flatnonzero(np.bincount(term, minlength=len(self.own)))
        # |x - c|**2 = |c|**2 + sum of (x - c)**2 - c**2 over the document's own terms
        c = centre.astype(float)
        away = np.bincount(row, (x - c[term]) ** 2 - c[term] ** 2, len(docs)) + (c * c).sum()
        scale = (c * c).sum() + (x.astype(float) ** 2).max(initial=0.0) * len(self.own)
        radius = math.sqrt(max(away.max(), 0.0) + 1e-12 * scale) * (1 + 1e-9)
        number = len(self.nodes)
        self.nodes.append((held, c[held], radius))
        self.leaves.append(None)
        self.kids.append(docs)
        if len(docs) <= LEAF:
            return number
        # the halves nearer to either of two documents that are far apart
        a = int(away.argmax())
        along = self._dots(row, term, x, a, len(docs))
        size = np.bincount(row, x.astype(float) ** 2, len(docs))
        b = int((size - 2 * along).argmax())
        order = np.argsort(along - self._dots(row, term, x, b, len(docs)), kind="stable")
        half = len(docs) // 2
        self.kids[number] = (self._split(docs[order[:half]]), self._split(docs[order[half:]]))
        return number

    def _dots(self, row, term, x, one: int, n: int) -> np.ndarray:
        dense = np.zeros(len(self.own))
        dense[term[row == one]] = x[row == one]
        return np.bincount(row, x * dense[term], n)

    def bound(self, node: int, q: np.ndarray) -> float:
        """More than any document of the ball can score; `q` holds an item's weights by the tree's terms."""
        held, centre, radius = self.nodes[node]
        own = q[held]
        return (own @ centre + math.sqrt(own @ own) * radius) * (1 + 1e-9) + 1.0

    def _leaf(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the components, held terms x documents, of a leaf; made when it is first scored."""
        if self.leaves[node] is None:
            docs, held = self.kids[node], self.nodes[node][0]
            row, term, x = self._gather(docs)
            table = np.zeros((len(held), len(docs)), np.int64)
            table[np.searchsorted(held, term), row] = x
            self.leaves[node] = self.ids[docs], table
        return self.leaves[node]

    def search(self, term: np.ndarray, w: np.ndarray, k: int, bar: int, leaves: int | None = None) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id) that score at least `bar` and more than 0, best-first; and how many leaves were scored.

        At most `leaves` leaves are visited if that is given.
        """
        place = np.searchsorted(self.own, term)
        shared = np.flatnonzero(self.own[np.minimum(place, len(self.own) - 1)] == term)
        if not len(shared):
            return [], 0
        whole = np.zeros(len(self.own), np.int64)
        whole[place[shared]] = w[shared]
        q, bar = whole.astype(float), max(bar, 1)
        found: list[tuple[int, int]] = []  # a heap with the worst on top
        heap, seen = [(-self.bound(0, q), 0)], 0
        while heap and (leaves is None or seen < leaves):
            top, node = heapq.heappop(heap)
            if -top < bar:
                break
            if isinstance(self.kids[node], tuple):
                for kid in self.kids[node]:
                    b = self.bound(kid, q)
                    if b >= bar:
                        heapq.heappush(heap, (-b, kid))
                continue
            ids, table = self._leaf(node)
            own, seen = whole[self.nodes[node][0]], seen + 1
            some = np.flatnonzero(own)
            scores = own[some] @ table[some]
            for i in np.flatnonzero(scores >= bar).tolist():
                # equal scores go by id, null (the largest number) last
                heapq.heappush(found, (int(scores[i]), -int(ids[i])))
                if len(found) > k:
                    heapq.heappop(found)
            if len(found) == k:
                bar = max(bar, found[0][0])
        return [(s, -i) for s, i in found], seen


#: stands for a null doc_id, as it comes last among equal scores
NO_ID = np.iinfo(np.int64).max


def _vectors(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(doc_id, n, terms, times) of all documents with terms; terms and times are bytes of 32-bit numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, limit=1 << 20):
            n, row, term, times = counted(part.column(1), vocabulary)
            bounds = np.searchsorted(row, np.arange(len(n) + 1))
            kept = np.flatnonzero(n)
            lists = [pa.array([x[bounds[i] : bounds[i + 1]].tobytes() for i in kept], pa.binary()) for x in (term.astype(np.int32), times.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pc.fill_null(part.column(0).take(pa.array(kept)), NO_ID), pa.array(n[kept]), *lists], ["doc_id", "n", "terms", "times"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "doc_id long, n long, terms binary, times binary")


def _frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(_flat(b.column(0)), minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    out = np.zeros(size, np.int64)
    # one number for each term of the items
    for term, df in vectors.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        out[term] = df
    return out


def _flat(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32)


def _pivots(vectors: DataFrame, n: int, total: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Documents of a sample, each far from those before it: (terms, components over its length)."""
    sample = hash_share(vectors, SAMPLE, n, "doc_id", "terms").where("octet_length(terms) > 0").collect()
    if not sample:
        return []
    parts = [(np.frombuffer(r["terms"], np.int32), np.frombuffer(r["times"], np.int32).astype(np.int64), r["n"]) for r in sample]
    rows = [(t, impacts(np.array([m]), np.zeros(len(t), int), times, n, total).astype(float)) for t, times, m in parts]
    rows = [(t, x / math.sqrt(x @ x)) for t, x in rows]
    own = np.unique(np.concatenate([t for t, _ in rows]))
    owner, term, x = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows]), np.searchsorted(own, np.concatenate([t for t, _ in rows])), np.concatenate([x for _, x in rows])
    best, chosen = np.full(len(rows), -1.0), [0]
    while len(chosen) < min(PIVOTS, len(rows)):
        dense = np.zeros(len(own))
        dense[np.searchsorted(own, rows[chosen[-1]][0])] = rows[chosen[-1]][1]
        best = np.maximum(best, np.bincount(owner, x * dense[term], len(rows)))
        chosen.append(int(best.argmin()))
    return [rows[i] for i in chosen]


def _trees(vectors: DataFrame, pivots: list, n: int, total: int) -> DataFrame:
    """(tree, ids, bounds, terms, components): documents with components, near ones together, in trees that fit a task."""
    own = np.unique(np.concatenate([t for t, _ in pivots])) if pivots else np.zeros(0, np.int32)
    dense = np.zeros((len(own) + 1, len(pivots)), np.float32)  # the last row is that of terms that no pivot holds
    for j, (t, x) in enumerate(pivots):
        dense[np.searchsorted(own, t), j] = x

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(pc.binary_length(b.column(2)), np.int64) // 4
            bounds, term, times = np.concatenate([[0], np.cumsum(sizes)]), _flat(b.column(2)), _flat(b.column(3)).astype(np.int64)
            x = impacts(b.column(1).to_numpy(), np.repeat(np.arange(len(sizes)), sizes), times, n, total).astype(np.int32)
            place = np.searchsorted(own, term)
            place[place < len(own)] = np.where(own[place[place < len(own)]] == term[place < len(own)], place[place < len(own)], len(own))
            near = []
            for i in range(len(sizes)):
                at = slice(bounds[i], bounds[i + 1])
                near.append(int((x[at].astype(np.float32) @ dense[place[at]]).argmax()))
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), b.column(0), b.column(1), b.column(2), pa.array([x[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(sizes))], pa.binary())], ["pivot", "doc_id", "n", "terms", "x"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms_, xs, held = [], [], [], 0

        def tree():
            sizes = np.array([len(t) // 4 for t in terms_])
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (np.array(ids).tobytes(), np.concatenate([[0], np.cumsum(sizes)]).tobytes(), b"".join(terms_), b"".join(xs))], ["ids", "bounds", "terms", "x"])

        for b in batches:
            for doc, t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if held and held + len(t) // 4 > TREE_TERMS:
                    yield tree()
                    ids, terms_, xs, held = [], [], [], 0
                ids.append(doc)
                terms_.append(t)
                xs.append(x)
                held += len(t) // 4
        if ids:
            yield tree()

    near = vectors.where("octet_length(terms) > 0").mapInArrow(nearest, "pivot int, doc_id long, n long, terms binary, x binary")
    dealt = near.repartitionByRange(partitions(vectors.sparkSession), "pivot", "n", "doc_id").sortWithinPartitions("pivot", "n", "doc_id")
    return dealt.select("doc_id", "terms", "x").mapInArrow(cut, "ids binary, bounds binary, terms binary, x binary")


def rank(docs: DataFrame, items: DataFrame, k: int = K, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item that score above 0."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    schema = f"item_id {kind}, rank int, doc_id long, score long"
    asked = items.where("text is not null").select("item_id", "text")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    searches, out = max(1, -(-2 * size // item_bytes)), None
    for search in range(searches):
        own = (asked if searches == 1 else asked.where(F.pmod(F.xxhash64("text"), F.lit(searches)) == search)).collect()
        found = _search(docs, Items([r["item_id"] for r in own], [r["text"] for r in own]), k)
        if found is not None:
            ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], f"item int, item_id {kind}")
            found = found.join(F.broadcast(ids), "item").select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def _search(docs: DataFrame, items: Items, k: int) -> DataFrame | None:
    """(item, rank, doc_id, score); none if no document can be found."""
    if not len(items.vocabulary):
        return None
    vectors = settle(_vectors(docs, items.vocabulary))
    n, total = vectors.agg(F.count("*"), F.sum("n")).first()
    if not n:
        return None
    w = weights(_frequencies(vectors, len(items.vocabulary)), n)
    # terms that no document holds can't add to a score
    trees = settle(_trees(vectors, _pivots(vectors, n, total), n, total))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")

    def visit(bars: np.ndarray, leaves: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = bars.copy()
            for b in batches:
                for r in b.to_pylist():
                    tree = Tree(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["bounds"], np.int64), np.frombuffer(r["terms"], np.int32), np.frombuffer(r["x"], np.int32).astype(np.int64))
                    out = []
                    for i in range(len(items.ids)):
                        term = items.terms[items.bounds[i] : items.bounds[i + 1]]
                        best, _ = tree.search(term, w[term], k, int(known[i]), leaves)
                        out += [(i, doc, s) for s, doc in best]
                        if len(best) == k:  # k documents score as much: the next tree must do better
                            known[i] = max(known[i], min(best)[0])
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True) if out else ((), (), ()), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "doc_id", "score"])

        hits = trees.mapInArrow(run, "item int, doc_id long, score long")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    bars = np.zeros(len(items.ids), np.int64)
    for item, score in visit(bars, 1).where(F.col("rank") == k).select("item", "score").collect():
        bars[item] = score
    return visit(bars, None).select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = r"""
with t as (select row_number() over () as d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents where text is not null),
s as (select count(distinct d) as n_docs, count(*) as all_terms from t),
l as (select d, count(*) as n from t group by d),
f as (select d, doc_id, term, count(*) as tf from t group by d, doc_id, term),
w as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from f, s group by term),
q as (select distinct i, item_id, term from (select row_number() over () as i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark)),
r as (select i, item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * n * n_docs) // all_terms)))))::bigint as score
  from q join f using (term) join w using (term) join l using (d), s group by i, item_id, d, doc_id)
select item_id, (row_number() over (partition by i order by score desc, doc_id))::int as rank, doc_id, score
from r where score > 0 qualify rank <= 10
"""
