"""MinHash near-dedup with ProbMinHash.

Weighted shingles (five words, weight 1 + log2(count)) arrive as Poisson processes: an element's arrivals have
exponential gaps divided by its weight, each falls on a random register, and an element stops when its next arrival is
later than the latest register of its text. The element that comes first keeps a register, so two texts agree on a
register with their probability Jaccard. Bands of `ROWS` registers make buckets; links are verified on the exact shingle
sets (Jaccard of at least `threshold`); linked texts form classes named by their smallest doc_id.

Inside a bucket no list of all pairs is made. First every text meets the smallest id of its buckets, and classes are
formed. A bucket whose members are then all of one class is done. The others are cut into blocks of about `BLOCK`
shingles, and for each two blocks the texts of different classes are compared exactly in one task: shingles are ordered
from rare to frequent, only a text whose rarest fifth meets a text of another class is compared at all (no two others can
reach the threshold), and a link found joins their classes at once. So every two texts of a bucket are compared or
already in one class, no link between different texts is lost, and what leaves a task is at most one link for each text.

The threshold is that of exact five-word shingle sets: in a text of 200 words, five changed words far apart already take
it below 0.8, and such texts are no near copies here.

Defined results: copies of a text are one class whatever its length; a doc_id stands for one document, so rows that share
it share a class, and a link of any of their texts counts; a text without words, or null, is a class of its
own, and so is a row whose doc_id is null; texts of fewer than five words have one shingle of all their words; repeated
rows share a class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .packed import Words, chunks, mix, shingles
from .session import empty, having, settle, unused

BANDS, ROWS = 16, 5
THRESHOLD = 0.8
BLOCK = 1 << 19
_U = np.uint64


def elements(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: row, 44-bit id, count; sorted by row and id."""
    hashes, row, _ = shingles(Words(column))
    keys = np.sort((row.astype(np.uint64) << _U(44)) | (hashes >> _U(20)))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return (keys >> _U(44)).astype(np.int64), keys & _U((1 << 44) - 1), counts


def prob_minhash(row: np.ndarray, ids: np.ndarray, weights: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m ids: for each text and register the element whose arrival is first; 0 where a text has no element."""
    first, kept = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    times = np.zeros(len(ids))
    k = 0
    with np.errstate(over="ignore"):
        while len(ids):
            k += 1
            draw = mix(ids * _U(0x9E3779B97F4A7C15) + _U(k * 0xD1342543DE82EF95 & (1 << 64) - 1))
            times = times - np.log(((draw >> _U(11)).astype(float) + 0.5) * 2.0**-53) / weights
            if k > 1:  # early termination: later than the latest register
                live = times < latest[row]
                row, ids, weights, times, draw = row[live], ids[live], weights[live], times[live], draw[live]
            at = row * m + (mix(draw) % _U(m)).astype(np.int64)
            np.minimum.at(first, at, times)
            won = first[at] == times
            kept[at[won]] = ids[won]
            latest = first.reshape(n, m).max(1) if n else first
    return kept.reshape(n, m)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    m = BANDS * ROWS
    for part in chunks(batches):
        row, ids, counts = elements(part.column(1))
        n = part.num_rows
        kept = prob_minhash(row, ids, 1 + np.log2(counts), n, m)
        some = np.bincount(row, minlength=n) > 0
        bands = np.zeros((n, BANDS), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(ROWS):
                bands = mix(bands * _U(0xBF58476D1CE4E5B9) + kept.reshape(n, BANDS, ROWS)[:, :, j])
            bands = mix(bands + np.arange(BANDS, dtype=np.uint64)[None, :]).view(np.int64)
        digests = [hashlib.md5(t.as_buffer() or b"", usedforsecurity=False).digest() if s else None for t, s in zip(part.column(1), some, strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
        sizes = pa.array(np.bincount(row, minlength=n).astype(np.int64))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), lists, sizes], ["doc_id", "digest", "bands", "shingles"])


def jaccard(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Jaccard of the five-word shingle sets of two columns, row by row; 0 where either has none."""
    keys = []
    sizes = []
    for column in (a, b):
        row, ids, _ = elements(column)
        keys.append((row.astype(np.uint64) << _U(44)) | ids)
        sizes.append(np.bincount(row, minlength=len(column)))
    both = np.intersect1d(*keys, assume_unique=True)
    common = np.bincount((both >> _U(44)).astype(np.int64), minlength=len(a))
    return common / np.maximum(sizes[0] + sizes[1] - common, 1)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) pairs whose texts reach the threshold, with their similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text_b", 2 << 20):
            for at in range(0, part.num_rows, 512):
                p = part.slice(at, 512)
                s = jaccard(p.column(2), p.column(3))
                yield pc_filter(pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(s)], ["a", "b", "similarity"]), s >= threshold)

    first = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long, similarity double")


def pc_filter(batch: pa.RecordBatch, keep: np.ndarray) -> pa.RecordBatch:
    return batch.filter(pa.array(keep))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle ids of each text."""
    for part in chunks(batches):
        row, ids, _ = elements(part.column(1))
        edges = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(edges), pa.array(ids.view(np.int64)))], ["id", "set"])


def block_links(ids: np.ndarray, classes: np.ndarray, side: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links between texts of different classes that reach the threshold; a forest, not all pairs.

    side: 0 or 1 where two blocks meet, and only texts of different sides are compared; all 0 inside one block.
    """
    n = len(ids)
    sizes = np.array([len(x) for x in sets])
    tokens = np.concatenate(sets) if n else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, token, df = np.unique(tokens, return_inverse=True, return_counts=True)
    # of each text its shingles from rare to frequent; of each shingle the texts that hold it
    order = np.lexsort((token, df[token], owner))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    by_token = np.argsort(token, kind="stable")
    posting = np.concatenate([[0], np.cumsum(df)])
    holders = owner[by_token]
    _, group = np.unique(classes, return_inverse=True)
    members = {g: np.flatnonzero(group == g).tolist() for g in np.unique(group)}
    largest = max(members, key=lambda g: len(members[g])) if members else None
    two = len(np.unique(side)) > 1
    out = []
    for x in np.flatnonzero(group != largest):
        own = token[order[starts[x] : starts[x + 1]]]
        prefix = own[: len(own) - int(np.ceil(threshold * len(own) - 1e-9)) + 1]
        near = np.concatenate([holders[posting[t] : posting[t + 1]] for t in prefix[df[prefix] > 1]] or [np.zeros(0, np.int64)])
        near = near[group[near] != group[x]]
        if two:
            near = near[side[near] != side[x]]
        if not len(near):
            continue
        near = np.unique(near)
        shared = np.bincount(np.concatenate([holders[posting[t] : posting[t + 1]] for t in own]), minlength=n)[near]
        similarity = shared / (sizes[x] + sizes[near] - shared)
        for y in near[similarity >= threshold]:
            if group[y] != group[x]:
                out.append((int(ids[x]), int(ids[y])))
                keep, gone = (group[y], group[x]) if len(members[group[y]]) >= len(members[group[x]]) else (group[x], group[y])
                group[members[gone]] = keep
                members[keep] += members.pop(gone)
    return out


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id) for every row of `docs`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = settle(rows.mapInArrow(_sketch, "doc_id long, digest binary, bands array<long>, shingles long"))
    known = sketched.where("doc_id is not null and digest is not null")
    # copies of a text: the smallest id stands for all of them
    distinct = settle(known.groupBy("digest").agg(F.min(F.struct("doc_id", "bands", "shingles")).alias("m")).select("digest", F.col("m.doc_id").alias("id"), F.col("m.bands").alias("bands"), F.col("m.shingles").alias("shingles")))
    buckets = distinct.select("id", "shingles", F.explode(F.array_distinct("bands")).alias("key"))
    # grouped counts combine before the shuffle; joining them back leaves a hot bucket's rows free to be split
    shared = buckets.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("top")).where("lead < top").drop("top")
    members = settle(buckets.join(shared, "key"))
    texts = settle(having(rows, members.select(F.col("id").alias("doc_id"))))
    leads = members.groupBy("id").agg(F.min("lead").alias("a")).where("a < id").select("a", F.col("id").alias("b"))
    links = settle(verified(leads, texts, threshold).select("a", "b"))
    named = settle(components(links).withColumnRenamed("id", "of"))
    placed = members.join(named, F.col("id") == F.col("of"), "left").select("key", "id", "shingles", F.coalesce("component", "id").alias("c"))
    several = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.sum("shingles").alias("all")).where("low < high")
    blocks = F.ceil(F.col("all") / BLOCK).cast("int")
    left = settle(placed.join(several.select("key", blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int")).drop("shingles"))
    if not empty(left):
        other = left.select("key", "id", "c", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        meetings = other.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "c")
        sets = texts.join(left.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_sets, "id long, set array<long>").distinct()

        def compare(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            lists = [np.asarray(x.values) for x in table["set"]]
            found = block_links(table["id"].to_numpy(), table["c"].to_numpy(), table["side"].to_numpy(), lists, threshold)
            return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

        more = meetings.join(sets, "id").groupBy("key", "lo", "hi").applyInArrow(compare, "a long, b long")
        named = settle(components(links.unionByName(settle(more))).withColumnRenamed("id", "of"))
    of = distinct.join(named, F.col("id") == F.col("of"), "left").select("digest", F.coalesce("component", "id").alias("class_id"))
    out = sketched.select("doc_id", "digest").join(of, "digest", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with one row of each class, that of the smallest doc_id; rows without doc_id all stay."""
    from pyspark.sql import Window

    of, nth = unused(docs, "stays"), unused(docs, "nth")
    stay = classes(docs, threshold).where("doc_id = class_id").select(F.col("doc_id").alias(of)).distinct()
    named = docs.where("doc_id is not null").join(stay, F.col("doc_id") == F.col(of))
    # repeated rows: the join has already brought a doc_id's rows together
    first = F.row_number().over(Window.partitionBy(of).orderBy(F.col("text").desc_nulls_last()))
    named = named.withColumn(nth, first).where(F.col(nth) == 1).drop(nth, of)
    return named.unionByName(docs.where("doc_id is null"))
