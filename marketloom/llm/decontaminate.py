"""Benchmark decontamination by CGK embeddings of item-sized windows.

Texts are sequences of words, and so is the edit distance: an item is found where a stretch of a text is at most `EDITS` of
the item's words away, counted in words changed, added or left out. The CGK walk writes the word it stands on and steps
on or stays by a random bit of (step, word), so strings a few edits apart fall into step again and agree on much of what
they write: edit distance becomes Hamming distance. Bit-sampling LSH keeps `SAMPLED` of the written words as a key; there
are `WALKS` walks with `SAMPLES` keys each, so that an item with the largest number of edits meets its copy in some key
with a probability above `RECALL` (measured in the tests, as walks fall out of step by chance). Every word of a document
begins a window of the length of each class of items. Windows that meet an item are verified by the exact edit distance
between the item and the nearest stretch of the text around the window.

Items fall into classes by length, each at most half as long again as its shortest, and a walk is as long as its class
needs. Before walking, windows go that hold more words foreign to all items of the class than an item's edits allow; that
loses nothing.

Defined results: items or texts without words never match; a null item_id or doc_id is carried as null; repeated rows give
repeated matches; empty tables give an empty result; other columns are ignored. Case and white space don't count.

Scale: documents are scanned once for each `ITEM_BYTES` of benchmark text and never shuffled; the items of one scan are
the only thing sent to tasks. A benchmark beyond that size is dealt over several scans, one after another, so that the
driver holds the items of one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import Words, chunks, mix
from .session import settle, unused

EDITS = 0.2  # largest edit distance, as a share of the item's words
SAMPLED = 3
WALKS, SAMPLES = 6, 12
RECALL = 0.9
GROWTH = 1.5
ITEM_BYTES = 32 << 20
AT_ONCE = 2048  # windows walked together
TEXT_BYTES = 1 << 20
_U = np.uint64


def nearest(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance between the words `item` and any stretch of the words `text`, with the stretch's begin and end."""
    n = len(text)
    steps = np.arange(n + 1)
    # distance and begin in one number, so that the minimum carries the begin along
    scale = n + 2
    row = steps.astype(np.int64)  # distance 0 at every begin
    for c in item:
        new = np.empty(n + 1, np.int64)
        new[0] = row[0] + scale
        np.minimum(row[:-1] + np.where(text == c, 0, scale), row[1:] + scale, out=new[1:])
        row = np.minimum.accumulate(new - steps * scale) + steps * scale
    end = int((row // scale).argmin())
    return int(row[end] // scale), int(row[end] % scale), end


class Items:
    """Items of one scan, prepared for matching."""

    def __init__(self, ids: list, texts: list[str], edits: float = EDITS):
        words = Words(pa.array(texts, pa.string()))
        self.ids = ids
        self.words = [words.hash[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
        self.sizes = np.diff(words.bounds)
        self.edits = np.floor(edits * self.sizes + 1e-9).astype(np.int64)
        known = np.flatnonzero(self.sizes)
        level = np.floor(np.log(np.maximum(self.sizes, 1)) / math.log(GROWTH) + 1e-9).astype(int)
        levels = sorted(set(level[known].tolist()))
        self.least, self.foreign, self.sampled = [], [], []
        keys, items = [], []
        vocabulary = np.unique(words.hash)
        self.classes = np.zeros((len(levels), len(vocabulary)), bool)
        steps = 2 * int(self.sizes.max(initial=1))
        self.seeds = np.random.default_rng(20240607).integers(1, 1 << 63, (steps, WALKS), dtype=np.uint64)
        for c, k in enumerate(levels):
            own = known[level[known] == k]
            self.least.append(int(self.sizes[own].min()))
            self.foreign.append(int(self.edits[own].max()))
            length = 2 * self.least[c]
            draw = np.random.default_rng(k)
            self.sampled.append(np.stack([np.sort(draw.choice(length, min(SAMPLED, length), replace=False)) for _ in range(SAMPLES * WALKS)]).reshape(WALKS, SAMPLES, -1))
            self.classes[c, np.searchsorted(vocabulary, np.unique(np.concatenate([self.words[i] for i in own])))] = True
            for at in range(0, len(own), AT_ONCE):
                some = own[at : at + AT_ONCE]
                found = self.keys(c, self.walk(words.hash, words.bounds[some], words.bounds[some + 1], length))
                keys.append(found.ravel())
                items.append(np.repeat(some, WALKS * SAMPLES))
        self.vocabulary = vocabulary
        self.table, self.items = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, items))
        order = np.argsort(self.table, kind="stable")
        self.table, self.items = self.table[order], self.items[order]

    def walk(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
        """Written words: steps x walks x windows."""
        out = np.zeros((length, WALKS, len(start)), np.uint64)
        i = np.repeat(start[None, :], WALKS, 0)
        last = max(len(hashes) - 1, 0)
        with np.errstate(over="ignore"):
            for step in range(length):
                word = hashes[np.minimum(i, last)]
                word[i >= end] = 0
                out[step] = word
                i += (mix(word + self.seeds[step][:, None]) & _U(1)).astype(np.int64)
        return out

    def keys(self, c: int, written: np.ndarray) -> np.ndarray:
        """Keys of windows: windows x (walks * samples)."""
        out = np.zeros((WALKS, SAMPLES, written.shape[2]), np.uint64)
        with np.errstate(over="ignore"):
            for w in range(WALKS):
                for j in range(self.sampled[c].shape[2]):
                    out[w] = mix(out[w] * _U(0x9E3779B97F4A7C15) + written[self.sampled[c][w, :, j], w])
            out += mix(np.arange(WALKS * SAMPLES, dtype=np.uint64) + _U(1 + (c << 16))).reshape(WALKS, SAMPLES, 1)
        return out.reshape(WALKS * SAMPLES, -1).T

    def meet(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word index, item index) pairs of windows and items that share a key, sorted."""
        found = [np.zeros((0, 2), np.int64)]
        n = len(words.hash)
        if n and len(self.table):
            ends = words.bounds[words.row + 1]
            at = np.arange(n)
            place = np.minimum(np.searchsorted(self.vocabulary, words.hash), len(self.vocabulary) - 1)
            place[self.vocabulary[place] != words.hash] = -1
            for c, least in enumerate(self.least):
                known = np.append(self.classes[c], False)[place]
                sums = np.concatenate([[0], np.cumsum(known)])
                near = np.flatnonzero(sums[np.minimum(at + least, ends)] - sums[:-1] >= least - self.foreign[c])
                for lo in range(0, len(near), AT_ONCE):
                    own = near[lo : lo + AT_ONCE]
                    asked = self.keys(c, self.walk(words.hash, own, ends[own], 2 * least))
                    first = np.searchsorted(self.table, asked)
                    hit = self.table[np.minimum(first, len(self.table) - 1)] == asked
                    w, _ = np.nonzero(hit)
                    first, key = first[hit], asked[hit]
                    times = np.searchsorted(self.table, key, "right") - first
                    which = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
                    found.append(np.unique(np.stack([np.repeat(own[w], times), self.items[which]], 1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def matches(self, column: pa.Array) -> list[tuple[int, int, int, int, int, float]]:
        """(row, item, first word, end word, distance, similarity): for each row and item its best stretch."""
        words = Words(column)
        at, item = self.meet(words)
        best, last = {}, {}
        for w, k in zip(at.tolist(), item.tolist(), strict=True):
            row = int(words.row[w])
            if best.get((row, k), (1,))[0] == 0 or w < last.get((row, k), -1):
                continue
            size, slack = int(self.sizes[k]), int(self.edits[k]) + 2
            begin, end = max(int(words.bounds[row]), w - slack), min(int(words.bounds[row + 1]), w + size + 2 * slack)
            last[row, k] = w + slack  # a window as near as this has been searched along with it
            distance, b, e = nearest(self.words[k], words.hash[begin:end])
            if distance <= self.edits[k] and distance < best.get((row, k), (distance + 1,))[0]:
                first = begin - int(words.bounds[row])
                best[row, k] = (distance, first + b, first + e)
        return [(row, k, b, e, d, 1 - d / int(self.sizes[k])) for (row, k), (d, b, e) in best.items()]


def matches(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, first_word, end_word, distance, similarity): the passages of `docs` that are items or nearly so."""
    doc_kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {doc_kind}, item_id {item_kind}, first_word long, end_word long, distance long, similarity double"
    items = benchmark.where("text is not null").select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    scans = max(1, -(-2 * size // item_bytes))
    out = []
    for scan in range(scans):
        own = (items if scans == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(scans)) == scan)).collect()
        own = [r for r in own if r["text"].split()]
        if own:
            found = docs.select("doc_id", "text").mapInArrow(_scan([r["item_id"] for r in own], [r["text"] for r in own], edits, docs, items), schema)
            out.append(found if scans == 1 else settle(found))
    return reduce(DataFrame.unionByName, out) if out else docs.sparkSession.createDataFrame([], schema)


def _scan(ids, texts, edits, docs, items):
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(items.schema["item_id"].dataType)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = Items(ids, texts, edits)
        for part in chunks(batches, limit=TEXT_BYTES):
            found = prepared.matches(part.column(1))
            rows = part.column(0).take(pa.array([f[0] for f in found], pa.int64()))
            rest = [pa.array([f[j] for f in found], pa.int64() if j < 5 else pa.float64()) for j in range(2, 6)]
            yield pa.RecordBatch.from_arrays([rows, pa.array([prepared.ids[f[1]] for f in found], kind), *rest], ["doc_id", "item_id", "first_word", "end_word", "distance", "similarity"])

    return scan


def without_benchmark(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """`docs` without the documents that hold a benchmark item; rows without doc_id all stay."""
    held = unused(docs, "held")
    found = settle(matches(docs, benchmark, edits).select(F.col("doc_id").alias(held)).distinct())
    return docs.join(found, F.col("doc_id") == F.col(held), "left_anti")
