"""Language identification by nearest centroid.

A text is a vector of character n-grams (1 to 3 letters, words padded by a blank), hashed to `DIMENSIONS` features,
damped by 1 + log(count), weighed by inverse document frequency and normalised. Each language has several centroids,
found by spherical k-means over its training vectors, since one language may hold prose, tables and noise. The nearest
centroid by cosine names the language; a text farther from it than nearly all training texts of that language is
rejected.

Document frequencies are counted over all training rows; clustering reads a bounded sample of `sample` rows for each
language, taken by a digest of doc_id and text, repeated rows once. The model (languages x clusters x features) is the only thing sent to tasks.

Defined results: null text or text without a letter (Unicode category L, in any plane) is `und` with score 0; with no training rows every text is `und`;
repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import chunks
from .session import held_out

DIMENSIONS = 4096
SAMPLE = 1500
CLUSTERS = 4
REJECT_SHARE = 0.002
UND = "und"
_tables: tuple[np.ndarray, np.ndarray] | None = None


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its code in n-grams (0: none, marks on letters have one), and whether it is a letter.

    Letters beyond the basic plane count as one class for each block of 256.
    """
    global _tables
    if _tables is None:
        letter = np.fromiter((unicodedata.category(chr(cp))[0] == "L" for cp in range(0x110000)), bool, 0x110000)
        points = np.arange(0x110000, dtype=np.uint32)
        code = np.where(letter, np.where(points < 0x10000, points, (points >> 8) | 0x10000), 0).astype(np.uint32)
        code[0x300:0x370] = points[0x300:0x370]
        _tables = code, letter
    return _tables


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Damped n-gram counts (texts x DIMENSIONS) and whether each text has a letter."""
    texts = pc.utf8_lower(pc.fill_null(column, pa.scalar("", column.type))).to_pylist()
    n = len(texts)
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, n) + 1
    row = np.repeat(np.arange(n), sizes)
    codes, letters = _codes()
    code = codes[points].astype(np.uint64)
    lettered = np.bincount(row, letters[points], n) > 0
    counts = np.zeros((n, DIMENSIONS), np.float32)
    before, after = np.concatenate([[0], code[:-1]]).astype(np.uint64), np.concatenate([code[1:], [0]]).astype(np.uint64)
    with np.errstate(over="ignore"):
        two = before * np.uint64(0x9E3779B97F4A7C15) + code
        three = two * np.uint64(0xD1342543DE82EF95) + after + np.uint64(1)
    for gram, use in ((code * np.uint64(0xBF58476D1CE4E5B9), code > 0), (two * np.uint64(0x94D049BB133111EB), (code > 0) | (before > 0)), (three * np.uint64(0x9E3779B97F4A7C15), code > 0)):
        at = (row[use] * DIMENSIONS + (gram[use] >> np.uint64(52)).astype(np.int64))
        counts += np.bincount(at, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
    np.log1p(counts, out=counts)
    return counts, lettered


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # languages * clusters rows
    owner: np.ndarray  # the language of each centroid
    floor: np.ndarray  # least cosine for each language

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, cosines and whether each text was rejected."""
        if not self.languages:
            return [UND] * len(column), np.zeros(len(column)), np.ones(len(column), bool)
        counts, lettered = vectors(column)
        cosine = _normal(counts * self.idf) @ self.centroids.T
        best = cosine.argmax(1)
        score = np.clip(np.where(lettered, cosine[np.arange(len(best)), best], 0.0), 0.0, 1.0).astype(float)
        owner = self.owner[best]
        return [self.languages[o] if ok else UND for o, ok in zip(owner, lettered, strict=True)], score, (score < self.floor[owner]) | ~lettered


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text", 1 << 20):
        for at in range(0, part.num_rows, 1024):
            yield part.slice(at, 1024)


def _cluster(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means; the first centres are spread by farthest point."""
    centres = [_normal(x.mean(0))]
    near = x @ centres[0]
    while len(centres) < min(k, len(x)):
        centres.append(x[near.argmin()])
        near = np.maximum(near, x @ centres[-1])
    c = np.array(centres)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.array([_normal(x[own == i].mean(0)) if (own == i).any() else c[i] for i in range(len(c))])
    return c


def fit(train: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model:
    """The model that (doc_id, text, lang) rows teach; rows with a null in text or lang don't."""
    train = train.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in train.select("lang").groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.ones(DIMENSIONS), np.zeros((0, DIMENSIONS)), np.zeros(0, int), np.zeros(0))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(DIMENSIONS, np.int64), 0
        for part in _blocks(batches):
            total += (vectors(part.column(0))[0] > 0).sum(0)
            rows += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1)), pa.array(np.append(total, rows))], ["feature", "n"])

    found = train.select("text").mapInArrow(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n")).collect()
    df = np.zeros(DIMENSIONS + 1)
    for feature, n in found:
        df[feature] = n
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1).astype(np.float32)

    share = F.lit(None)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(share)
    chosen = train.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share * float(1 << 30)).dropDuplicates(["lang", "doc_id", "text"])

    def cluster(key: tuple, group: pa.Table) -> pa.Table:
        # in a fixed order, so that reruns agree
        group = group.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        x = np.concatenate([_normal(vectors(part.column(0))[0] * idf) for part in _blocks(iter(group.select(["text"]).combine_chunks().to_batches()))])
        c = _cluster(x, clusters).astype(np.float32)
        floor = float(np.quantile((x @ c.T).max(1), REJECT_SHARE)) * 0.9
        return pa.table({"lang": [key[0].as_py()] * len(c), "centroid": [row.tobytes() for row in c], "floor": [floor] * len(c)})

    rows = sorted(chosen.groupBy("lang").applyInArrow(cluster, "lang string, centroid binary, floor double").collect(), key=lambda r: (r["lang"], bytes(r["centroid"])))
    languages = sorted({r["lang"] for r in rows})
    place = {lang: i for i, lang in enumerate(languages)}
    floors = {r["lang"]: r["floor"] for r in rows}
    return Model(languages, idf, np.array([np.frombuffer(r["centroid"], np.float32) for r in rows]), np.array([place[r["lang"]] for r in rows]), np.array([floors[x] for x in languages]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row: the nearest language, its cosine, and whether that is too far."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            languages, score, rejected = model.predict(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(languages), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected); learned from the rows that aren't held out."""
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
