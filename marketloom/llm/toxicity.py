"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding: compatibility forms are unified (NFKC), case goes, letters of other scripts that look like Latin ones become
those, digits or signs that stand for letters inside a word become letters, and letters set apart one by one are joined.
The automaton holds word stems; a hit counts where a word begins. Hits inside an exception phrase don't count. The sum of
weights is normalised by the length in words and squashed to 0..1: beyond `length_from` words a hit loses weight with the
logarithm of the length, down to `least_share`, at which one strong word still marks a text.

The lexicon is learned: stems (beginnings of words) whose share of toxic documents is high get their smoothed
log-odds as weight, the shortest stem that is still pure standing for its longer forms. Seed words keep a weight even
where no labelled row holds them. A document with several labels counts as toxic if one of them says so. Learning reads a bounded sample of labelled rows (`sample`, taken by a digest of
doc_id); scoring reads every whole text.

Defined results: null and empty text score the base rate of a text without hits; repeated rows score alike; null labels
don't teach; with no labels only the seed words count; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import Words, chunks
from .session import held_out

SAMPLE = 20_000
THRESHOLD = 0.3
#: Plain insults that always count, with no need of a label.
SEED_WORDS = ("idiot", "moron", "stupid", "scum", "trash", "clown", "loser", "pathetic", "worthless", "disgusting", "imbecile", "bastard", "bitch", "asshole", "fuck", "shit", "cunt", "whore", "faggot", "nigger", "retard")
SEED_WEIGHT = 4.0
#: Phrases in which a lexicon word isn't an insult.
EXCEPTIONS = ("clown fish", "clownfish", "trash can", "trash bag", "trash bin", "trash collection", "shitake", "sore loser rule")
# Letters of other scripts by the Latin letter they look like.
HOMOGLYPHS = {"а": "a", "ɑ": "a", "α": "a", "в": "b", "ь": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ε": "e", "ё": "e", "ɡ": "g", "һ": "h", "н": "h", "і": "i", "ι": "i", "ı": "i", "ј": "j", "к": "k", "κ": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "ο": "o", "σ": "o", "р": "p", "ρ": "p", "ѕ": "s", "т": "t", "τ": "t", "υ": "u", "ս": "u", "ν": "v", "ѵ": "v", "ԝ": "w", "ω": "w", "х": "x", "χ": "x", "у": "y", "γ": "y"}
# Digits and signs by the letter they stand for inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}
_SEEDS = tuple(np.array([x], np.uint64) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9))
_GLYPHS = str.maketrans(HOMOGLYPHS)
_SWAP = str.maketrans(SUBSTITUTES)
#: a word with at least one letter that also holds a sign or digit between or before letters
_MASKED = re.compile(r"(?<![^\W_])[^\W\d_]*[0-9@$!|+]+[^\W\d_](?:[^\W\d_]|[0-9@$!|+](?=[^\W\d_]|[0-9@$!|+]*[^\W\d_]))*[@$]*|(?<![^\W_])[^\W\d_]++[@$]+(?![^\W_])")
#: four letters or more, each on its own
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:([ .*_-])[^\W\d_](?![^\W_])(?:\1[^\W\d_](?![^\W_])){2,})")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower().translate(_GLYPHS)
    else:
        text = text.lower()
    text = _MASKED.sub(lambda m: m[0].translate(_SWAP), text)
    return _SPACED.sub(lambda m: m[0].replace(m[1], ""), text)


@dataclass
class Lexicon:
    """Stems with weights; bias and slope of the logistic squash; the score of a text without hits."""

    stems: dict[str, float] = field(default_factory=dict)
    #: those of the stems that only count as whole words
    whole: frozenset[str] = frozenset()
    exceptions: tuple[str, ...] = EXCEPTIONS
    base: float = 0.02
    #: words of a text beyond which further length dilutes its hits
    length_from: int = 400
    #: what is left of a hit's weight in the longest texts
    least_share: float = 0.6

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for stem, weight in self.stems.items():
            found.add_word(stem, (len(stem), weight, stem in self.whole))
        for phrase in self.exceptions:
            # the phrase's own stems are taken back
            back = -sum(w for s, w in self.stems.items() if (phrase.startswith(s) or f" {s}" in phrase) and (s not in self.whole or s in phrase.split()))
            found.add_word(phrase, (len(phrase), back, False))
        found.make_automaton()
        return found

    def scorer(self):
        stems = self.automaton() if self.stems else None
        bias = math.log(self.base / (1 - self.base))

        def score(text: str | None) -> float:
            if not text or stems is None:
                return self.base
            folded = fold(text)
            total, last, taken = 0.0, -1, 0.0
            for end, (size, weight, whole) in stems.iter(folded):
                begin = end - size + 1
                if begin and folded[begin - 1].isalpha():
                    continue
                if whole and folded[end + 1 : end + 2].isalpha():
                    continue
                if begin == last and weight > 0:  # the longer stem at the same place stands for the shorter
                    weight, taken = weight - min(taken, weight), max(taken, weight)
                else:
                    last, taken = begin, max(weight, 0.0)
                total += weight
            if total <= 0:
                return self.base
            words = folded.count(" ") + 1
            if words > self.length_from:
                total *= max(self.least_share, 1 - 0.15 * math.log(words / self.length_from))
            return 1 / (1 + math.exp(-min(bias + total * 1.5, 30.0)))

        return score


def sampled(labelled: DataFrame, sample: int, total: int) -> DataFrame:
    """About `sample` of the `total` rows by a digest of doc_id; all of them if there are no more."""
    if total <= sample:
        return labelled
    return labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) < F.lit(sample / total * (1 << 53)))


def learn(labelled: DataFrame, sample: int = SAMPLE, least_support: int = 4, least_share: float = 0.9, least_rate: float = 0.01) -> Lexicon:
    """The lexicon that (doc_id, text, toxic) rows teach. At most about `sample` rows are read, chosen by a digest."""
    labelled = labelled.where("toxic is not null and text is not null").select("doc_id", "text", "toxic")
    known = labelled.select("toxic").groupBy("toxic").count().collect()
    total = sum(r["count"] for r in known)
    lexicon = Lexicon({w: SEED_WEIGHT for w in SEED_WORDS}, frozenset(SEED_WORDS))
    if not total:
        return lexicon
    labelled = sampled(labelled, sample, total)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # copies and near copies would make chance words look frequent; they share least word hashes
        for batch in chunks(batches, "text"):
            words = Words(batch.column(1))
            keys = []
            for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
                h = words.hash[a:b]
                keys.append(b"".join(int((h * k).min()).to_bytes(8, "little") for k in _SEEDS) if len(h) else b"")
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *batch.columns], ["key", *batch.schema.names])

    kind = labelled.schema["doc_id"].dataType.simpleString()
    labelled = labelled.mapInArrow(once, f"key binary, doc_id {kind}, text string, toxic int").groupBy("key", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = {}, [0, 0]

        def told(totals: list) -> Iterator[pa.RecordBatch]:
            names, both = ["", *counts], [totals, *counts.values()]
            columns = [pa.array(names, pa.string()), pa.array([x[1] for x in both], pa.int64()), pa.array([x[0] for x in both], pa.int64())]
            for at in range(0, len(names), 50_000):
                yield pa.RecordBatch.from_arrays([c.slice(at, 50_000) for c in columns], ["stem", "bad", "good"])
            counts.clear()

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[toxic == 1] += 1
                words = set(_WORD.findall(fold(text)))
                for w in words | {w[:k] for w in words for k in range(4, min(len(w), 9))}:
                    counts.setdefault(w, [0, 0])[toxic == 1] += 1
                if len(counts) > 200_000:  # what is counted so far goes on its way
                    yield from told([0, 0])
        yield from told(totals)

    counts = labelled.mapInArrow(stems, "stem string, bad long, good long").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    kept = counts.where(F.col("stem").isin("", *SEED_WORDS) | ((F.col("bad") >= least_support) & (F.col("bad") >= least_share * (F.col("bad") + F.col("good"))))).collect()
    n_bad, n_good = next(((r["bad"], r["good"]) for r in kept if r["stem"] == ""), (0, 0))
    # a seed word that clean rows hold is a word of its own there
    seeds = {w: SEED_WEIGHT for w in SEED_WORDS if not any(r["stem"] == w and r["good"] and r["bad"] < least_share * (r["bad"] + r["good"]) for r in kept)}
    pure = {r["stem"]: (r["bad"], r["good"]) for r in kept
            if len(r["stem"]) >= 4 and r["bad"] >= max(least_support, least_rate * n_bad) and r["bad"] >= least_share * (r["bad"] + r["good"])}
    found = {}
    for stem in sorted(pure, key=lambda w: (len(w), w)):
        if any(stem[:k] in pure for k in range(4, len(stem))):
            continue  # a shorter pure stem stands for it
        # as long as that loses few of the rows; a long stem meets fewer innocent words
        longest = max((w for w in pure if w.startswith(stem) and pure[w][0] >= 0.9 * pure[stem][0]), key=lambda w: (len(w), w))
        bad, good = pure[longest]
        found[longest] = math.log((bad + 0.5) / (n_bad + 1)) - math.log((good + 0.5) / (n_good + 1))
    learned = {w: round(x, 6) for w, x in found.items() if x > 0.5}
    lexicon.stems, lexicon.whole = {**seeds, **learned}, frozenset(seeds) - frozenset(learned)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, column: str = "text", name: str = "toxicity") -> DataFrame:
    """`docs` with toxicity (0..1) added under `name`; a column of that name is replaced."""

    @F.pandas_udf("double")
    def toxicity(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rate = lexicon.scorer()
        for part in texts:
            yield pd.Series(np.fromiter(map(rate, part), float, len(part)))

    return docs.withColumn(name, toxicity(F.col(column)))


def one_label(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the documents that may teach: toxic where any of a document's labels says so."""
    return labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels of held-out documents are never read."""
    lexicon = learn(docs.select("doc_id", "text").join(one_label(labels), "doc_id"))
    scored = score(docs.select("doc_id", "text"), lexicon)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))
