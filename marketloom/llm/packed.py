"""Vectorised text primitives for Arrow batches inside Spark tasks.

Texts of a batch are handled as one byte buffer. Words are runs of bytes other than ASCII white space; each word
gets a 64-bit polynomial hash taken from prefix sums, so no per-word Python object is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18  # text handled at once; its arrays then stay in a core's cache. One longer text makes a chunk of its own
SHINGLE = 5

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INV = _U(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the last table is kept and grown."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.empty(max(n, 2 * CHUNK_BYTES), np.uint64)
        have[0], done = 1, 1
        step = base
        with np.errstate(over="ignore"):
            while done < len(have):
                take = min(done, len(have) - done)
                have[done : done + take] = have[:take] * step
                step, done = step * step, done + take
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed multipliers of the public splitmix64 generator)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES, other: str | None = None) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds at most `limit` bytes of text (in both columns together, if two are named), or one row."""
    for batch in batches:
        ends = 0
        for name in (text, *([other] if other else [])):
            ends = ends + np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts after each other, and where each begins (one more than texts); null is empty."""
    column = pc.fill_null(column, pa.scalar("", column.type)).cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a chunk: row, byte start and end (in the chunk's buffer), hash."""

    def __init__(self, column: pa.Array, lower: bool = True):
        if lower:
            column = pc.utf8_lower(pc.fill_null(column, pa.scalar("", column.type)))
        self.data, self.offsets = buffer(column)
        n = len(self.data)
        inside = np.zeros(n + 1, bool)
        inside[:n] = ~_SPACE[self.data]
        first = inside[:n].copy()
        first[1:] &= ~inside[: n - 1]
        begins = self.offsets[:-1]
        begins = begins[begins < n]
        first[begins] = inside[begins]
        last = inside[:n] & ~inside[1:]
        ends = self.offsets[1:]
        ends = ends[ends > 0] - 1
        last[ends] = inside[ends]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(self.offsets, self.start, "right") - 1
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_TABLE[self.data] * powers(_BASE, n), out=sums[1:])
            self.hash = mix((sums[self.end] - sums[self.start]) * powers(_INV, n)[self.start] if n else sums[:0])
        #: index of the first word of each row; one more than rows
        self.bounds = np.searchsorted(self.row, np.arange(len(self.offsets)))


def shingles(words: Words, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of `width` neighbouring words, the row of each, and the first shingle of each row (one more than rows).

    A text of fewer words has one shingle of all its words; a text without words has none.
    """
    counts = np.diff(words.bounds)
    n = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(bounds[-1]) - bounds[row] + words.bounds[row]
    end = words.bounds[row + 1]
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words.hash, np.zeros(width, np.uint64)])
    factor = powers(_U(0xD1342543DE82EF95), width + 1)
    with np.errstate(over="ignore"):
        short = (at + width > end).any()
        for k in range(width):
            w = padded[at + k]
            if short:
                w = np.where(at + k < end, w, _U(0))
            out += w * factor[k + 1]
    return mix(out), row, bounds


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours (len(x) - width + 1 values), by block prefixes and suffixes."""
    n = len(x)
    if n < width:
        return x[:0]
    pad = -n % width
    top = np.iinfo(x.dtype).max if x.dtype.kind in "iu" else np.inf
    y = np.concatenate([x, np.full(pad, top, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])
