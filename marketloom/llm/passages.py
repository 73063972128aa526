"""Near-duplicate passages by compact windows.

Tokens are five-word shingles. Under one min-hash all subsequences of at least `LEAST` tokens that have the same smallest
token lie in one compact window, a node of the Cartesian tree over the tokens' hashes. Windows of two hashes are joined
where their intervals overlap in at least `LEAST` tokens: that groups the subsequences that share both minima. All pairs of
`HASHES` hashes are used. Equal minima in two documents make the documents candidates, and the passages are then found
and verified on the texts: stretches along one alignment that are at least `LEAST` long, with a Jaccard similarity of
`THRESHOLD` or more. A stretch that is a little shorter, as its ends are changed, is filled up to `LEAST`.

A passage is reported for the later document (larger doc_id) with an earlier one that it repeats; of the passages of a
document those inside another one are left out. In a group of equal minima, every member first meets the group's smallest
doc_id. That one may hold the minima in another setting, so the documents that share any minima also form narrower
groups, of windows whose `CONTEXT` shingles around, before or after the minimum are the same too, and meet the smallest
doc_id of these. Windows that no passage found so far covers are then compared, on the shingles within `REACH` of their
minimum, with all earlier members of their groups in bounded blocks, and what they share is found on the texts; pairs go
first that by the places of their common shingles can't share a passage with an uncovered place in it. Copies of a whole
text are told by a digest first and reported against the smallest doc_id.

One stretch of 50 words at a Jaccard of exactly 0.8 shares a joint minimum with probability 0.90; exact ones always do, and
longer ones have several. The tests measure a recall above 0.9.

Defined results: texts of fewer than `LEAST` + 4 words, null or empty, have no passage; repeated passages inside one
document and rows that repeat a doc_id are not reported against themselves; rows with a null doc_id take no part; an
empty table gives an empty result; other columns are ignored.

Scale: a text sends about 12 / LEAST rows of three numbers for each token; groups are counted with a combine before the
shuffle, and the join back leaves a hot group's rows free to be split. Texts travel only for candidate pairs.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packed import _BASE, _INV, SHINGLE, Words, chunks, mix, powers, shingles, sliding_min
from .session import empty, having, settle, unused

LEAST_WORDS = 50
LEAST = LEAST_WORDS - SHINGLE + 1
HASHES = 3  # all their pairs are used
THRESHOLD = 0.8
CONTEXT = 16
REACH = 56  # a stretch as long as LEAST / THRESHOLD around a minimum reaches no further
COMMON = 41  # distinct shingles that two stretches of LEAST share at THRESHOLD, at least
FILL = LEAST - COMMON  # foreign shingles by which a shorter stretch is filled up, at most
FOREIGN = (2 * REACH + 1) // 5  # foreign shingles of a passage inside a segment, at most
BLOCK = 4096
WIDE = 2 * REACH + 1  # shingles of a segment, at most
PAIRS = 1024  # pairs of segments compared at once
SENT_ROWS = 200_000
DRIFT = 20  # shingles by which a passage's alignment may shift at a foreign stretch
PIECE = 1 << 20
HIT, MISS = 5, 4  # THRESHOLD as a fraction: in a passage of c common and f foreign shingles HIT * c - MISS * f is MISS * LEAST or more
_U = np.uint64
_LOW = _U(0xFFFF)


def minima(hashes: np.ndarray, row: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For every stretch of `least` tokens inside a text the place of its smallest hash; -1 where it leaves the text."""
    n = len(hashes)
    ranked = (hashes & ~_LOW) | (np.arange(n, dtype=np.uint64) & _LOW)
    low = sliding_min(ranked, least)
    at = np.arange(len(low))
    place = at + (((low & _LOW).astype(np.int64) - at) & 0xFFFF)
    return np.where(at + least <= bounds[row[: len(low)] + 1], place, -1), ranked


def _next_smaller(value: np.ndarray) -> np.ndarray:
    """For each value the place of the next one that is not larger; their number where none is."""
    n = len(value)
    lows = [np.append(value, np.inf)]  # of each place the smallest of the next 1, 2, 4, ...
    while 1 << len(lows) <= n:
        step, low = 1 << len(lows) - 1, lows[-1]
        lows.append(np.minimum(low, np.concatenate([low[step:], np.full(step, np.inf)])))
    at = np.arange(1, n + 1)
    for k in range(len(lows) - 1, -1, -1):
        at = np.minimum(at + (lows[k][at] > value) * (1 << k), n)
    return at


def compact_windows(place: np.ndarray, ranked: np.ndarray, row: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, first and last token of each compact window.

    The next smaller token on either side of a centre is itself a centre or the text's end, so the Cartesian tree is
    found among centres alone, all texts at once. Equal tokens close to each other are equal as doubles and end each other's
    windows: what holds its smallest token twice is so left to its other hashes.
    """
    centres = np.unique(place[place >= 0])
    value, of = ranked[centres].astype(np.float64), row[centres]
    before, after = np.append(centres, -1)[len(centres) - 1 - _next_smaller(value[::-1])[::-1]], np.append(centres, len(ranked))[_next_smaller(value)]
    return centres, np.maximum(before + 1, bounds[of]), np.minimum(after - 1, bounds[of + 1] - 1)


def signatures(hashes: np.ndarray, row: np.ndarray, bounds: np.ndarray, least: int = LEAST, drawn: int = HASHES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, token, first, last): a key for each area of subsequences that share the minima of two hashes, the token it stands at, its ends."""
    keys, places, firsts, lasts = [], [], [], []
    with np.errstate(over="ignore"):
        found = []
        for h in range(drawn):
            place, ranked = minima(mix(hashes + _U((h + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), row, bounds, least)
            found.append((place, *compact_windows(place, ranked, row, bounds)))
        for p, (x, y) in enumerate(combinations(found, 2)):
            (pa_, ca, la, ra), (pb, cb, lb, rb) = x, y
            ok = np.flatnonzero(pa_ >= 0)
            both = np.unique((pa_[ok] << 32) | pb[ok]) if len(ok) else ok
            a, b = both >> 32, both & 0xFFFFFFFF
            ia, ib = np.searchsorted(ca, a), np.searchsorted(cb, b)
            # the two windows of a pair meet where both hold their minimum
            first, last = np.maximum(la[ia], lb[ib]), np.minimum(ra[ia], rb[ib])
            wide = last - first + 1 >= least
            a, b = a[wide], b[wide]
            keys.append(mix(mix(hashes[a] + _U(p + 1)) * _U(0xD1342543DE82EF95) + hashes[b]))
            places.append(a)
            firsts.append(first[wide])
            lasts.append(last[wide])
    keys, places, firsts, lasts = (np.concatenate(x) for x in (keys, places, firsts, lasts))
    order = np.argsort(places, kind="stable")
    return keys[order], places[order], firsts[order], lasts[order]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text (key null: its digest and words), and a row for each key of it."""
    for part in chunks(batches):
        words = Words(part.column(1))
        hashes, row, bounds = shingles(words)
        sizes = np.diff(words.bounds)
        none = np.zeros(0, np.int64)
        keys, at, first, last = signatures(hashes, row, bounds) if len(hashes) else (none.view(np.uint64), none, none, none)
        of = row[at] if len(at) else at
        # place in the text and the reach of its area to both sides in one number
        places = ((at - bounds[of]) << 12) | (np.minimum(at - first, REACH) << 6) | np.minimum(last - at, REACH)
        edges = pa.array(np.searchsorted(of, np.arange(part.num_rows + 1)).astype(np.int32))
        digests = [hashlib.md5(t.as_buffer() or b"", usedforsecurity=False).digest() for t in part.column(1)]
        lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (keys.view(np.int64), places)]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "digest", "words", "keys", "places"])


def _once(of: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key of a text once; sorted by text."""
    order = np.lexsort((keys, of))
    of, keys = of[order], keys[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])
    return of[new], keys[new]


def _settings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of each text's narrower groups, of windows whose minima are shared at all: (key, place) lists come along."""
    for part in chunks(batches):
        hashes, row, bounds = shingles(Words(part.column(1)))
        n = len(hashes)
        lists = part.column(2)
        of = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(lists), np.int64))
        asked = lists.flatten()
        keys = np.asarray(asked.field(0), np.int64).view(np.uint64)
        at = bounds[of] + (np.asarray(asked.field(1), np.int64) >> 12)
        found = []
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(_BASE, n), dtype=np.uint64)])
            for k, (back, ahead) in enumerate(((CONTEXT // 2, CONTEXT // 2), (CONTEXT, 0), (0, CONTEXT))):
                ok = np.flatnonzero((at - back >= bounds[of]) & (at + ahead < bounds[of + 1])) if n else at
                lo = at[ok] - back
                found.append((of[ok], mix(keys[ok] + mix((sums[at[ok] + ahead + 1] - sums[lo]) * powers(_INV, n + 1)[lo] + _U(k + 1)))))
        of, keys = (np.concatenate(x) for x in zip(*found, strict=True))
        of, keys = _once(of, keys)
        edges = pa.array(np.searchsorted(of, np.arange(part.num_rows + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(edges, pa.array(keys.view(np.int64)))], ["id", "keys"])


def _held(common: np.ndarray, least: int) -> np.ndarray:
    """The places of `common` (along its last axis) that a passage can hold.

    With c of its n shingles common a passage needs c >= THRESHOLD * (n + m - c), where its counterpart has m >= least, and
    m >= c.
    """
    n = common.shape[-1]
    if n < least:
        return np.zeros(common.shape, bool)
    held = np.ones(common.shape, bool)
    for hit, miss, enough in ((HIT, MISS, MISS * least), (HIT - MISS, MISS, 0)):
        sums = np.zeros((*common.shape[:-1], n + 1), np.int32)
        np.cumsum(np.where(common, np.int8(hit), np.int8(-miss)), axis=-1, dtype=np.int32, out=sums[..., 1:])
        low = np.minimum.accumulate(sums, axis=-1)
        high = np.maximum.accumulate(sums[..., ::-1], axis=-1)[..., ::-1]
        held &= high[..., 1:] - low[..., :-1] >= enough
    return held


def _runs(common: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of common shingles can begin and where they can end.

    A run goes on for sure where both texts go on by one shingle, and the other text holds these once.
    """
    goes_on = common[:, 1:] & common[:, :-1] & (first[:, 1:] == last[:, 1:]) & (first[:, :-1] == last[:, :-1]) & (first[:, 1:] == first[:, :-1] + 1)
    begin, end = common.copy(), common.copy()
    begin[:, 1:] &= ~goes_on
    end[:, :-1] &= ~goes_on
    return begin, end


def _aligned(common: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The places from a passage's first common shingle to its last that passages can hold whose counterparts reach as far.

    `first` and `last`: where the other text has each common shingle. From the common shingle i on to j a passage is
    j - i + 1 long and its counterpart first[j] - last[i] + 1 at least, and COMMON shingles lie in it; i begins a run and j
    ends one.
    """
    apart = COMMON - 1
    count = np.cumsum(common, axis=1, dtype=np.int32)
    ranks = count[:, -1]
    n = int(ranks.max(initial=0))
    if n <= apart:
        return np.zeros(common.shape, bool)
    far = np.int32(1 << 30)
    at = np.argsort(~common, axis=1, kind="stable")[:, :n].astype(np.int32)  # the common places of each row in front
    rank = np.arange(n, dtype=np.int32)
    there = rank < ranks[:, None]
    begins, ends = (there & np.take_along_axis(x, at, 1) for x in _runs(common, first, last))
    begin = np.where(begins, (HIT + MISS) * rank - MISS * (at + np.take_along_axis(last, at, 1)), far)
    end = np.where(ends, (HIT + MISS) * (rank + 1) - MISS * (at + np.take_along_axis(first, at, 1) + 2), -far)

    def bests() -> tuple[np.ndarray, np.ndarray]:
        return np.minimum.accumulate(begin, axis=1), np.maximum.accumulate(end[:, ::-1], axis=1)[:, ::-1]

    # begins with no end COMMON shingles further on that fits them go, and ends without a begin
    low, high = bests()
    begin[:, n - apart :] = far
    begin[:, : n - apart][high[:, apart:] < begin[:, : n - apart]] = far
    end[:, :apart] = -far
    end[:, apart:][end[:, apart:] < low[:, : n - apart]] = -far
    low, high = bests()
    low, high = np.pad(low, ((0, 0), (1, 0)), constant_values=far), np.pad(high, ((0, 0), (0, 1)), constant_values=-far)
    return np.take_along_axis(high, count - common, 1) >= np.take_along_axis(low, count, 1)


def _near(marked: np.ndarray, reach: int, low: np.ndarray | int = 0, high: np.ndarray | int | None = None) -> np.ndarray:
    """The places (along the last axis) with a marked one at most `reach` away, looking from `low` up to `high` only."""
    n = marked.shape[-1]
    sums = np.zeros((*marked.shape[:-1], n + 1), np.int32)
    np.cumsum(marked, axis=-1, dtype=np.int32, out=sums[..., 1:])
    at = np.arange(n)
    return sums[..., np.minimum(at + reach + 1, n if high is None else high)] > sums[..., np.maximum(at - reach, low)]


def _fillable(common: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The places that the fill of a stretch shorter than LEAST can cover.

    Such a stretch goes from the begin of a run of common shingles to the end of one and holds COMMON of them.
    """
    n = common.shape[1]
    begin, end = _runs(common, first, last)
    count = np.zeros((len(common), n + 1), np.int32)
    np.cumsum(common, axis=1, dtype=np.int32, out=count[:, 1:])
    marked = np.zeros(common.shape, bool)
    for d in range(COMMON - 1, min(LEAST - 1, n)):
        short = begin[:, : n - d] & end[:, d:] & (count[:, d + 1 :] - count[:, : n - d] >= COMMON)
        marked[:, d:] |= short
        marked[:, : n - d] |= short
    return _near(marked, FILL) if marked.any() else marked


def _alignments(later: np.ndarray, earlier: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in `later`, places in `earlier`) of common shingles, once for each alignment that can hold a passage.

    Alignments are the diagonals around which all pairs of equal shingles are dense enough. Of a shingle that `earlier`
    holds several times the place nearest to the alignment counts.
    """
    order = earlier.argsort(kind="stable")
    ordered = earlier[order]
    first = ordered.searchsorted(later)
    common = ordered[np.minimum(first, len(ordered) - 1)] == later
    hit = (common & _held(common, least)).nonzero()[0]
    enough = THRESHOLD * least * 0.9
    if len(hit) < enough:
        return
    first = first[hit]
    times = ordered.searchsorted(later[hit], "right") - first
    # pairs on each diagonal, counted in pieces: repeated lines make many
    n = len(later)
    dense = np.zeros(n + len(earlier) + 2 * DRIFT, np.int64)
    total = np.cumsum(times)
    lo = 0
    while lo < len(hit):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PIECE, "right")))
        t = times[lo:hi]
        inner = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        diagonal = order[np.repeat(first[lo:hi], t) + inner] - np.repeat(hit[lo:hi], t) + n
        dense += np.bincount(diagonal + DRIFT, minlength=len(dense))
        lo = hi
    sums = np.concatenate([[0], np.cumsum(dense)])
    near = sums[2 * DRIFT + 1 :] - sums[: -2 * DRIFT - 1]  # of diagonal d - n all pairs within DRIFT
    held = (near >= enough).nonzero()[0]
    single = order[first]
    several = bool(times.max() > 1)
    if several:
        value = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
        wide = 2 * len(earlier) + 2 * n
        places = value * wide + n + order  # of each value its places, ascending, all in one line
        ranked = value[first] * wide + n
    while len(held):
        band = held[: held.searchsorted(held[0] + DRIFT, "right")]
        peak = int(band[dense[band + DRIFT].argmax()])
        shift = peak - n
        held = held[held.searchsorted(peak + DRIFT, "right") :]
        source, goal = single, hit + shift
        if several:
            aim = places.searchsorted(ranked + np.minimum(np.maximum(goal, 0), len(earlier) - 1))
            a, b = order[np.minimum(aim, first + times - 1)], order[np.maximum(aim - 1, first)]
            source = np.where(np.abs(a - goal) < np.abs(b - goal), a, b)
        own = np.abs(source - goal) <= DRIFT
        if np.count_nonzero(own) >= enough:
            yield hit[own], source[own]


def common_passages(later: np.ndarray, earlier: np.ndarray, least: int = LEAST, threshold: float = THRESHOLD, free: np.ndarray | None = None) -> list[tuple[int, int, int, int, float]]:
    """(begin, end, source begin, source end, similarity) in shingles: the stretches of `later` that `earlier` holds too.

    `free`: only those that hold one of these places need be there; alignments that have none are passed over.
    """
    if min(len(later), len(earlier)) < least:
        return []
    if free is not None:
        free = np.concatenate([[0], free.cumsum()])
    found = {x for hit, source in _alignments(later, earlier, least) for x in _along(later, earlier, hit, source, least, threshold, free)}
    out, reach = [], -1
    for x in sorted(found, key=lambda x: (x[0], -x[1], -x[4], x[2])):
        if x[1] > reach:
            out.append(x)
            reach = x[1]
    return out


def _along(later: np.ndarray, earlier: np.ndarray, hit: np.ndarray, source: np.ndarray, least: int, threshold: float, free: np.ndarray | None = None) -> list[tuple[int, int, int, int, float]]:
    """The passages along one alignment: from each run of common shingles on to the last run with which the stretch is similar enough.

    `free`: running counts of places; if no passage can hold one of them there is none.
    """
    enough = math.ceil(2 * least * threshold / (1 + threshold) - 1e-9)  # common shingles of two stretches of `least`
    step, shift = hit[1:] - hit[:-1], source - hit
    b = np.concatenate([[0], ((step > 1) | (np.abs(shift[1:] - shift[:-1]) > 2)).nonzero()[0] + 1])
    e = np.concatenate([b[1:], [len(hit)]])
    low, high = np.minimum.reduceat(source, b), np.maximum.reduceat(source, b) + 1
    begins, ends = hit[b], hit[e - 1] + 1
    # from where the first run begins to where the last ends a stretch and its counterpart reach for sure
    begin, end = (1 + threshold) * b - threshold * (begins + low) - 1e-6, (1 + threshold) * e - threshold * (ends + high)
    best = np.maximum.accumulate(end[::-1])[::-1]
    far = e.searchsorted(b + enough)  # the first run with which there are common shingles enough
    can = far.searchsorted(len(b))
    can = (best[far[:can]] >= begin[:can]).nonzero()[0]
    if not len(can):
        return []
    if free is not None:
        reach = int(ends[(end >= begin[can].min()).nonzero()[0][-1]])
        if free[min(max(reach, int(begins[can[-1]]) + least), len(later))] == free[max(min(int(begins[can[0]]), len(later) - least), 0)]:
            return []
    out = []
    after = 0
    for k in can.tolist():
        if k < after:
            continue
        # stretches from this run to each later one, shorter ones filled up with foreign shingles
        common = e[k:] - b[k]
        first, last = np.minimum.accumulate(low[k:]), np.maximum.accumulate(high[k:])
        own, other = np.maximum(ends[k:] - begins[k], least), np.maximum(last - first, least)
        for j in (common >= threshold * (own + other - common)).nonzero()[0][::-1].tolist():
            x0, x1 = _filled(int(begins[k]), int(ends[k + j]), len(later), least)
            s0, s1 = _filled(int(first[j]), int(last[j]), len(earlier), least)
            x, y = set(later[x0:x1].tolist()), set(earlier[s0:s1].tolist())
            both = len(x & y)
            similarity = both / (len(x) + len(y) - both)
            if similarity >= threshold:
                out.append((x0, x1, s0, s1, similarity))
                after = k + j + 1
                break
    return out


def _filled(begin: int, end: int, n: int, least: int) -> tuple[int, int]:
    """A stretch made `least` long, ahead as far as the text goes, else back."""
    end = min(max(end, begin + least), n)
    return max(min(begin, end - least), 0), end


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "later", 1 << 18, "earlier"):
        later, _, later_at = shingles(Words(part.column(part.schema.get_field_index("later"))))
        # the rows of one earlier document stand together; it is read once for all of them
        _, first, which = np.unique(part.column(1).to_numpy(), return_index=True, return_inverse=True)
        earlier, _, earlier_at = shingles(Words(part.column(part.schema.get_field_index("earlier")).take(pa.array(first))))
        rows = []
        ids, sources = part.column(0).to_pylist(), part.column(1).to_pylist()
        for i in range(part.num_rows):
            w = which[i]
            for begin, end, s0, s1, similarity in common_passages(later[later_at[i] : later_at[i + 1]], earlier[earlier_at[w] : earlier_at[w + 1]]):
                rows.append((ids[i], begin, end + SHINGLE - 1, sources[i], s0, s1 + SHINGLE - 1, similarity))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.float64() if j == 6 else pa.int64()) for j in range(7)], list(COLUMNS))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each asked window of a text the shingles within REACH of its minimum: 31 bits of each, and a last bit that a found passage covers it."""
    for part in chunks(batches):
        hashes, _, bounds = shingles(Words(part.column(1)))
        covered = np.zeros(len(hashes) + 1, np.int64)
        spans = part.column(3)
        of = np.repeat(np.arange(part.num_rows), np.asarray(pc.fill_null(pc.list_value_length(spans), 0), np.int64))
        ends = spans.flatten()
        np.add.at(covered, bounds[of] + np.asarray(ends.field(0), np.int64), 1)
        np.add.at(covered, bounds[of] + np.asarray(ends.field(1), np.int64) - SHINGLE + 1, -1)
        marked = ((hashes >> _U(33)) << _U(1)).astype(np.int64) | (np.cumsum(covered)[:-1] > 0)
        asked = part.column(2)
        of = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(asked), np.int64))
        asked = asked.flatten()
        at = bounds[of] + (np.asarray(asked.field(1), np.int64) >> 12)
        lo, hi = np.maximum(at - REACH, bounds[of]), np.minimum(at + REACH + 1, bounds[of + 1])
        for a in range(0, len(of), BLOCK):
            b = min(a + BLOCK, len(of))
            n = hi[a:b] - lo[a:b]
            edges = np.concatenate([[0], np.cumsum(n)])
            inner = np.arange(edges[-1]) - np.repeat(edges[:-1] - lo[a:b], n)
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(marked[inner].astype(np.uint32).view(np.int32)))
            own = asked.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of[a:b])), own.field(0), own.field(2), own.field(3), pa.array((lo - bounds[of])[a:b]), lists], ["id", "key", "open", "blocks", "start", "segment"])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _take(out: list, vain: set, later: np.ndarray, earlier: np.ndarray, open_: np.ndarray, at: tuple) -> None:
    """Adds the passages that hold uncovered places, and covers them; equal segments without any are compared once."""
    content = hashlib.blake2b(b"".join((later.tobytes(), b"|", open_.tobytes(), b"|", earlier.tobytes())), digest_size=16).digest()
    if content in vain:
        return
    before = len(out)
    for b, e, s0, s1, similarity in common_passages(later, earlier, LEAST, THRESHOLD, open_):
        if open_[b:e].any():
            open_[b:e] = False
            out.append((at[0], b + at[1], e + at[1] + SHINGLE - 1, at[2], s0 + at[3], s1 + at[3] + SHINGLE - 1, similarity))
    if len(out) == before:
        vain.add(content)


def _meet(table: pa.Table) -> pa.Table:
    """Passages that open segments hold in common with earlier ones of their groups; exact on the segments.

    First segments go that share less than COMMON shingles with all others of their group together, until none is left
    to go. Then each open one meets those that hold one of its rare shingles or one near an uncovered place, from the
    smallest doc_id on, as long as a passage in them can hold a place that none covers, be it one of its fill.
    """
    table = table.combine_chunks().sort_by([("key", "ascending"), ("id", "ascending")])
    keys, ids, side, start = (table[c].to_numpy() for c in ("key", "id", "side", "start"))
    opens = np.asarray(table["open"].to_numpy(zero_copy_only=False), bool)
    two = table["lo"][0].as_py() != table["hi"][0].as_py()
    lists = table["segment"].combine_chunks()
    sizes = np.asarray(pc.list_value_length(lists), np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    values = np.asarray(lists.flatten()).view(np.uint32)
    shingle, bare = (values >> 1).astype(np.uint64), (values & 1) == 0
    n = len(keys)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    with np.errstate(over="ignore"):
        token = mix(keys.view(np.uint64)[owner] * _U(0x9E3779B97F4A7C15) + shingle)
    # what a passage newly covers may be foreign to the other text: then a common shingle of it stands close by
    near_bare = _near(bare, FOREIGN, bounds[owner], bounds[owner + 1])
    order = np.lexsort((~near_bare, token, owner))
    owner, token, bare_token = owner[order], token[order], near_bare[order]
    places = (order - bounds[owner]).astype(np.int32)
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])
    starts = np.flatnonzero(new)
    first, last = (f.reduceat(places, starts) if len(starts) else places for f in (np.minimum, np.maximum))
    entry = np.empty(len(owner), np.int32)  # of each place the row of its shingle below
    entry[order] = np.cumsum(new) - 1
    owner, token, bare_token = owner[new], token[new], bare_token[new]
    lone = np.bincount(owner, minlength=n) == sizes  # segments in which no shingle repeats
    kept = np.arange(len(owner), dtype=np.int32)
    del order, places, new, starts, near_bare, values
    _, begins, group = np.unique(keys, return_index=True, return_inverse=True)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingle + _U(1)) * powers(_BASE, len(shingle)), dtype=np.uint64)])
        content = mix((sums[bounds[1:]] - sums[bounds[:-1]]) * powers(_INV, len(shingle) + 1)[bounds[:-1]] + sizes.view(np.uint64)).view(np.int64)
    del sums
    need = np.full(len(begins), COMMON)
    np.minimum.at(need, group, np.maximum(COMMON - sizes + np.bincount(owner, minlength=n), 1))
    need = need[group]
    alive = n + 1
    while True:
        _, token, df = np.unique(token, return_inverse=True, return_counts=True)
        token = token.astype(np.int32)
        keep = df[token] > 1
        owner, token, kept = owner[keep], token[keep], kept[keep]
        stay = np.bincount(owner, minlength=n) >= need
        asked = np.zeros(len(need), bool)
        asked[group[stay & opens]] = True
        stay &= asked[group]
        if stay.sum() == alive:
            break
        alive = stay.sum()
        keep = stay[owner]
        owner, token, kept = owner[keep], token[keep], kept[keep]
    _, token, df = np.unique(token, return_inverse=True, return_counts=True)
    posting = np.concatenate([[0], np.cumsum(df)])
    order = np.argsort(token, kind="stable")
    holders, spots = owner[order], (first << 7 | last).astype(np.int16)[kept[order]] + np.int16(1)  # segments have less than 128 shingles
    bare_token = bare_token[kept]
    edges = np.searchsorted(owner, np.arange(n + 1))
    back = np.full(len(first), -1, np.int32)
    back[kept] = np.arange(len(kept))
    entry = back[entry]
    del first, last, back, order, kept
    marks = np.random.default_rng(5).integers(-(1 << 62), 1 << 62, 128)
    local = np.full(n, -1)
    out, vain, waiting = [], set(), []

    def compare() -> None:
        """Of the pairs that wait those where a passage with an uncovered place can be; y by y, from the smallest doc_id on."""
        count = [len(some) for _, some, _, _ in waiting]
        spot, free = np.zeros((sum(count), WIDE), np.int16), np.zeros((len(waiting), WIDE), bool)
        for k, (at, (_, _, rows, open_)) in enumerate(zip(np.cumsum(count).tolist(), waiting, strict=True)):
            spot[at - len(rows) : at, : rows.shape[1]] = rows
            free[k, : len(open_)] = open_
        of, x = np.repeat(np.arange(len(waiting)), count), np.concatenate([some for _, some, _, _ in waiting])
        fit = (_held(spot > 0, LEAST) & free[of]).any(1)
        spot, of, x = spot[fit].astype(np.int32) - 1, of[fit], x[fit]
        common, there = spot >= 0, (spot >> 7, spot & 127)
        room = _aligned(common, *there) | _fillable(common, *there)
        for k in np.flatnonzero((room & free[of]).any(1)):
            y, _, _, open_ = waiting[of[k]]
            if (room[k, : len(open_)] & open_).any():  # not covered by now
                later, earlier = (shingle[bounds[i] : bounds[i + 1]] for i in (y, x[k]))
                _take(out, vain, later, earlier, open_, (ids[y], start[y], ids[x[k]], start[x[k]]))
        waiting.clear()

    pairs = 0
    for y in np.flatnonzero(stay & opens):
        own, free = token[edges[y] : edges[y + 1]], bare_token[edges[y] : edges[y + 1]]
        times = df[own]
        rare = own[np.argsort(times, kind="stable")][: len(own) - need[y] + 1]
        few = min(rare, own[free], key=lambda t: df[t].sum())
        if not len(few):
            continue
        # the members of a group stand together, by doc_id
        low = begins[group[y]]
        high = low + np.searchsorted(ids[low:y], ids[y])
        near = np.zeros(y + 1 - low, bool)
        held = holders[_ranges(posting[few], df[few])]
        near[held[held <= y] - low] = True
        near = np.flatnonzero(near[: high - low]) + low
        if two:
            near = near[side[near] != side[y]]
        if not len(near):
            continue
        open_ = bare[bounds[y] : bounds[y + 1]].copy()
        place = entry[bounds[y] : bounds[y + 1]]
        place = np.where(place < 0, len(own), place - edges[y])
        held = _ranges(posting[own], times)
        around, column = holders[held], np.repeat(np.arange(len(own), dtype=np.int16), times)
        for lo in range(0, len(near), PAIRS):
            # which shingles each of these holds, and where
            some = near[lo : lo + PAIRS]
            local[some] = np.arange(len(some))
            who = local[around]
            here = np.flatnonzero(who >= 0)
            spot = np.zeros((len(some), len(own) + 1), np.int16)
            spot[who[here], column[here]] = spots[held[here]]
            local[some] = -1
            fit = np.flatnonzero(np.count_nonzero(spot, axis=1) >= need[y])
            if len(fit) > 4:
                # segments alike in what they share, and in all else that counts, say the same: the first of them is asked
                alike = np.where(lone[some[fit]], spot[fit] @ marks[: spot.shape[1]] + sizes[some[fit]] * marks[-1], content[some[fit]])
                fit = fit[np.sort(np.unique(alike, return_index=True)[1])]
            if len(fit):
                waiting.append((y, some[fit], spot[fit][:, place], open_))
                pairs += len(fit)
            if pairs >= PAIRS:
                compare()
                pairs = 0
    if waiting:
        compare()
    return pa.table({c: pa.array([r[j] for r in out], pa.float64() if j == 6 else pa.int64()) for j, c in enumerate(COLUMNS)})


COLUMNS = ("doc_id", "first_word", "end_word", "source_doc_id", "source_first_word", "source_end_word", "similarity")
SCHEMA = ", ".join(f"{c} {'double' if c == 'similarity' else 'long'}" for c in COLUMNS)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """COLUMNS for every passage of a document that an earlier document holds too; words count from 0."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    read = settle(rows.mapInArrow(_read, "doc_id long, digest binary, words long, keys array<long>, places array<long>"))
    first = read.groupBy("digest").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("top")).where("id < top").drop("top")
    copied = settle(read.where(F.col("words") >= LEAST_WORDS).select("doc_id", "digest", "words").join(first, "digest").where("id < doc_id"))
    whole = [F.lit(0).cast("long"), F.col("words"), F.lit(0).cast("long"), F.col("words"), F.lit(1.0)]
    copies = copied.select("doc_id", whole[0].alias("first_word"), whole[1].alias("end_word"), F.col("id").alias("source_doc_id"), whole[2].alias("source_first_word"), whole[3].alias("source_end_word"), whole[4].alias("similarity"))
    windows = having(read.select("doc_id", "keys", "places"), copied, anti=True).select(F.col("doc_id").alias("id"), F.explode(F.arrays_zip("keys", "places")).alias("w")).select("id", F.col("w.keys").alias("key"), F.col("w.places").alias("at"))
    shared = windows.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("top"), (F.count("*") > 2).alias("many")).where("lead < top").drop("top")
    members = settle(windows.join(shared, "key"), tidy=True)

    texts = settle(having(rows, members.select(F.col("id").alias("doc_id"))), tidy=True)
    own = members.groupBy("id").agg(F.collect_list(F.struct("key", "at")).alias("shared"))
    settings = texts.join(own, F.col("doc_id") == F.col("id")).select("doc_id", "text", "shared").mapInArrow(_settings, "id long, keys array<long>").select("id", F.explode("keys").alias("key"))
    firsts = settings.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("top")).where("lead < top").drop("top")
    pairs = members.select("id", "lead").unionByName(settings.join(firsts, "key").select("id", "lead")).where("lead < id").distinct()
    pairs = settle(pairs.select(F.col("id").alias("y"), F.col("lead").alias("x")), tidy=True)

    def verified(asked: DataFrame) -> DataFrame:
        later = texts.select(F.col("doc_id").alias("y"), F.col("text").alias("later"))
        earlier = texts.select(F.col("doc_id").alias("x"), F.col("text").alias("earlier"))
        return asked.join(later, "y").join(earlier, "x").select("y", "x", "later", "earlier").mapInArrow(_verify, SCHEMA)

    found = settle(verified(pairs), 250, tidy=True)
    more = settle(_remainder(members, texts, found))
    left = settle(more.select(F.col("doc_id").alias("y"), F.col("source_doc_id").alias("x")).distinct().join(pairs, ["y", "x"], "left_anti"))
    found = found.unionByName(more)
    if not empty(left):
        found = found.unionByName(settle(verified(left), 250))
    before = Window.partitionBy("doc_id").orderBy("first_word", F.desc("end_word"), "source_doc_id", "source_first_word").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("_reach", F.max("end_word").over(before)).where("_reach is null or end_word > _reach").drop("_reach")
    return found.unionByName(copies)


def _remainder(members: DataFrame, texts: DataFrame, found: DataFrame) -> DataFrame:
    """The passages around windows that `found` does not cover, with any earlier member of their groups.

    The first member has been compared with all others on the texts and is left out.
    """
    spans = settle(found.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("first_word", "end_word")).alias("spans")))
    few = spans.count() <= SENT_ROWS
    place, back, ahead = F.shiftright("at", 12), F.shiftright("at", 6).bitwiseAND(F.lit(63)), F.col("at").bitwiseAND(F.lit(63))
    covers = F.exists("spans", lambda s: (s["first_word"] <= place - back) & (s["end_word"] >= place + ahead + SHINGLE))
    several = members.where("many and lead < id").join(F.broadcast(spans) if few else spans, F.col("id") == F.col("of"), "left")
    several = several.select("id", "key", "at", (~F.coalesce(covers, F.lit(False))).alias("open"))
    groups = several.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max(F.when(F.col("open"), F.col("id"))).alias("last")).where("last > low")
    groups = groups.select("key", "last", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    asked = settle(several.join(groups, "key").where("id <= last").select("id", "key", "at", "open", "blocks"), tidy=True)
    buckets = -(-asked.count() // BLOCK) or 1
    own = asked.groupBy("id").agg(F.collect_list(F.struct("key", "at", "open", "blocks")).alias("asked"))
    known = having(texts, asked.select(F.col("id").alias("doc_id"))).join(own, F.col("doc_id") == F.col("id"))
    known = known.join(F.broadcast(spans) if few else spans, F.col("id") == F.col("of"), "left").select("id", "text", "asked", "spans")
    segments = known.mapInArrow(_segments, "id long, key long, open boolean, blocks int, start long, segment array<int>")
    # a group beyond BLOCK members is compared block by block, smaller ones many at once
    block = F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int")
    dealt = segments.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bucket = F.when(F.col("blocks") > 1, F.col("key")).otherwise(F.pmod("key", F.lit(buckets)))
    dealt = dealt.select(bucket.alias("bucket"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "key", "open", "start", "segment")
    return dealt.groupBy("bucket", "lo", "hi").applyInArrow(_meet, SCHEMA).distinct()


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with repeated passages cut from the later documents; a text of which nothing is left goes."""
    of, cuts = unused(docs, "of"), unused(docs, "cuts")
    spans = settle(repeated_passages(docs).groupBy(F.col("doc_id").alias(of)).agg(F.collect_list(F.struct("first_word", "end_word")).alias(cuts)))
    few = spans.count() <= SENT_ROWS  # then texts need no shuffle
    joined = docs.join(F.broadcast(spans) if few else spans, F.col("doc_id").cast("long") == F.col(of), "left")

    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)

    none = F.col(cuts).isNull()
    changed = F.when(none, F.col("text")).otherwise(F.pandas_udf(cut, "string")(F.when(~none, F.col("text")), cuts))
    out = joined.withColumn("text", changed).where(none | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(none, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _cut(text, spans):
    if text is None or spans is None:
        return text
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for s in sorted((s["first_word"], s["end_word"]) for s in spans):
        b, e = starts[min(s[0], len(starts) - 1)], starts[min(s[1], len(starts) - 1)]
        if b > at:
            out.append(text[at:b])
        at = max(at, e)
    return "".join([*out, text[at:]]).strip()
