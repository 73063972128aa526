"""Hard negatives of anchors by an inverted multi-index.

Vectors are cut into two halves, each with a codebook of its own; a pair of codewords is a cell. A row of cell (i, j) can't
score above (a1.u_i + |a1| R_i) + (a2.w_j + |a2| S_j) with the anchor's halves a1, a2 and the radii R, S that the rows of a
codeword reach, so the two sorted lists of half bounds and a heap give an anchor its cells by falling bound: the
multi-sequence walk. Positives are an anchor's best rows of its own label, negatives the best rows of other labels inside
a window of each positive's score. A walk ends when its windows are certified: each is full and the next bound is below its
last score, or the next bound is below the window. A cell on the way is left out if its own radii show that all its rows
score above the windows, or too low. Scores are exact integers.

The walks go on in rounds, each four times as long as the one before: an anchor asks for its next cells, questions of a cell are
packed, and packs and blocks of a cell meet on a grid of at most `MEET` x `MEET` at once, so neither a hot cell nor a cell that all anchors ask for makes
a large task. All rows are indexed; codewords are fitted on about `SAMPLE` rows, at most twice as many, which changes how many cells are
visited and never the result.

Rows of one label with equal vectors have equal scores: only those of the least ids can be among the first, so of more
than that the index holds none. Groups of copies are cut down so before they are shuffled.

Components are floor(256 * x), at most 2**62 in size. Rows with a null vec_id or label, a null vector or null or non-finite
components take no part; shorter vectors are filled up with zeros; a repeated row is a candidate of its own, a row is no
candidate of anchors with its vec_id, and a vec_id that stands in several rows is an anchor once, with its least label and
vector. Empty tables give an empty result; other columns are ignored. Scores stop at 2**63 - 1.

Scale: the codebooks and a row of numbers for each cell, at most `CODEWORDS`**2, are all that is sent to tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import empty, hash_share, partitions, settle
from .topk import LARGEST, _best, _matrix, _products

SAMPLE = 20_000
CODEWORDS = 256  # at most, for each half
CELL_ROWS = 256  # rows of a cell in the mean, until there are CODEWORDS
BLOCK = 2048
MEET = 8
MEETINGS = 16  # packs and blocks that meet in one Arrow batch: each holds up to BLOCK vectors twice
ASKED = 4096  # questions of one Arrow batch
FIRST_ROUND = 16
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
EVERY = 50
LEAST = np.iinfo(np.int64).min


def quantised(embeddings: DataFrame, fold: int = 256, column: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the usable rows, v being the bytes of 64-bit components; and how many components there are."""
    x = F.col(column)
    good = embeddings.where(x.isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda e: e.cast("double")).alias("x"))
    good = good.where(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    d = max(good.agg(F.max(F.size("x"))).first()[0] or 0, 1)
    v = F.transform("x", lambda e: F.floor(F.greatest(F.least(e * fold, F.lit(LARGEST)), F.lit(-LARGEST))).cast("long"))
    v = F.concat(v, F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in _matrix(b.column(2))], pa.binary())], ["vec_id", "label", "v"])

    return good.select("vec_id", "label", v.alias("v")).mapInArrow(pack, "vec_id long, label long, v binary"), d


def _vectors(column, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column if isinstance(column, list) else column.to_pylist()), np.int64).reshape(-1, d)


def _codewords(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means with seeds drawn far apart; empty codewords stay where they are."""
    draw = np.random.default_rng(20240607)
    u = [x[draw.integers(len(x))]]
    far = ((x - u[0]) ** 2).sum(1)
    while len(u) < k and far.max() > 0:
        u.append(x[draw.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, ((x - u[-1]) ** 2).sum(1))
    u = np.stack(u)
    for _ in range(rounds):
        near = _nearest(x, u)
        n = np.bincount(near, minlength=len(u))
        sums = np.zeros_like(u)
        np.add.at(sums, near, x)
        u = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], u)
    return u


def _nearest(x: np.ndarray, u: np.ndarray) -> np.ndarray:
    return ((u * u).sum(1) - 2 * (x @ u.T)).argmin(1)


class Index:
    """Blocks of rows by cell (a DataFrame in the shared folder), the codebooks, and the radii of codewords and cells."""

    def __init__(self, rows: DataFrame, d: int):
        spark = rows.sparkSession
        self.d, self.half = d, d // 2
        # more rows of one label and vector than an anchor can use, its own among them, need not be searched
        same = Window.partitionBy("label", "v").orderBy("vec_id")
        again = Window.partitionBy("label", "v", "vec_id").orderBy("vec_id")
        most = max(POSITIVES, NEGATIVES)
        rows = rows.withColumn("n", F.row_number().over(again)).where(F.col("n") <= most).withColumn("n", F.dense_rank().over(same)).where(F.col("n") <= most + 1)
        rows = settle(rows.select("vec_id", "label", "v"))
        count = rows.count()
        sample = hash_share(rows, SAMPLE, count, "vec_id", "v").select("v").collect() or rows.select("v").limit(1).collect()
        k = int(min(CODEWORDS, max(1, (count / CELL_ROWS) ** 0.5)))
        x = _vectors([bytes(r["v"]) for r in sample], d).astype(float)
        scale = max(np.abs(x).max(initial=0.0), 1.0)
        self.books = [_codewords(part / scale, k) * scale for part in (x[:, : self.half], x[:, self.half :])] if count else []
        books, half = self.books, self.half

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _vectors(b.column(2), d).astype(float)
                cell = _nearest(x[:, :half], books[0]) * len(books[1]) + _nearest(x[:, half:], books[1])
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *b.columns], ["cell", *b.schema.names])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cell, part in _by_cell(batches):
                v = _vectors(part["v"], d)
                x = v.astype(float)
                radii = [float(np.sqrt(((y - books[h][c]) ** 2).sum(1)).max()) for h, (c, y) in enumerate(zip(divmod(cell, len(books[1])), (x[:, :half], x[:, half:]), strict=True))]
                ids = part["vec_id"].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([int(ids[0])]), *(pa.array([r]) for r in radii), pa.array([ids.tobytes()]), pa.array([part["label"].to_numpy().tobytes()]), pa.array([v.tobytes()])],
                                                 ["cell", "block", "r1", "r2", "ids", "labels", "vectors"])

        placed = rows.mapInArrow(assign, "cell int, vec_id long, label long, v binary").repartitionByRange(partitions(spark), "cell", "vec_id").sortWithinPartitions("cell", "vec_id")
        self.blocks = settle(placed.mapInArrow(pack, "cell int, block long, r1 double, r2 double, ids binary, labels binary, vectors binary"))
        k1, k2 = (len(b) for b in self.books) if count else (0, 0)
        self.filled, self.r1, self.r2 = np.zeros((k1, k2), bool), np.zeros((k1, k2)), np.zeros((k1, k2))
        for r in self.blocks.groupBy("cell").agg(F.max("r1"), F.max("r2")).collect():
            at = divmod(r[0], k2)
            self.filled[at], self.r1[at], self.r2[at] = True, r[1], r[2]

    def walks(self) -> Callable[[np.ndarray], Iterator[Iterator[tuple[float, float, float, int]]]]:
        """For each of some anchors its filled cells as (bound, own upper bound, own lower bound, cell), by falling bound."""
        books, half, filled, r1, r2 = self.books, self.half, self.filled, self.r1, self.r2
        most1, most2 = r1.max(1, initial=0.0), r2.max(0, initial=0.0)
        reach = max((np.sqrt((b * b).sum(1)).max(initial=0.0) for b in books), default=0.0) + max(r1.max(initial=0.0), r2.max(initial=0.0))

        def walk(a: np.ndarray) -> Iterator[Iterator[tuple[float, float, float, int]]]:
            a = a.astype(float)
            dots = [a[:, :half] @ books[0].T, a[:, half:] @ books[1].T]
            sizes = [np.sqrt((a[:, :half] ** 2).sum(1)), np.sqrt((a[:, half:] ** 2).sum(1))]
            for i in range(len(a)):
                yield _sequence(dots[0][i], dots[1][i], sizes[0][i], sizes[1][i])

        def _sequence(d1, d2, n1, n2):
            slack = 1e-9 * (n1 + n2) * reach + 1e-6
            b1, b2 = d1 + n1 * most1, d2 + n2 * most2
            o1, o2 = np.argsort(-b1, kind="stable"), np.argsort(-b2, kind="stable")
            s1, s2 = b1[o1], b2[o2]
            heap = [(-(s1[0] + s2[0]), 0, 0)]
            while heap:
                bound, i, j = heapq.heappop(heap)
                # the frontier: (i, j + 1) follows (i, j), and (i + 1, 0) follows (i, 0)
                if j + 1 < len(s2):
                    heapq.heappush(heap, (-(s1[i] + s2[j + 1]), i, j + 1))
                if j == 0 and i + 1 < len(s1):
                    heapq.heappush(heap, (-(s1[i + 1] + s2[0]), i + 1, 0))
                p, q = o1[i], o2[j]
                if filled[p, q]:
                    middle, width = d1[p] + d2[q], n1 * r1[p, q] + n2 * r2[p, q] + slack
                    yield -bound + slack, middle + width, middle - width, int(p) * len(s2) + int(q)

        return walk


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
    """Rows of sorted batches by cell, at most BLOCK at once."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool):
        table = pa.Table.from_batches(held).combine_chunks()
        cells = table["cell"].to_numpy()
        at = 0
        while at < len(cells):
            to = min(int(np.searchsorted(cells, cells[at], "right")), at + BLOCK)
            if to == len(cells) and not last and to - at < BLOCK:
                break
            yield int(cells[at]), {n: table[n].slice(at, to - at) for n in table.column_names}
            at = to
        held[:] = table.slice(at).to_batches()

    for b in batches:
        if b.num_rows:
            held.append(b)
            yield from cut(False)
    if held:
        yield from cut(True)


def search(index: Index, asking: DataFrame, goals: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, goal, score, vec_id, rank): the k best rows inside each window of each row of `asking`.

    `asking` holds anchor_id, label, v and `goals` windows as arrays `lo` and `hi`; rows of the own label are searched if
    `same`, of the others if not.
    """
    spark = asking.sparkSession
    d, n, walk = index.d, partitions(spark), index.walks()
    order = Window.partitionBy("anchor_id", "goal").orderBy(F.desc("score"), "vec_id")
    asked_schema = "cell int, anchor_id long, label long, v binary, windows binary"
    best, seen, step = None, 0, FIRST_ROUND

    def questions_of(rows: list) -> pa.RecordBatch:
        types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["cell", "anchor_id", "label", "v", "windows"])

    def ask(seen: int, step: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                vectors, lo, hi = _vectors(b.column(2), d), _matrix(b.column(3)), _matrix(b.column(4))
                ids, labels, found = (b.column(i).to_pylist() for i in (0, 1, 5))
                for i, cells in enumerate(walk(vectors)):
                    bars = lo[i].copy()
                    for f in found[i] or []:
                        bars[f["goal"]] = max(bars[f["goal"]], f["score"])
                    bars[lo[i] > hi[i]] = np.iinfo(np.int64).max
                    if (lo[i] > hi[i]).all():
                        continue
                    need, top, windows, asks, done = float(bars.min()), float(hi[i][lo[i] <= hi[i]].max()), np.stack([bars, hi[i]]).tobytes(), [], True
                    for place, (bound, upper, lower, cell) in enumerate(cells):
                        if bound < need:
                            break
                        if place >= seen + step:
                            done = False
                            break
                        if place >= seen and upper >= need and lower <= top:
                            asks.append(cell)
                    # a row without a cell: the walk isn't certified yet, although nothing is asked in this round
                    vector = vectors[i].tobytes()
                    out += [(c, ids[i], labels[i], vector, windows) for c in (asks if asks or done else [-1])]
                    while len(out) >= ASKED:
                        yield questions_of(out[:ASKED])
                        del out[:ASKED]
                if out:
                    yield questions_of(out)

        return run

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, part in _by_cell(batches):
            ids = part["anchor_id"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([int(ids[0])]), pa.array([ids.tobytes()]), pa.array([part["label"].to_numpy().tobytes()]), *(pa.array([b"".join(part[x].to_pylist())]) for x in ("v", "windows"))],
                                             ["cell", "pack", "a_ids", "a_labels", "a_vectors", "windows"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):  # one at a time, as each may hold megabytes
                r = b.slice(at, 1).to_pylist()[0]
                a_ids, a_labels, ids, labels = (np.frombuffer(r[x], np.int64) for x in ("a_ids", "a_labels", "ids", "labels"))
                a, c = (np.frombuffer(r[x], np.int64).reshape(-1, d) for x in ("a_vectors", "vectors"))
                windows = np.frombuffer(r["windows"], np.int64).reshape(-1, 2, goals)
                scores, out = _products(a, c), []
                usable = ((a_labels[:, None] == labels[None, :]) == same) & (a_ids[:, None] != ids[None, :])
                for g in range(goals):
                    inside = usable & (scores >= windows[:, 0, g, None]) & (scores <= windows[:, 1, g, None])
                    for i in np.flatnonzero(inside.any(1)):
                        pick = np.flatnonzero(inside[i])
                        pick = pick[_best(ids[pick], scores[i, pick], k)]
                        out.append((np.full(len(pick), a_ids[i]), np.full(len(pick), g, np.int32), scores[i, pick], ids[pick]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["anchor_id", "goal", "score", "vec_id"])

    while index.filled.any():
        if best is None:
            known = asking.withColumn("found", F.expr("cast(null as array<struct<goal:int,score:bigint>>)"))
        else:
            full = best.where(F.col("rank") == k).groupBy("anchor_id").agg(F.collect_list(F.struct("goal", "score")).alias("found"))
            known = asking.join(full, "anchor_id", "left")
        asked = settle(known.select("anchor_id", "label", "v", "lo", "hi", "found").mapInArrow(ask(seen, step), asked_schema))
        if empty(asked):
            break
        packs = settle(asked.where("cell >= 0").repartitionByRange(n, "cell", "anchor_id").sortWithinPartitions("cell", "anchor_id").mapInArrow(pack, "cell int, pack long, a_ids binary, a_labels binary, a_vectors binary, windows binary"))
        # one row for each cell, at most CODEWORDS ** 2
        high, wide = (t.groupBy("cell").agg(F.ceil(F.count("*") / MEET).alias(c)) for t, c in ((index.blocks, "high"), (packs, "wide")))
        grid = F.broadcast(settle(high.join(wide, "cell")))
        rows = index.blocks.join(grid, "cell").select("cell", "ids", "labels", "vectors", F.pmod(F.xxhash64("block"), "high").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1)).alias("x"))
        questions = packs.join(grid, "cell").select("cell", "a_ids", "a_labels", "a_vectors", "windows", F.pmod(F.xxhash64("pack"), "wide").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("high") - 1)).alias("y"))
        hits = questions.join(rows, ["cell", "x", "y"]).select("a_ids", "a_labels", "a_vectors", "windows", "ids", "labels", "vectors").mapInArrow(meet, "anchor_id long, goal int, score long, vec_id long")
        hits = hits if best is None else hits.unionByName(best.drop("rank"))
        best = settle(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), MEETINGS)
        seen, step = seen + step, step * 4
    return best if best is not None else spark.createDataFrame([], "anchor_id long, goal int, score long, vec_id long, rank int")


def mine(embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, every: int = EVERY, fold: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of anchors, the rows whose vec_id is divisible by `every`.

    A negative scores from `low` to `high` per cent of its positive.
    """
    if max(positives, negatives) > max(POSITIVES, NEGATIVES):
        raise ValueError(f"at most {max(POSITIVES, NEGATIVES)} positives and negatives, as the index holds no more copies")
    rows, d = quantised(embeddings, fold)
    rows = settle(rows)
    index = Index(rows, d)
    anchors = settle(rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "v")).alias("a")).select("anchor_id", "a.label", "a.v"))
    whole = anchors.withColumn("lo", F.array(F.lit(int(LEAST)))).withColumn("hi", F.array(F.lit(int(np.iinfo(np.int64).max))))
    near = search(index, whole, 1, positives, True).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = settle(near.withColumn("goal", F.dense_rank().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"))) - 1))
    # per cent of whole numbers without going beyond 64 bits
    hundreds, rest = F.expr("(positive_score - pmod(positive_score, 100)) div 100"), F.pmod(F.col("positive_score"), F.lit(100))
    lo, hi = hundreds * low + F.ceil(rest * low / 100), hundreds * high + F.floor(rest * high / 100)
    goals = near.select("anchor_id", "goal", lo.alias("lo"), hi.alias("hi")).distinct().groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("goal", "lo", "hi"))).alias("g"))

    def filled(name: str, missing: int):
        return F.concat(F.col(f"g.{name}"), F.array_repeat(F.lit(missing).cast("long"), F.lit(positives) - F.size("g"))).alias(name)

    windows = settle(anchors.join(goals, "anchor_id").select("anchor_id", "label", "v", filled("lo", 1), filled("hi", 0)))
    far = search(index, windows, positives, negatives, False)
    out = near.join(far, ["anchor_id", "goal"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def shifted_labels(embeddings: DataFrame) -> DataFrame:
    """`embeddings` with label (label + 1) % 10 where vec_id is divisible by 7, so that some neighbours have another label."""
    return embeddings.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


ORACLE = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and vec_id is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])), 0)::bigint as score
  from e a join e c on a.vec_id <> c.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::int as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""
