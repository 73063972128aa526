"""Exact top-k inner products over norm-sorted vectors.

Candidates are range-partitioned by descending length and packed into blocks, which are visited in rounds of falling
length, each round twice as long as the one before. After each round every query's bar is the k-th score it has so far, so
bars tighten while lengths descend. The rotation that orders the variance is the SVD of the candidates' Gram matrix,
summed in Spark. A query block meets a block of candidates under these bounds, each an upper bound of the score, so
nothing that could enter the result is lost: |q||c| for the block's longest vector, before anything but two numbers is
joined; |q||c| for each vector; then partial sums over the leading rotated dimensions plus the product of the lengths of
the rests (Cauchy-Schwarz). What passes gets its exact integer product. The rounds end when no query block can gain.

Components are floor(64 * x), at most 2**62 in size. Vectors that are null or hold null or non-finite components take no
part. Shorter vectors are filled up with zeros. A repeated row is a candidate of its own; a query never meets rows of its
own vec_id, and a vec_id that stands in several rows asks once, with its least vector. Scores are exact up to 2**63 - 1
and stop there.

Scale: the work is (queries x candidates) / pruning, over pairs of blocks that can still gain; a block of 2,048 vectors is
one row. Sent to all tasks is only the rotation (d x d); the driver sees that and one number a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import empty, partitions, settle

BLOCK = 2048
FIRST_ROUND = 4  # blocks of candidates in the first round
LEAD = 16
EVERY = 20
TASK_BYTES = 64 << 20
LARGEST = float(1 << 62)


def quantised(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v): integer components of the usable vectors, all as long as the longest."""
    x = F.col(column)
    good = embeddings.where(x.isNotNull() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: e.cast("double")).alias("x"))
    good = good.where(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    d, least = good.agg(F.max(F.size("x")), F.min(F.size("x"))).first()
    v = F.transform("x", lambda e: F.floor(F.greatest(F.least(e * 64, F.lit(LARGEST)), F.lit(-LARGEST))).cast("long"))
    if d != least:
        v = F.concat(v, F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x")))
    return good.select("vec_id", v.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: in floating point where every partial sum fits 53 bits, in whole numbers of any size beyond 63."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    bound = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1]
    if bound < 2**52:
        return (q.astype(float) @ c.T.astype(float)).astype(np.int64)
    if bound < 2**62:
        return q @ c.T
    return np.clip(q.astype(object) @ c.T.astype(object), -(2**63) + 1, 2**63 - 1).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _rotation(rows: DataFrame, d: int) -> np.ndarray:
    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            x = _matrix(b.column(0)).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"i": [key[0].as_py()], "row": pa.array([np.stack(table["row"].to_numpy()).sum(0)], pa.list_(pa.float64()))})

    sums = rows.select("v").mapInArrow(gram, "i long, row array<double>").groupBy("i").applyInArrow(add, "i long, row array<double>").collect()
    g = np.zeros((d, d))
    for r in sums:
        g[r["i"]] = r["row"]
    return np.linalg.svd(g / max(np.abs(g).max(), 1.0))[0]


def _packed(rows: DataFrame, n: int, block: int) -> DataFrame:
    """Blocks (no, top, ids, vectors) in the order of falling length; top is the longest squared length of a block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        ids, norms, v = table["vec_id"].to_numpy(), table["norm2"].to_numpy(), _matrix(table["v"].combine_chunks())
        order = np.lexsort((ids, -norms))
        for at in range(0, len(order), block):
            own = order[at : at + block]
            yield pa.RecordBatch.from_arrays([pa.array([float(norms[own[0]])]), pa.array([ids[own].tobytes()]), pa.array([v[own].tobytes()])], ["top", "ids", "vectors"])

    sent = rows.select("vec_id", "v", "norm2").repartitionByRange(n, F.desc("norm2"), F.col("vec_id")).mapInArrow(pack, "top double, ids binary, vectors binary")
    sent = settle(sent.withColumn("id", F.monotonically_increasing_id()))
    # numbers of the blocks: one light row for each 2,048 vectors meets in this window
    numbers = sent.select("id", (F.row_number().over(Window.orderBy("id")) - 1).alias("no"))
    return settle(sent.join(numbers, "id").drop("id"))


def top_k(embeddings: DataFrame, k: int = 20, every: int = EVERY, column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every` its k best other rows."""
    spark = embeddings.sparkSession
    rows = settle(quantised(embeddings, column).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))))
    d, count = rows.agg(F.max(F.size("v")), F.count("*")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not count:
        return spark.createDataFrame([], schema)
    d = max(d, 1)
    if rows.where(F.size("v") == 0).limit(1).count():
        rows = rows.withColumn("v", F.array(F.lit(0).cast("long")))  # all vectors are empty
    rotation = _rotation(rows, d)
    lead = min(LEAD, d)
    n = max(partitions(spark), -(-count * d * 8 // TASK_BYTES))
    sent = _packed(rows, n, block)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"), F.min(F.struct("v", "norm2"))["norm2"].alias("norm2"))
    asked = _packed(queries, max(1, -(-n // every)), block).select(F.col("no").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("queries"))

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's bar, and the squared length below which no candidate can help any query of the block."""
        for b in batches:
            for r in b.to_pylist():
                ids, q = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["queries"], np.int64).reshape(-1, d)
                bars = np.full(len(ids), np.iinfo(np.int64).min)
                known = {x["query_id"]: x["score"] for x in r["bars"] or []}
                for i, x in enumerate(ids.tolist()):
                    bars[i] = known.get(x, bars[i])
                norm = np.sqrt((q.astype(float) ** 2).sum(1))
                least = np.where(bars <= 0, 0.0, np.maximum(bars.astype(float) * (1 - 1e-9) - 1e-6, 0.0) / np.maximum(norm, 1e-300))
                yield pa.RecordBatch.from_arrays([pa.array([r["q_block"]], pa.int32()), pa.array([float(np.minimum(least.min(), 1e150) ** 2) * (1 - 1e-9)]), pa.array([bars.tobytes()])], ["q_block", "need", "bars"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                q_ids, bars, ids = (np.frombuffer(r[x], np.int64) for x in ("q_ids", "bars", "ids"))
                q, c = (np.frombuffer(r[x], np.int64).reshape(-1, d) for x in ("queries", "vectors"))
                yield from found(r["q_block"], q_ids, bars, q, ids, c)

    def found(q_block, q_ids, bars, q, ids, c):
        qn, cn = np.sqrt((q.astype(float) ** 2).sum(1)), np.sqrt((c.astype(float) ** 2).sum(1))
        bar = np.where(bars <= -(2**63) + 1, -np.inf, bars.astype(float))  # no bar yet, or scores at their limit
        slack = 1e-9 * qn[:, None] * cn[None, :1] + 1e-6
        live = np.flatnonzero(qn * cn[0] + slack[:, 0] >= bar)
        if not len(live):
            return
        rq, rc = q[live].astype(float) @ rotation, c.astype(float) @ rotation
        # vectors stand by descending length: beyond `reach` no query of the block can gain
        reach = int(np.max(np.where(qn[live] > 0, np.searchsorted(-cn, -np.maximum(bar[live] - slack[live, 0], 0) / np.maximum(qn[live], 1e-300), "right"), len(c))))
        reach = len(c) if (bar[live] <= 0).any() else max(1, reach)
        rest_q, rest_c = np.sqrt((rq[:, lead:] ** 2).sum(1)), np.sqrt((rc[:reach, lead:] ** 2).sum(1))
        bound = rq[:, :lead] @ rc[:reach, :lead].T + rest_q[:, None] * rest_c[None, :] + slack[live]
        out = []
        for i, row in zip(live, bound, strict=True):
            pick = np.flatnonzero((row >= bar[i]) & (ids[:reach] != q_ids[i]))
            if len(pick):
                s = _products(q[i : i + 1], c[pick])[0]
                best = _best(ids[pick], s, k)
                best = best[s[best] >= bars[i]]
                out.append((np.full(len(best), q_block, np.int32), np.full(len(best), q_ids[i]), ids[pick][best], s[best]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["q_block", "query_id", "vec_id", "score"])

    # each block sends k rows for a query at most; the ranking is cut again before it is shuffled
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = None
    low, step, blocks = 0, FIRST_ROUND, sent.count()
    while low < blocks:
        high = min(low + step, blocks)
        if best is None:
            known = asked.withColumn("bars", F.expr("cast(null as array<struct<query_id:bigint,score:bigint>>)"))
        else:
            bars = best.where(F.col("rank") == k).groupBy("q_block").agg(F.collect_list(F.struct("query_id", "score")).alias("bars"))
            known = asked.join(bars, "q_block", "left")
        known = settle(known.select("q_block", "q_ids", "queries", "bars").mapInArrow(need, "q_block int, need double, bars binary"))
        tops = sent.where((F.col("no") >= low) & (F.col("no") < high)).select("no", "top")
        pairs = known.select("q_block", "need", F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("no")).join(tops, "no").where("top >= need").select("q_block", "no")
        pairs = settle(pairs)
        if empty(pairs):
            break  # what follows is shorter still
        whole = pairs.join(asked, "q_block").join(known.select("q_block", "bars"), "q_block").join(sent, "no")
        hits = whole.select("q_block", "q_ids", "queries", "bars", "ids", "vectors").mapInArrow(meet, "q_block int, query_id long, vec_id long, score long")
        hits = hits if best is None else hits.unionByName(best.drop("rank"))
        best = settle(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), 16)
        low, step = high, step * 2
    if best is None:
        return spark.createDataFrame([], schema)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from s qualify rank <= 20
"""
