"""Mixing sources to target weights with a low-discrepancy source schedule.

Sources in code-point order (null last) take the weights in turn. Each gets a target of words: its weight's share of
all words, at most `max_repeats` times its own words, what is above being shared again by weight.

A source's documents stand in an order shuffled by a digest of doc_id and are cut into blocks of equal token counts.
Slot i of the schedule is the point frac(i * golden ratio), mapped through the cumulative slot weights of the sources;
the r-th slot of a source takes its block r modulo its number of blocks. Any prefix of the schedule therefore holds the
sources close to their weights.

Defined results: null text or text of white space has size 0 and is never taken; a null source is a source of its own,
the last; repeated rows are documents of their own; an empty table gives an empty result; other columns are ignored.

Scale: order and running word counts are taken within (source, digest prefix), so a hot source is spread over 65,536
groups; only per-source rows (one for each source) meet in a single window. Rows with one doc_id (or none) and one size
are one row with a count until their places are known, and are then dealt out in pieces of `PIECE`, so that such a group
costs its window one row for each size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import settle

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
BLOCK_TOKENS = 1024
LEAST_BLOCKS = 256
#: golden ratio fraction in steps of 2**-31
PERIOD, STEP = 2147483648, 1327217885
SLOTS_IN_CHUNK = 65536
PIECE = 65536


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
                   block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per source of (source, size, copies): k (its place), source_size, target, block (tokens of a block), blocks, slots."""
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    sources = sources.withColumn("k", F.row_number().over(order) - 1).withColumn("w", w).withColumn("cap", F.col("source_size") * float(max_repeats))
    by = Window.orderBy(F.col("cap") / F.col("w"), "k")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumn("level", level)
    # the first source, by cap in units of weight, that the shared level does not fill
    open_level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("at"), "k", "level"))).over(Window.partitionBy())
    sources = sources.withColumn("target", F.coalesce(F.least("cap", open_level["level"] * F.col("w")), F.lit(0.0)))
    block = F.least(F.lit(block_tokens), F.greatest(F.lit(1), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("long")
    sources = sources.withColumn("block", block).withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")))
    return sources.withColumn("slots", F.round(F.col("target") / F.col("block")).cast("long")).select("source", "k", "source_size", "target", "block", "blocks", "slots")


def schedule(targets: DataFrame) -> DataFrame:
    """(slot, k, rank, block_id): the source and block that each slot of the mix takes, in order."""
    spark = targets.sparkSession
    total = targets.agg(F.sum("slots")).first()[0] or 0
    upto = Window.orderBy("k")
    spans = targets.where("slots > 0").withColumn("hi", F.sum("slots").over(upto) / float(max(total, 1))).withColumn("lo", F.coalesce(F.lag("hi").over(upto), F.lit(0.0)))
    spans = spans.select("k", "slots", "blocks", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * 1024), F.least(F.lit(1023), F.floor(F.col("hi") * 1024)))).alias("cell"))
    slots = spark.range(total + total // 64 + 64 if total else 0).withColumnRenamed("id", "slot")
    slots = slots.withColumn("point", (F.col("slot") % PERIOD * STEP % PERIOD) / float(PERIOD)).withColumn("cell", F.floor(F.col("point") * 1024))
    dealt = slots.join(spans, "cell").where("point >= lo and point < hi").select("slot", "k", "slots", "blocks", F.floor(F.col("slot") / SLOTS_IN_CHUNK).alias("chunk"))
    counts = dealt.groupBy("k", "chunk").count()
    counts = counts.select("k", "chunk", (F.sum("count").over(Window.partitionBy("k").orderBy("chunk")) - F.col("count")).alias("base"))
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("k", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(counts, ["k", "chunk"]).withColumn("rank", F.col("r") + F.col("base")).where("rank < slots")
    return ranked.select("slot", "k", "rank", (F.col("rank") % F.col("blocks")).alias("block_id"))


def shuffled(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents of (doc_id, source, size, copies), each copy a row, with k, block, and first: the words of the source that stand before, in its shuffled order."""
    tagged = sized.withColumn("digest", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("cell", F.substring("digest", 1, 4))
    tagged = tagged.join(targets.select(F.col("source").alias("of"), "k", "source_size", "target", "block"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "source")
    tagged = tagged.withColumn("words", F.col("size") * F.col("copies"))
    cells = tagged.groupBy("k", "cell").agg(F.sum("words").alias("here")).withColumn("part", F.substring("cell", 1, 2))
    parts = cells.groupBy("k", "part").agg(F.sum("here").alias("inside"))
    parts = parts.select("k", "part", (F.sum("inside").over(Window.partitionBy("k").orderBy("part")) - F.col("inside")).alias("below"))
    cells = cells.withColumn("base", F.sum("here").over(Window.partitionBy("k", "part").orderBy("cell")) - F.col("here"))
    cells = cells.join(parts, ["k", "part"]).select("k", "cell", (F.col("base") + F.col("below")).alias("base"))
    order = Window.partitionBy("k", "cell").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = tagged.withColumn("to", F.sum("words").over(order)).join(cells, ["k", "cell"])
    placed = placed.withColumn("start", F.col("to") + F.col("base") - F.col("words"))
    placed = placed.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / PIECE)))).repartition("k", "doc_id", "size", "piece")
    copy = F.explode(F.sequence(F.col("piece") * PIECE, F.least("copies", (F.col("piece") + 1) * PIECE) - 1))
    placed = placed.withColumn("copy", copy)
    return placed.select("doc_id", "size", "k", "source_size", "target", "block", (F.col("start") + F.col("copy") * F.col("size")).alias("first"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every document; see the module's text."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = settle(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")))
    targets = settle(source_targets(sized, weights, max_repeats, block_tokens))
    used = schedule(targets).groupBy("k", "block_id").agg(F.count("*").alias("uses"))
    placed = shuffled(sized, targets)
    some = placed.where("size > 0").select("*", F.explode(F.sequence(F.floor(F.col("first") / F.col("block")), F.floor((F.col("first") + F.col("size") - 1) / F.col("block")))).alias("block_id"))
    inside = F.least(F.col("first") + F.col("size"), (F.col("block_id") + 1) * F.col("block")) - F.greatest("first", F.col("block_id") * F.col("block"))
    taken = some.join(used, ["k", "block_id"], "left").groupBy("k", "first", "doc_id", "size", "source_size", "target").agg(F.sum(inside * F.coalesce("uses", F.lit(0))).alias("taken"))
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return taken.select(columns).unionByName(none.select(columns))


ORACLE = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s1 as (select source, sum(size)::bigint as source_size from sized group by source),
s2 as (select *, row_number() over (order by source nulls last) - 1 as k from s1),
s3 as (select *, [5.0, 2.0, 1.0][(k % 3 + 1)::int]::double as w, source_size * 3.0::double as cap from s2),
s4 as (select *, ((sum(source_size) over ())::double - coalesce(sum(cap) over (order by cap / w, k rows between unbounded preceding and 1 preceding), 0))
  / sum(w) over (order by cap / w, k rows between current row and unbounded following) as level from s3),
s5 as (select arg_min(level, row(cap / w, k)) as level from s4 where level * w <= cap),
s6 as (select source, k, source_size, coalesce(least(cap, s5.level * w), 0.0) as target, least(1024, greatest(1, source_size // 256))::bigint as block from s4, s5),
s7 as (select *, ((source_size + block - 1) // block)::bigint as blocks, round(target / block)::bigint as slots from s6),
s8 as (select *, sum(slots) over (order by k) / (sum(slots) over ())::double as hi, coalesce(sum(slots) over (order by k rows between unbounded preceding and 1 preceding), 0) / (sum(slots) over ())::double as lo from s7),
n as (select sum(slots)::bigint as total from s7),
pts as (select i, ((i % 2147483648) * 1327217885 % 2147483648) / 2147483648.0::double as p
  from (select unnest(range((case when total > 0 then total + total // 64 + 64 else 0 end)::bigint)) as i from n)),
ranked as (select k, slots, blocks, row_number() over (partition by k order by i) - 1 as r from pts join s8 on p >= lo and p < hi),
used as (select k, r % blocks as block_id, count(*) as uses from ranked where r < slots group by all),
placed as (select d.doc_id, d.size, s.k, s.source_size, s.target, s.block,
  sum(d.size) over (partition by s.k order by md5(coalesce(d.doc_id::varchar, '')), d.doc_id, d.size rows between unbounded preceding and current row) - d.size as first
  from sized d join s7 s on d.source is not distinct from s.source),
pieces as (select *, unnest(case when size > 0 then range((first // block)::bigint, ((first + size - 1) // block + 1)::bigint) else [-1]::bigint[] end) as block_id from placed)
select p.doc_id, p.size, p.source_size, p.target,
  sum(case when p.size = 0 then 0 else (least(p.first + p.size, (p.block_id + 1) * p.block) - greatest(p.first, p.block_id * p.block)) * coalesce(u.uses, 0) end)::bigint as taken
from pieces p left join used u on p.k = u.k and p.block_id = u.block_id
group by p.k, p.first, p.doc_id, p.size, p.source_size, p.target
"""
