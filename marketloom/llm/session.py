"""Small helpers that all operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is set, a local session gets one of its own."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


#: rows of an Arrow batch while something is settled: whole texts stand in it, so it bounds a worker's memory
ROWS_AT_ONCE = 2000
_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, rows_at_once: int = ROWS_AT_ONCE, tidy: bool = False) -> DataFrame:
    """`df` computed once and kept in the shared folder, its lineage cut; `tidy`: its shuffle files go at once."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    usual, kept = spark.conf.get(_RECORDS), spark.conf.get(_TIDY)
    spark.conf.set(_RECORDS, str(min(rows_at_once, int(usual)) if int(usual) > 0 else rows_at_once))
    try:
        if tidy:
            spark.conf.set(_TIDY, "true")
            df = df.select("*")  # a query takes up the setting when it is made
        return df.checkpoint()
    finally:
        spark.conf.set(_RECORDS, usual)
        spark.conf.set(_TIDY, kept)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


SENT_IDS = 2_000_000


def having(rows: DataFrame, ids: DataFrame, column: str = "doc_id", anti: bool = False) -> DataFrame:
    """`rows` whose `column` is among those of `ids`, or is not.

    Up to `SENT_IDS` ids are sent to all tasks, so that wide rows need no shuffle; more are joined.
    """
    ids = settle(ids.select(column).distinct())
    few = ids.count() <= SENT_IDS
    return rows.join(F.broadcast(ids) if few else ids, column, "left_anti" if anti else "left_semi")


def held_out(doc_id) -> object:
    """True for the quarter of documents whose labels are not learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have yet."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def hash_share(rows: DataFrame, at_most: int, count: int, *columns: str) -> DataFrame:
    """About `at_most` of the `count` rows, at most twice as many, chosen by a hash of `columns`; each task sends its share only."""
    steps = 1 << 40
    if count <= at_most:
        return rows
    return rows.where(F.pmod(F.xxhash64(*columns), F.lit(steps)) < int(steps * at_most / count)).limit(2 * at_most)
