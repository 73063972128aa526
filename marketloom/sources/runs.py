"""A keyed table as sorted runs: each batch is appended as a run of its own, and runs are merged by tiers.

A run is a folder `runs/<first>-<last>` that holds the newest row of each key of the batches from `first` to `last`, in key order;
it counts once Spark has marked it as complete. A run whose batches another complete run covers is out of date.
When `FAN` runs of one tier are there their rows are merged into a run of the next, so a row is written once on arrival and
once for each tier: bytes written stay proportional to what arrives, times the logarithm of the number of batches to the
base `FAN`, and a reader meets at most `FAN` - 1 runs of each tier. Nothing is overwritten: a batch that is written again,
after a failure, gets the same folder and the same rows, and out-of-date runs are removed by `vacuum` after a time in which readers
may still use them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FAN = 8


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def all_runs(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """(first, last, age of the mark in ms) of the complete runs."""
    files, folder = _files(spark, f"{path}/runs")
    if not files.exists(folder):
        return []
    out = []
    for status in files.listStatus(folder):
        mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if files.exists(mark):
            first, last = map(int, status.getPath().getName().split("-"))
            out.append((first, last, files.getFileStatus(mark).getModificationTime()))
    return sorted(out)


def live_runs(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """The complete runs that no other covers."""
    runs = [(a, b) for a, b, _ in all_runs(spark, path)]
    return [(a, b) for a, b in runs if not any((c, d) != (a, b) and c <= a and b <= d for c, d in runs)]


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that is last by `order`."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def _read(spark: SparkSession, path: str, runs: list[tuple[int, int]]) -> DataFrame:
    # a merge schema, as later batches may have more columns
    return spark.read.option("mergeSchema", True).parquet(*[f"{path}/runs/{a}-{b}" for a, b in runs])


def _write(rows: DataFrame, path: str, first: int, last: int, keys: list[str]) -> None:
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/runs/{first}-{last}")


def append(batch: DataFrame, path: str, number: int, keys: list[str], order: list[str]) -> None:
    """Writes `batch`, the `number`-th from 0 on, and merges the tiers that it fills. `order` tells what is newer inside a batch."""
    spark = batch.sparkSession
    done = all_runs(spark, path)
    if any(a <= number <= b for a, b, _ in done):
        return  # written before a failure
    rows = newest(batch, keys, order).drop(*order)
    _write(rows.withColumn("_batch", F.lit(number).cast("long")), path, number, number, keys)
    width = FAN
    while (number + 1) % width == 0:
        merge(spark, path, number + 1 - width, number, keys)
        width *= FAN


def merge(spark: SparkSession, path: str, first: int, last: int, keys: list[str]) -> None:
    """One run of the newest rows of the runs between two batches."""
    inside = [(a, b) for a, b in live_runs(spark, path) if first <= a and b <= last]
    if len(inside) > 1:
        _write(newest(_read(spark, path, inside), keys, ["_batch"]), path, first, last, keys)


def read(spark: SparkSession, path: str, keys: list[str], schema: str | None = None) -> DataFrame:
    """The newest row of each key; filters on keys reach the scans. Without any run an empty table of `schema`."""
    runs = live_runs(spark, path)
    if not runs:
        return spark.createDataFrame([], schema or "")
    rows = _read(spark, path, runs)
    return (newest(rows, keys, ["_batch"]) if len(runs) > 1 else rows).drop("_batch")


def vacuum(spark: SparkSession, path: str, keep_ms: int, now_ms: int) -> int:
    """Removes out-of-date runs whose covering run has been there for `keep_ms`; how many went."""
    files, folder = _files(spark, f"{path}/runs")
    runs, gone = all_runs(spark, path), 0
    for a, b, _ in runs:
        over = [t for c, d, t in runs if (c, d) != (a, b) and c <= a and b <= d]
        if over and now_ms - min(over) >= keep_ms:
            files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"{a}-{b}"), True)
            gone += 1
    return gone
