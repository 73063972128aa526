"""Incremental jobs: bars into the lake, news with tags."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.news import entity_match
from ..sources import runs
from ..sources.payloads import BAR_SCHEMA, FEED_ITEM, feed_rows


def stream_bars(spark: SparkSession, source: str, path: str, checkpoint: str, files: int | None = None) -> StreamingQuery:
    """Bars from landed Parquet files into sorted runs (`sources.runs`), one for each batch; the newest bar of a time wins.

    Newer is what stands in a later file, or further down in one. A bar that comes again, however late, takes the place of
    the older one, so no state is kept; `files` bounds a batch.
    """
    landed = spark.readStream.schema(BAR_SCHEMA)
    bars = (landed.option("maxFilesPerTrigger", files) if files else landed).parquet(source)
    # _metadata tells the arrival of each row
    bars = bars.select("*", F.col("_metadata.file_modification_time").alias("_at"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))

    def land(batch: DataFrame, number: int) -> None:
        runs.append(batch, path, number, ["symbol", "ts_utc"], ["_at", "_file", "_row"])

    return bars.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_bars(spark: SparkSession, path: str) -> DataFrame:
    """The newest bar of each symbol and time of what `stream_bars` has landed."""
    return runs.read(spark, path, ["symbol", "ts_utc"], BAR_SCHEMA)


class NewsCounts(StreamingQueryListener):
    """What became of the items of the `stream_news` runs that it is given to: arrived = written + repeats + late, in `totals`."""

    def __init__(self) -> None:
        self.totals = {"arrived": 0, "written": 0, "repeats": 0, "late": 0, "batches": 0}
        self.name, self.listens = f"news-{uuid.uuid4().hex}", False

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        told = event.progress
        if told.name != self.name:
            return
        seen = told.observedMetrics
        self.totals["batches"] += 1
        self.totals["arrived"] += (seen["arrived"]["n"] or 0) if "arrived" in seen else 0
        self.totals["written"] += (seen["written"]["n"] or 0) if "written" in seen else 0
        for state in told.stateOperators:
            self.totals["late"] += state.numRowsDroppedByWatermark
            self.totals["repeats"] += int(state.customMetrics.get("numDroppedDuplicateRows", 0))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def stream_news(spark: SparkSession, source: str, path: str, checkpoint: str, aliases: DataFrame, late: str = "3 days", files: int | None = None, counts: NewsCounts | None = None) -> StreamingQuery:
    """Items of landed feed files (`source`/<feed>/*.xml) into day partitions, once for each link, with the symbols they name.

    Each batch is matched with the alias table as it stands then. Items that come later than `late` behind the newest are
    dropped; `counts`, a listener, says how many arrived, were written, repeated a link or came too late. Items without
    a time take that of their file. A batch has partitions of its own below a day, so one that runs again after a failure replaces
    its rows; untagged batches stay beside the table, in `path`-arrived.
    """
    landed = spark.readStream.format("xml").option("rowTag", "item").schema(FEED_ITEM).option("recursiveFileLookup", True)
    items = (landed.option("maxFilesPerTrigger", files) if files else landed).load(source).select("*", "_metadata")
    feed = F.element_at(F.split("_metadata.file_path", "/"), -2)
    rows = feed_rows(items, feed, F.col("_metadata.file_modification_time")).observe("arrived", F.count("*").alias("n"))
    once = rows.withWatermark("published", late).dropDuplicatesWithinWatermark(["url"]).observe("written", F.count("*").alias("n"))

    def land(batch: DataFrame, number: int) -> None:
        # the batch is read twice below, its state and its counts must see it once
        batch.write.mode("overwrite").parquet(f"{path}-arrived/{number}")
        batch = spark.read.parquet(f"{path}-arrived/{number}")
        blob = batch.select("url", F.concat_ws(" ", "title", "summary").alias("blob"))
        tagged = batch.join(entity_match(blob, aliases, "url", "blob"), "url", "left").withColumn("day", F.to_date("published")).withColumn("batch", F.lit(number))
        tagged.write.mode("overwrite").partitionBy("day", "batch").option("partitionOverwriteMode", "dynamic").parquet(path)

    writer = once.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if counts is not None:
        if not counts.listens:
            spark.streams.addListener(counts)
            counts.listens = True
        writer = writer.queryName(counts.name)
    return writer.start()
