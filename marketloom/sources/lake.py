"""Keyed writes to a Parquet lake, database upserts, work lists."""

from __future__ import annotations

from tempfile import mkdtemp

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local session without one gets its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def merged(existing: DataFrame, new: DataFrame, keys: list[str], newest: list[str] | None = None) -> DataFrame:
    """Both, a new row taking the place of an existing one with its keys.

    Of several new rows the last by `newest`, or by all other columns where the batch has no order.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [F.col(c).desc_nulls_last() for c in [*(newest or []), *(c for c in new.columns if c not in keys and c not in (newest or []))]]
    pick = Window.partitionBy(*keys).orderBy(F.desc("_new"), *rest)
    return both.withColumn("_n", F.row_number().over(pick)).where("_n = 1").drop("_n", "_new")


def _there(df: DataFrame, path: str):
    """The file system of `path`, and whether the table is there; one that was set aside by a job that died is put back."""
    hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    place, aside = hadoop.Path(path), hadoop.Path(f"{path}._old")
    files = place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place) and files.exists(aside):
        files.rename(aside, place)
    return files, place, aside, files.exists(place)


def upsert_parquet(df: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None, order_by: list[str] | None = None, newest: list[str] | None = None) -> None:
    """Merges `df` into the table at `path`. With partitions only those that `df` touches are read and rewritten.

    A table without partitions is written beside the old one, which is then set aside and removed last.
    """
    spark = df.sparkSession
    if df.isEmpty():
        return
    files, place, aside, there = _there(df, path)
    if there:
        existing = spark.read.parquet(path)
        if partition_by:
            existing = existing.join(df.select(*partition_by).distinct(), partition_by, "left_semi")
        out = merged(existing, df, keys, newest)
        if set(existing.columns) <= set(df.columns):
            out = out.select(existing.columns)
        if partition_by:
            out = settled(out)  # the files that are read are replaced below, so the merge is settled first
    else:
        out = merged(df.limit(0), df, keys, newest)
    if partition_by:
        out = out.repartition(*partition_by)
    if order_by:
        out = out.sortWithinPartitions(*[*(partition_by or []), *order_by])
    if partition_by:
        out.write.mode("overwrite").partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic").parquet(path)
        return
    beside = place.suffix("._new")
    out.write.mode("overwrite").parquet(f"{path}._new")
    if there:
        files.delete(aside, True)
        files.rename(place, aside)
    files.rename(beside, place)
    files.delete(aside, True)


def write_bars(df: DataFrame, path: str, interval: str, zone: str = "Asia/Kolkata") -> None:
    """Daily bars by symbol, minute bars by symbol, local year and month, merged by time into what is there; sorted by time inside."""
    parts = ["symbol"]
    if interval == "minute":
        local = F.from_utc_timestamp("ts_utc", zone)
        df = df.withColumn("year", F.year(local)).withColumn("month", F.month(local))
        parts += ["year", "month"]
    upsert_parquet(df, path, [*parts, "ts_utc"], parts, ["ts_utc"])


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def upsert_statement(table: str, stage: str, columns: list[str], keys: list[str], merge: bool = False) -> str:
    """The statement that moves staged rows into a table: `insert .. on conflict`, or the standard's `merge`."""
    rest = [c for c in columns if c not in keys]
    names = ", ".join(map(_quoted, columns))
    if merge:
        same = " and ".join(f"t.{_quoted(c)} = s.{_quoted(c)}" for c in keys)
        change = f" when matched then update set {', '.join(f'{_quoted(c)} = s.{_quoted(c)}' for c in rest)}" if rest else ""
        return f"merge into {_quoted(table)} t using {_quoted(stage)} s on {same}{change} when not matched then insert ({names}) values ({', '.join(f's.{_quoted(c)}' for c in columns)})"
    change = "update set " + ", ".join(f"{_quoted(c)} = excluded.{_quoted(c)}" for c in rest) if rest else "nothing"
    return f"insert into {_quoted(table)} ({names}) select {names} from {_quoted(stage)} on conflict ({', '.join(map(_quoted, keys))}) do {change}"


def upsert_jdbc(df: DataFrame, url: str, table: str, keys: list[str], properties: dict[str, str], batch: str, merge: bool = False, newest: list[str] | None = None, key_length: int = 512) -> bool:
    """Merges `df` into a database table, each batch once; False if `batch` has been merged before.

    Tasks stage the rows beside the table under the name of the batch, so a batch that starts again replaces its own rows only.
    One transaction then merges them and notes the batch in `<table>_batches`, whose key is the batch: of two runs
    of one batch the second changes nothing. Of several rows with one key the last by `newest` counts. Rows with a null key are
    left out, as a key can't be null.
    """
    stage, done = f"{table}_stage_{batch}", f"{table}_batches"
    jvm = df.sparkSession.sparkContext._jvm
    settings = jvm.java.util.Properties()
    for k, v in properties.items():
        settings.setProperty(k, v)
    if "driver" in properties:
        jvm.java.lang.Class.forName(properties["driver"])
    connection = jvm.java.sql.DriverManager.getConnection(url, settings)
    try:
        if not connection.getMetaData().getTables(None, None, done, None).next():
            connection.createStatement().execute(f'create table {_quoted(done)} ("batch" varchar(200) not null primary key)')
        ask = connection.prepareStatement(f'select 1 from {_quoted(done)} where "batch" = ?')
        ask.setString(1, batch)
        if ask.executeQuery().next():
            return False
        rows = merged(df.limit(0), df.dropna(subset=keys), keys, newest)
        # texts that are keys need a type that can be compared
        texts = ", ".join(f"`{c}` VARCHAR({key_length})" for c in keys if rows.schema[c].dataType.simpleString() == "string")
        writer = rows.write.option("createTableColumnTypes", texts) if texts else rows.write
        writer.jdbc(url, _quoted(stage), mode="overwrite", properties=properties)
        connection.setAutoCommit(False)
        note = connection.prepareStatement(f'insert into {_quoted(done)} values (?)')
        note.setString(1, batch)
        note.execute()
        connection.createStatement().execute(upsert_statement(table, stage, df.columns, keys, merge))
        connection.commit()
        connection.setAutoCommit(True)
        connection.createStatement().execute(f"drop table {_quoted(stage)}")
        return True
    finally:
        if not connection.getAutoCommit():
            connection.rollback()
        connection.close()


def backfill_worklist(symbols: DataFrame, start: str, end: str, done: DataFrame, max_age_days: int, now: str) -> DataFrame:
    """(symbol, from_date, to_date) by month, without those that are done and fresh; failed ones stay."""
    a, b = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    months = symbols.select("symbol").distinct().select("symbol", F.explode(F.sequence(F.trunc(a, "month"), F.trunc(b, "month"), F.expr("interval 1 month"))).alias("m"))
    chunks = months.select("symbol", F.greatest("m", a).alias("from_date"), F.least(F.last_day("m"), b).alias("to_date"))
    fresh = done.where((F.col("status") == "done") & (F.date_diff(F.to_date(F.lit(now)), F.to_date("ts")) < max_age_days)).select("symbol", "from_date")
    return chunks.join(fresh, ["symbol", "from_date"], "left_anti")


def ingest_status(manifest: DataFrame) -> DataFrame:
    bad = F.when(F.col("status") != "done", F.col("key"))
    return manifest.groupBy("dataset").agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") != "done").alias("failed"), F.coalesce(F.sum(F.when(F.col("status") == "done", F.col("rows"))), F.lit(0)).alias("rows"), F.array_join(F.sort_array(F.collect_list(bad)), ",").alias("failed_keys"))
