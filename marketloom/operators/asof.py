"""As-of joins dealt by key and range of time, and the dated policy rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The policy repo rate in per cent, by the day from which it holds.
REPO_RATES = (
    ("2000-01-01", 8.00), ("2004-10-27", 6.00), ("2005-10-26", 6.25), ("2006-06-09", 6.75), ("2007-03-31", 7.75), ("2008-06-25", 8.50), ("2008-10-20", 8.00), ("2008-12-08", 6.50),
    ("2009-04-21", 4.75), ("2010-03-19", 5.00), ("2010-11-02", 6.25), ("2011-10-25", 8.50), ("2012-04-17", 8.00), ("2013-05-03", 7.25), ("2014-01-28", 8.00), ("2015-01-15", 7.75),
    ("2015-09-29", 6.75), ("2016-04-05", 6.50), ("2017-08-02", 6.00), ("2018-06-06", 6.25), ("2018-08-01", 6.50), ("2019-02-07", 6.25), ("2019-06-06", 5.75), ("2019-10-04", 5.15),
    ("2020-03-27", 4.40), ("2020-05-22", 4.00), ("2022-05-04", 4.40), ("2022-06-08", 4.90), ("2022-08-05", 5.40), ("2022-09-30", 5.90), ("2022-12-07", 6.25), ("2023-02-08", 6.50),
    ("2024-10-09", 6.50), ("2025-02-07", 6.25), ("2025-04-09", 6.00), ("2025-06-06", 5.50), ("2025-12-05", 5.25),
)


def policy_rate_table(spark: SparkSession) -> DataFrame:
    """(series_id, label, date, value, unit, source) of the policy rate."""
    rows = spark.createDataFrame(list(REPO_RATES), "date string, value double")
    return rows.select(F.lit("RBI:REPO_RATE").alias("series_id"), F.lit("RBI policy repo rate %").alias("label"), F.to_date("date").alias("date"), "value", F.lit("percent").alias("unit"), F.lit("rbi_manual").alias("source"))


def asof_join(rows: DataFrame, facts: DataFrame, at: str, values: list[str], by: list[str] | None = None, bucket_days: int = 64) -> DataFrame:
    """`rows` with the `values` of the newest fact at or before each row's `at`, of the same keys `by`; null where there is none.

    Both sides stand in one line for each key and stretch of `bucket_days`; what a stretch begins with is carried over
    from the ones before, of which only the last fact of each takes part. So one key of any length is many tasks, and neither side
    is sent to all. `at` is a date or a timestamp on both sides; of several facts at one time the greatest counts. A null
    key or time finds nothing.
    """
    by = by or []
    days = F.datediff(F.col(at).cast("date"), F.lit("1970-01-01").cast("date"))
    found = F.struct(*values)
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    kind = found_type(facts, values)
    told = facts.dropna(subset=[*by, at]).groupBy(*by, at).agg(F.max(found).alias("_v"))
    line = told.select(*by, F.col(at), F.lit(0).alias("_asks"), "_v").withColumn("_row", F.lit(None).cast(rows.select(own.alias("r")).schema["r"].dataType))
    asks = rows.select(*by, F.col(at), F.lit(1).alias("_asks"), F.lit(None).cast(kind).alias("_v"), own.alias("_row"))
    both = line.unionByName(asks).withColumn("_bucket", F.floor(days / bucket_days)).repartition(*by, "_bucket")  # read twice below
    inside = Window.partitionBy(*by, "_bucket").orderBy(F.col(at).asc_nulls_last(), "_asks").rowsBetween(Window.unboundedPreceding, 0)
    here = both.select(*by, "_bucket", "_asks", "_row", F.last("_v", ignorenulls=True).over(inside).alias("_here"), F.col(at).isNotNull().alias("_timed")).where("_asks = 1")
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.where("_bucket is not null").groupBy(*by, "_bucket").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(at))).alias("_end"))
    carried = ends.select(*by, "_bucket", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    out = here.join(carried, [*by, "_bucket"], "left")
    v = F.when(F.col("_timed"), F.coalesce("_here", "_carried"))
    return out.select("_row.*", *[v[c].alias(c) for c in values])


def found_type(facts: DataFrame, values: list[str]):
    return facts.select(F.struct(*values).alias("v")).schema["v"].dataType


def policy_rate_asof(steps: DataFrame, days: DataFrame) -> DataFrame:
    """(date, rate): for each day the last step (date, rate) on or before it."""
    return asof_join(days.select("date").distinct(), steps, "date", ["rate"])
