"""Time-decayed feedback: events of use and dead ends, per-file reports, byte-stable event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.functions.scalars import decay, half_up
from sparkquill.functions.text import query_key

CORROBORATIONS = 2
KEPT_DEAD_ENDS, RECENT = 3, 10


def stable(events: DataFrame) -> DataFrame:
    """Events once each (ts, file, outcome, query), ordered, so that writing them again gives the same bytes."""
    keys = ["ts", "file", "outcome", "query"]
    first = Window.partitionBy(*keys).orderBy("sha1")
    return events.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth").orderBy(*keys)


def with_age(events: DataFrame, now: Column) -> DataFrame:
    return events.where("ts is not null").withColumn("age", F.greatest((F.unix_millis(now) - F.unix_millis(F.col("ts").cast("timestamp"))) / 86_400_000.0, F.lit(0.0)))


def report(events: DataFrame, now: Column, current: DataFrame | None = None) -> DataFrame:
    """file, status, score, used, deadend, corroborations, stale, last_ts. current: file, sha1_now of the files that exist."""
    rows = with_age(events, now)
    if current is not None:
        rows = rows.join(current, "file", "left")
        old = F.coalesce((F.col("sha1") != "") & (F.col("sha1_now") != "") & (F.col("sha1") != F.col("sha1_now")), F.lit(False))
    else:
        old = F.lit(False)
    good = F.col("outcome") == "used"
    rows = rows.withColumn("old", old).withColumn("gain", F.when(good, decay(F.col("age"))).otherwise(-decay(F.col("age"))))
    out = rows.groupBy("file").agg(
        F.sum("gain").alias("exact"),
        F.count_if(good).alias("used"),
        F.count_if(~good).alias("deadend"),
        F.count_distinct(F.when(good & ~F.col("old"), query_key(F.col("query")))).alias("corroborations"),
        F.bool_or("old").alias("stale"),
        F.max("ts").alias("last_ts"),
    )
    status = F.when((F.col("exact") > 0) & (F.col("corroborations") >= CORROBORATIONS), "preferred").when(F.col("exact") <= 0, "contested").otherwise("tentative")
    return out.select("file", status.alias("status"), half_up(F.col("exact"), 3).alias("score"), "used", "deadend", "corroborations", "stale", "last_ts")


def dead_ends(events: DataFrame, now: Column) -> DataFrame:
    """The latest dead ends: at most three of a file, ten in all."""
    rows = with_age(events, now).where("outcome <> 'used'")
    latest = Window.partitionBy("file").orderBy(F.desc("ts"), "query")
    few = rows.withColumn("nth", F.row_number().over(latest)).where(F.col("nth") <= KEPT_DEAD_ENDS)
    return few.orderBy(F.desc("ts"), "file", "query").limit(RECENT).select("file", "ts", "query", F.floor("age").cast("long").alias("age_days"))
