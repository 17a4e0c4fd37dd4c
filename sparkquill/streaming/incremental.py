"""Change detection between snapshots, and a stream that keeps a table of the latest versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def diff(old: DataFrame, new: DataFrame, verify: bool = False) -> DataFrame:
    """file_id, change (new, gone, changed, same) by sig and incoming-anchor hash, and with verify by content hash."""
    a = old.select("file_id", F.col("sig").alias("s0"), F.col("anchor_sig").alias("a0"), F.col("sha1").alias("h0"))
    b = new.select("file_id", F.col("sig").alias("s1"), F.col("anchor_sig").alias("a1"), F.col("sha1").alias("h1"))
    same = F.col("s0").eqNullSafe(F.col("s1")) & F.col("a0").eqNullSafe(F.col("a1"))
    if verify:
        same = same & F.col("h0").eqNullSafe(F.col("h1"))
    joined = a.withColumn("in0", F.lit(True)).join(b.withColumn("in1", F.lit(True)), "file_id", "full")
    change = F.when(F.col("in0").isNull(), "new").when(F.col("in1").isNull(), "gone").when(same, "same").otherwise("changed")
    return joined.select("file_id", change.alias("change"))


def refreshed(index: DataFrame, changes: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """An index (with file_id) after a diff: rows of unchanged files, and the rebuilt rows of the others."""
    kept = index.join(changes.where("change = 'same'").select("file_id"), "file_id", "left_semi").select(*index.columns)
    return kept.unionByName(rebuilt)


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("nth = 1").drop("nth")


def debounced(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Bursts of events of a key: begin, end, n. Works on batches and, with a watermark, on streams."""
    return events.groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n")


def upsert_stream(spark: SparkSession, path: str, schema: str, target: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """Reads new Parquet files as they come and keeps, in target, the latest row of each key; a batch that runs again changes nothing.

    Each batch writes the whole table beside the old one and swaps it in.
    """
    from sparkquill.operators.lifecycle import replace_table

    def apply(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        rows = batch
        try:
            rows = session.read.parquet(target).unionByName(batch)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        replace_table(latest(rows, key, [F.desc(order)]), target)

    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
