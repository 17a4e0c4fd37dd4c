"""Drafts and canon: listing, promotion and demotion as column transforms, guarded writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquill.functions.scalars import age_days

SHRINK_TOLERANCE = 0.9
TRAIL = r"(?im)^(##\s+fil de preuves[^\n]*)$"
_LINE = r"(?m)^(statut\s*:\s*)(['\"]?){}(['\"]?)([ \t]*\r?)$"


def drafts(notes: DataFrame, now: Column) -> DataFrame:
    """Drafts, newest first, with their age; unreadable dates count as oldest."""
    at = F.try_to_timestamp("modified")
    rows = notes.where("statut = 'draft'").select("file_id", "title", "modified", age_days(at, now).alias("age_days"), F.coalesce(F.unix_millis(at), F.lit(0)).alias("at"))
    return rows.orderBy(F.desc("at"), "file_id").drop("at")


def with_status(text: Column, expected: str, target: str, note: Column | None = None) -> Column:
    """The text with the value of its status line changed and a dated note below its evidence trail; null where the status is another."""
    line = _LINE.format(expected)
    changed = F.regexp_replace(text, line, f"$1$2{target}$3$4")
    if note is not None:
        changed = F.concat(F.regexp_replace(changed, TRAIL + r"[\s\S]*\z", "$1"), F.when(changed.rlike(TRAIL), F.concat(F.lit("\n- "), note)).otherwise(""), F.regexp_extract(changed, TRAIL + r"([\s\S]*)\z", 2))
    return F.when(text.rlike(line), changed)


def promoted(text: Column, note: Column | None = None) -> Column:
    return with_status(text, "draft", "canon", note)


def demoted(text: Column, note: Column | None = None) -> Column:
    return with_status(text, "canon", "draft", note)


def may_replace(old_rows: int, new_rows: int, tolerance: float = SHRINK_TOLERANCE) -> bool:
    """False if a new artefact lost more than a tenth of the rows."""
    return new_rows >= int(old_rows * tolerance)


def work_waits(drafts: DataFrame, unprocessed: DataFrame) -> DataFrame:
    """One row: drafts, unprocessed, and whether either leaves work to do."""
    both = drafts.agg(F.count("*").alias("drafts")).crossJoin(unprocessed.agg(F.count("*").alias("unprocessed")))
    return both.withColumn("work", (F.col("drafts") > 0) | (F.col("unprocessed") > 0))


def cooling_down(runs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """One row: the last run (at), and whether it is less than so many hours ago."""
    last = runs.agg(F.max("at").alias("last"))
    return last.withColumn("cooling_down", F.coalesce(F.unix_millis(now) - F.unix_millis("last") < hours * 3_600_000, F.lit(False)))


def soft_deleted(notes: DataFrame, doomed: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """The notes that stay, and manifest rows of those that went; raw notes always stay."""
    gone = notes.where("zone <> 'raw'").join(doomed.select("file_id").distinct(), "file_id", "left_semi")
    manifest = gone.select(at.alias("at"), F.col("file_id").alias("original"), F.concat(F.lit("trash/"), F.sha1("file_id")).alias("trashed"))
    return notes.join(gone.select("file_id"), "file_id", "left_anti"), manifest


def replace_table(df: DataFrame, path: str, old_rows: int | None = None, tolerance: float = SHRINK_TOLERANCE) -> None:
    """Writes a staged copy beside path, checks that it did not shrink, then swaps it in by renaming."""
    spark = df.sparkSession
    jvm, staged, old = spark.sparkContext._jvm, f"{path}.staged", f"{path}.old"
    df.write.mode("overwrite").parquet(staged)
    if old_rows is not None and not may_replace(old_rows, spark.read.parquet(staged).count(), tolerance):
        raise ValueError("the new table lost more than a tenth of the rows")
    hadoop = jvm.org.apache.hadoop.fs.Path
    store = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.delete(hadoop(old), True)
    if store.exists(hadoop(path)):
        store.rename(hadoop(path), hadoop(old))
    store.rename(hadoop(staged), hadoop(path))
    store.delete(hadoop(old), True)
