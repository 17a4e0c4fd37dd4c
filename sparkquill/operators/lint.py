"""Deterministic data-quality checks and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquill.functions.scalars import age_days
from sparkquill.functions.text import fold

# Fixed values of the lint contract.
STALE_DAYS = 90
BUDGETS = {"index": (200, 25_600), "manual": (200, 12_288)}
FAILING = ("index_budget", "manual_budget")
EVIDENCE_TRAIL = r"(?im)^#{2,6}\s+fil de preuves\s*$"
SHORTEST_KEY_WORD = 4
#: Characters of a text part that are joined before parts are compared.
LEAD = 8


def finding(category: str, subject: Column, detail: Column) -> list[Column]:
    return [F.lit(category).alias("category"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail")]


def stale(notes: DataFrame, now: Column) -> DataFrame:
    """file_id, reason (missing, unparsable, stale) and age of notes by their modified text."""
    at = F.try_to_timestamp(F.col("modified"))
    age = age_days(at, now)
    reason = F.when(F.col("modified").isNull() | (F.trim("modified") == ""), "missing").when(at.isNull(), "unparsable").when(age > STALE_DAYS, "stale")
    return notes.select("file_id", reason.alias("reason"), F.when(at.isNotNull(), age).alias("age")).where("reason is not null")


def duplicate_key(title: Column) -> Column:
    """The sorted distinct long words of a title."""
    found = F.regexp_extract_all(fold(title), F.lit(r"[a-z0-9]+"), F.lit(0))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda w: F.length(w) >= SHORTEST_KEY_WORD))), " ")


def duplicates(files: DataFrame) -> DataFrame:
    """key, n, first: titles with equal keys. Only the smallest id of a group is carried, not its members."""
    keyed = files.select("file_id", duplicate_key(F.col("title")).alias("key")).where("key <> ''")
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("file_id").alias("first")).where("n > 1")


def budget(files: DataFrame, kind: str) -> DataFrame:
    """file_id, lines, bytes, over of texts against a budget."""
    most_lines, most_bytes = BUDGETS[kind]
    lines, size = F.size(F.split("text", "\n", -1)).cast("long"), F.octet_length("text").cast("long")
    return files.select("file_id", lines.alias("lines"), size.alias("bytes"), ((lines > most_lines) | (size > most_bytes)).alias("over"))


def lacks_evidence_trail(files: DataFrame) -> DataFrame:
    return files.where(F.col("type").isin("entity", "topic") & ~F.col("text").rlike(EVIDENCE_TRAIL)).select("file_id")


def dream_issues(notes: DataFrame) -> DataFrame:
    """file_id, reason of notes with a dream mark: no date, or promoted."""
    marked = notes.where("dream = 'true'")
    undated = marked.where("dream_date is null").select("file_id", F.lit("no date").alias("reason"))
    return undated.unionByName(marked.where("statut = 'canon'").select("file_id", F.lit("promoted").alias("reason")))


def missing_from(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key right does not have."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def not_mentioned(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files whose slug the text of the index does not contain; the index is one row."""
    return files.crossJoin(F.broadcast(index.limit(1).select(F.col("text").alias("index_text")))).where(~F.col("index_text").contains(F.col("slug"))).drop("index_text")


def contained(texts: DataFrame, key: str, text: str, parts: DataFrame, part: str) -> DataFrame:
    """key, part of all texts that contain a part: texts' pieces of characters meet the parts' beginnings in an equi-join. An empty part is in none."""
    known = parts.select(part).where(F.length(part) > 0).distinct().withColumn("lead", F.left(part, F.lit(LEAD)))
    sizes = [r["n"] for r in known.select(F.length("lead").alias("n")).distinct().collect()]  # LEAD values at most

    def pieces(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(F.col(text), i, F.lit(n)))
        return F.when(F.length(text) >= n, every).otherwise(F.array().cast("array<string>"))

    cut = texts.select(key, text, F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *map(pieces, sizes)))).alias("lead"))
    return cut.join(known, "lead").where(F.col(text).contains(F.col(part))).select(key, part).distinct()


def unprocessed(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Raw files that no registry path names, wholly or in part; README and _ files do not count."""
    raw = files.where((F.col("zone") == "raw") & ~F.element_at(F.split("rel", "/"), -1).rlike("^(README|_)"))
    paths = registry.select("path").distinct()
    wholly = contained(raw.select("rel").distinct(), "rel", "rel", paths, "path").select("rel")
    partly = contained(paths, "path", "path", raw.select("rel").distinct(), "rel").select("rel")
    return raw.join(wholly.unionByName(partly).distinct(), "rel", "left_anti")


def self_sources(notes: DataFrame, slugs: DataFrame) -> DataFrame:
    """Notes that cite, among their sources, a note that the engine wrote itself."""
    cited = notes.select("file_id", F.explode("sources").alias("cited"))
    named = contained(cited.select("cited").distinct(), "cited", "cited", slugs, "slug")
    both = cited.join(named, "cited").join(slugs.select("slug", F.col("file_id").alias("written")), "slug")
    return both.where(F.col("file_id") != F.col("written")).select("file_id", "slug").distinct()


def without_context(files: DataFrame, prefixes: DataFrame) -> DataFrame:
    return files.join(F.broadcast(prefixes), F.col("file_id").startswith(F.col("prefix")), "left_anti")


def contexts(files: DataFrame, prefixes: DataFrame) -> DataFrame:
    """file_id and the texts of all prefixes that it begins with, general ones first."""
    hits = files.select("file_id").join(F.broadcast(prefixes), F.col("file_id").startswith(F.col("prefix")))
    return hits.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.length("prefix").alias("n"), "prefix", "text"))), lambda x: x["text"]), " — ").alias("context"))


def report(checks: dict[str, DataFrame], detail: dict[str, str] | None = None) -> DataFrame:
    """category, subject, detail of all checks, and fails: whether a finding of the category makes the whole fail (budgets alone do)."""
    out = None
    for category, rows in checks.items():
        subject = F.col(rows.columns[0])
        more = F.col((detail or {})[category]) if category in (detail or {}) else F.lit("")
        part = rows.select(*finding(category, subject, more), F.lit(category in FAILING).alias("fails"))
        out = part if out is None else out.unionByName(part)
    return out


def per_source(files: DataFrame) -> DataFrame:
    """source, files, bytes, lines and files by zone, with a total (source null)."""
    return files.rollup("source").agg(
        F.count("*").alias("files"),
        F.sum(F.octet_length("text")).cast("long").alias("bytes"),
        F.sum(F.size(F.split("text", "\n", -1))).cast("long").alias("lines"),
        *[F.count_if(F.col("zone") == z).alias(z) for z in ("distilled", "raw", "outputs")],
    )


def usage(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("searches"), F.count_if(F.col("confidence") == "low").alias("low"), F.coalesce(F.sum("chars"), F.lit(0)).cast("long").alias("chars"))
