"""Tables about servers, routines and skills: declarations, transports, risk policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def servers(config: DataFrame, provenance: str) -> DataFrame:
    """name, provenance, transport, host, command of a map column servers (name to struct); never env or whole URLs."""
    rows = config.select(F.explode("servers").alias("name", "def"))
    kind, url = F.lower(F.coalesce("def.type", F.lit(""))), F.col("def.url")
    remote = kind.isin("http", "sse") | url.isNotNull()
    script = F.element_at(F.filter("def.args", lambda a: a.rlike(r"\.(m?js|py|ts|sh)$")), 1)
    target = F.element_at(F.split(F.coalesce(script, F.element_at("def.args", 1), F.lit("")), r"[\\/]"), -1)
    return rows.select(
        "name",
        F.lit(provenance).alias("provenance"),
        F.when(kind == "sse", "sse").when(remote, "http").otherwise("stdio").alias("transport"),
        F.when(remote, F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))).otherwise("").alias("host"),
        F.when(remote, "").otherwise(F.trim(F.concat_ws(" ", F.coalesce("def.command", F.lit("")), target))).alias("command"),
    )


def declared_level(read_only: Column, destructive: Column) -> Column:
    return F.when(read_only, "read").when(destructive, "action")


def connector_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), "_$", "")


def assessed(named: DataFrame, policy: DataFrame, prefixes: DataFrame, default: str = "unknown") -> DataFrame:
    """name, level, origin. policy: name, level; prefixes: place, prefix, level. An exact rule, else the first prefix, else the declared level, else the default."""
    exact = named.join(policy.select("name", F.col("level").alias("exact")), "name", "left")
    hits = named.select("name").distinct().join(F.broadcast(prefixes), F.col("name").startswith(F.col("prefix"))).groupBy("name").agg(F.min_by("level", "place").alias("by_prefix"))
    both = exact.join(hits, "name", "left")
    level = F.coalesce("exact", "by_prefix", "declared", F.lit(default))
    origin = F.when(F.coalesce("exact", "by_prefix").isNotNull(), "policy").when(F.col("declared").isNotNull(), "declared").otherwise("default")
    return both.select("name", level.alias("level"), origin.alias("origin"))


def first_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in order."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("nth = 1").drop("nth")


def schedule_text(hour: Column, minute: Column, weekday: Column) -> Column:
    clock = F.format_string("%02d:%02d", hour.cast("int"), F.coalesce(minute, F.lit(0)).cast("int"))
    days = F.array(*map(F.lit, ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")))
    return F.when(hour.isNull(), "on demand").when(weekday.isNull(), F.concat(F.lit("daily at "), clock)).otherwise(F.concat(F.element_at(days, (weekday % 7 + 1).cast("int")), F.lit(" at "), clock))
