"""Small text formats of the introspection tables: a YAML subset, property lists, skills."""

from __future__ import annotations

import plistlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquill.sources.corpus import frontmatter


def parse_yaml_subset(text: str | None) -> dict[str, str]:
    """Top-level keys of a frontmatter block; values may be quoted, or folded (>) or literal (|) blocks."""
    lines = (text or "").replace("\r\n", "\n").split("\n")
    if not lines or lines[0].strip() != "---":
        return {}
    out: dict[str, str] = {}
    i = 1
    while i < len(lines) and lines[i].strip() not in ("---", "..."):
        key, colon, value = lines[i].partition(":")
        i += 1
        if not colon or not key.strip() or key[0].isspace():
            continue
        value = value.strip()
        if value[:1] in (">", "|"):
            block = []
            while i < len(lines) and (not lines[i].strip() or lines[i][0].isspace()):
                block.append(lines[i].strip())
                i += 1
            value = (" " if value[0] == ">" else "\n").join(block).strip()
        elif len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        out[key.strip()] = value
    return out


def yaml_subset(text: Column) -> Column:
    @F.pandas_udf("map<string,string>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(parse_yaml_subset)

    return run(text)


def property_list(content: Column) -> Column:
    """label, program (joined arguments), hour, minute, weekday of a property list; null where it does not parse."""

    def one(data: bytes) -> dict | None:
        try:
            p = plistlib.loads(data)
        except Exception:  # a damaged file is a row without values
            return None
        when = p.get("StartCalendarInterval") or {}
        when = when[0] if isinstance(when, list) and when else when
        return {"label": p.get("Label"), "program": " ".join(map(str, p.get("ProgramArguments", []))), "hour": when.get("Hour"), "minute": when.get("Minute"), "weekday": when.get("Weekday")}

    @F.pandas_udf("label string, program string, hour int, minute int, weekday int")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame([one(x) or {} for x in values], columns=["label", "program", "hour", "minute", "weekday"], dtype=object)
        return rows.astype(dict.fromkeys(("hour", "minute", "weekday"), "Int32"))

    return run(content)


def skills(files: DataFrame) -> DataFrame:
    """name, scope, description of SKILL.md files (scope, rel, text); the first of each scope and name."""
    head = frontmatter(F.col("text"))
    folder = F.element_at(F.split("rel", "/"), -2)
    rows = files.where(F.col("rel").endswith("/SKILL.md")).select("scope", F.coalesce(F.element_at(head, "name"), folder).alias("name"), F.element_at(head, "description").alias("description"), "rel")
    return rows.groupBy("scope", "name").agg(F.min_by("description", "rel").alias("description")).orderBy("scope", "name")
