"""Markdown structure: lines, fences, sections, breadcrumbs, links, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.functions.text import slugify

# Patterns and sizes of the structure contract.
WIKILINK = r"\[\[([^\]|#]+)(?:#([^\]|]+))?(?:\|([^\]]+))?\]\]"
FENCE = r"^\s*(?:>\s*)*(```|~~~)"
HEADING = r"^(#{1,6})\s+(.*)$"
HEADING_TAIL = r"\s+#+\s*$"
PREAMBLE = "(preamble)"
MERGE_BELOW, SPLIT_ABOVE, NAVIGATIONAL_BELOW, NAVIGATIONAL_SHARE, FLOOR = 200, 3000, 400, 0.25, 0.4
#: Files of an Arrow batch that are listed at a time.
FILES_AT_ONCE = 64


def lines(texts: DataFrame) -> DataFrame:
    """file_id, line (from 1), body, offset of the line's first character, and whether it is a fence or inside one."""
    rows = texts.select("file_id", F.posexplode(F.split("text", "\n", -1)).alias("place", "body"))
    before = Window.partitionBy("file_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    fence = F.col("body").rlike(FENCE)
    return rows.select(
        "file_id",
        (F.col("place") + 1).alias("line"),
        "body",
        F.coalesce(F.sum(F.length("body") + 1).over(before), F.lit(0)).alias("offset"),
        fence.alias("is_fence"),
        (F.coalesce(F.sum(fence.cast("int")).over(before), F.lit(0)) % 2 == 1).alias("in_fence"),
    )


def line_of_offset(text: Column, offset: Column) -> Column:
    """The line (from 1) that a character offset lies in."""
    return F.length(F.regexp_replace(F.substring(text, F.lit(1), offset), "[^\n]", "")) + 1


def sections(texts: DataFrame) -> DataFrame:
    """file_id, section (0: before any heading), level, title, breadcrumb, line, line_end, offset, body (with its heading)."""
    marked = lines(texts)
    is_heading = ~F.col("in_fence") & ~F.col("is_fence") & F.col("body").rlike(HEADING)
    level = F.when(is_heading, F.length(F.regexp_extract("body", HEADING, 1)))
    title = F.when(is_heading, F.regexp_replace(F.trim(F.regexp_extract("body", HEADING, 2)), HEADING_TAIL, ""))
    by_line = Window.partitionBy("file_id").orderBy("line")
    so_far = by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = marked.withColumn("level", level).withColumn("title", title)
    rows = rows.withColumn("section", F.sum(F.col("level").isNotNull().cast("int")).over(so_far))
    # The open title of each level: set by a heading of the level, closed by one above it.
    for k in range(1, 7):
        own = F.when(F.col("level") == k, F.col("title")).when(F.col("level") < k, "")
        rows = rows.withColumn(f"open{k}", F.last(own, ignorenulls=True).over(so_far))
    crumb = F.concat_ws(" > ", *[F.when(F.col(f"open{k}") != "", F.col(f"open{k}")) for k in range(1, 7)])
    grouped = rows.withColumn("crumb", crumb).groupBy("file_id", "section").agg(
        F.coalesce(F.max("level"), F.lit(0)).alias("level"),
        F.coalesce(F.max("title"), F.lit(PREAMBLE)).alias("title"),
        F.min_by("crumb", "line").alias("breadcrumb"),
        F.min("line").alias("line"),
        F.max("line").alias("line_end"),
        F.min("offset").alias("offset"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), "\n").alias("body"),
    )
    return grouped


def title_of(first_heading: Column, frontmatter: Column, name: Column) -> Column:
    """The first level-1 heading, else a title of the frontmatter, else the file name."""
    return F.coalesce(first_heading, *[F.element_at(frontmatter, k) for k in ("titre", "title", "video")], F.regexp_replace(name, r"\.[^.]+$", ""))


def strip_headings(body: Column) -> Column:
    return F.regexp_replace(body, r"^(#{1,6}\s[^\n]*\n)+", "")


def links(texts: DataFrame) -> DataFrame:
    """file_id, line, target, anchor, alias of wikilinks outside fences and inline code."""
    rows = lines(texts).where("not is_fence and not in_fence")
    plain = F.regexp_replace("body", "`[^`]*`", "")
    found = F.arrays_zip(*[F.regexp_extract_all(plain, F.lit(WIKILINK), F.lit(k)).alias(n) for k, n in ((1, "target"), (2, "anchor"), (3, "alias"))])
    return rows.select("file_id", "line", F.explode(found).alias("x")).select("file_id", "line", F.trim("x.target").alias("target"), F.nullif("x.anchor", F.lit("")).alias("anchor"), F.nullif("x.alias", F.lit("")).alias("alias"))


def is_navigational(body: Column) -> Column:
    """Short and mostly wikilinks."""
    text = F.regexp_replace(body, r"^\s+|\s+\z", "")
    linked = F.aggregate(F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(0)), F.lit(0), lambda n, x: n + F.length(x))
    return (F.length(text) < NAVIGATIONAL_BELOW) & (linked > F.length(text) * NAVIGATIONAL_SHARE)


def split_ranges(text: str, most: int = SPLIT_ABOVE) -> list[tuple[int, int]]:
    """Contiguous ranges of at most `most` characters that cover a text: cut after a paragraph, else a sentence, else a word."""
    import re

    out, at = [], 0
    while len(text) - at > most:
        floor, limit = at + int(most * FLOOR), at + most
        paragraph = text.rfind("\n\n", floor, limit)
        if paragraph >= 0:
            cut = paragraph + 2
        elif sentences := [m.end() for m in re.finditer(r"[.!?…]\s", text[floor:limit])]:
            cut = floor + sentences[-1]
        else:
            space = text.rfind(" ", floor + 1, limit)
            cut = space + 1 if space >= 0 else limit
        out.append((at, cut))
        at = cut
    out.append((at, len(text)))
    return out


def _merged(parts: list[dict]) -> list[dict]:
    """Sections of one file, in order, as chunks that are not split yet."""
    made, pending = [], None
    for s in parts:
        if s["navigational"]:
            continue
        body = s["body"]
        bare = (body.partition("\n")[2] if s["level"] else body).strip()
        if pending is not None:
            s = s | {"line": pending["line"], "offset": pending["offset"], "body": pending["body"] + "\n" + body}
            pending = None
        if not bare:
            pending = s
        elif made and len(bare) < MERGE_BELOW:
            made[-1]["body"] += "\n" + s["body"]
        else:
            made.append(dict(s))
    if pending is not None:
        if made:
            made[-1]["body"] += "\n" + pending["body"]
        else:
            made.append(dict(pending))
    return made


def chunks(parts: DataFrame) -> DataFrame:
    """Chunks of sections(): navigational ones go, a heading alone joins the next, a short one joins the previous, long ones are split.

    file_id, chunk, part, parts, line, title, breadcrumb, offset, text. A file is one row: a note, of bounded size.
    """
    names = ["file_id", "chunk", "part", "parts", "line", "title", "breadcrumb", "offset", "text"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FILES_AT_ONCE):
                part, rows = batch.slice(at, FILES_AT_ONCE), []
                for file_id, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for i, s in enumerate(_merged(own)):
                        ranges = split_ranges(s["body"])
                        rows += [(file_id, i, k, len(ranges), s["line"], s["title"], s["breadcrumb"], s["offset"] + a, s["body"][a:b]) for k, (a, b) in enumerate(ranges)]
                columns = zip(*rows) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    schema = "file_id string, chunk int, part int, parts int, line int, title string, breadcrumb string, offset long, text string"
    section = F.struct("section", "level", "title", "breadcrumb", "line", "offset", "body", is_navigational(F.col("body")).alias("navigational"))
    return parts.groupBy("file_id").agg(F.array_sort(F.collect_list(section)).alias("own")).mapInArrow(run, schema)


def section_at(parts: DataFrame, line: int) -> DataFrame:
    """Of each file, the section whose lines hold the line, else the nearest."""
    away = F.when(F.lit(line).between(F.col("line"), F.col("line_end")), 0).otherwise(F.least(F.abs(F.col("line") - line), F.abs(F.col("line_end") - line)))
    near = Window.partitionBy("file_id").orderBy(away, "section")
    return parts.withColumn("nth", F.row_number().over(near)).where("nth = 1").drop("nth")



def outline(texts: DataFrame) -> DataFrame:
    """file_id, line, level, title of all headings."""
    return sections(texts).where("level > 0").select("file_id", "line", "level", "title")


def section_by_slug(parts: DataFrame, slug: str) -> DataFrame:
    """Of each file, the first section whose title has the slug, else the first whose title's slug contains it."""
    own = slugify(F.col("title"))
    rank = F.when(own == slug, 0).when(own.contains(slug), 1)
    order = Window.partitionBy("file_id").orderBy("rank", "section")
    return parts.withColumn("rank", rank).where("rank is not null").withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth", "rank")
