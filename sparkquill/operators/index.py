"""The stored index: sections with counts, postings and statistics as Parquet tables, built when first needed, refreshed file by file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.operators import search
from sparkquill.operators.lifecycle import replace_table
from sparkquill.operators.search import Index
from sparkquill.streaming.incremental import diff, refreshed

#: Raised whenever tables or analysis change: an index of another version is built anew.
VERSION = 5
#: Postings that are sorted together, and those that leave a worker at once.
SEGMENT, SLICE = 1_000_000, 20_000


def build(sections: DataFrame, files: DataFrame) -> Index:
    index = search.analysed(sections)
    index.files = files
    return index


def write(index: Index, path: str, old_files: int | None = None) -> None:
    """Every table staged and swapped in. Sections are analysed once, with their counts; postings follow from these without a shuffle, in segments sorted by term."""
    replace_table(index.files, f"{path}/files", old_files)
    replace_table(index.rows, f"{path}/rows")
    rows = index.rows.sparkSession.read.parquet(f"{path}/rows")
    replace_table(segmented(rows), f"{path}/postings")
    replace_table(search.meta_of(rows).withColumn("version", F.lit(VERSION)), f"{path}/meta")


def segmented(rows: DataFrame) -> DataFrame:
    """The postings of analysed sections, sorted by term within segments of SEGMENT postings: a query's terms touch few pages of each."""
    own = [c for c in search.POSTED if c != "term" and not c.startswith("f_")]
    counted = ["term", *(c for c in search.POSTED if c.startswith("f_"))]

    def cut(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        counts = batch.column(len(own))
        flat, section = counts.flatten(), counts.value_parent_indices()
        terms = flat.field(0).dictionary_encode()
        place = np.empty(len(terms.dictionary), np.int32)
        place[pc.sort_indices(terms.dictionary).to_numpy()] = np.arange(len(place), dtype=np.int32)
        order = np.argsort(place[terms.indices.to_numpy()], kind="stable")
        for at in range(0, len(order), SLICE):
            some = pa.array(order[at : at + SLICE])
            of = section.take(some)
            columns = {c: batch.column(i).take(of) for i, c in enumerate(own)} | {c: flat.field(i).take(some) for i, c in enumerate(counted)}
            yield pa.RecordBatch.from_arrays([columns[c] for c in search.POSTED], names=search.POSTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch.column(len(own)).flatten())
            if n >= SEGMENT:
                yield from cut(held)
                held, n = [], 0
        if n:
            yield from cut(held)

    kinds = {c: rows.schema[c].dataType.simpleString() for c in own} | {"term": "string"}
    return rows.select(*own, "counts").mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'int')}" for c in search.POSTED))


def probe(spark: SparkSession, path: str) -> dict:
    """present, readable, files of a stored index; one of another version has 0 files."""
    try:
        row = spark.read.parquet(f"{path}/meta").first()
    except Exception as e:
        return {"present": "PATH_NOT_FOUND" not in str(e), "readable": False, "files": 0}
    if row is None or row["version"] != VERSION:
        return {"present": True, "readable": row is not None, "files": 0}
    return {"present": True, "readable": True, "files": spark.read.parquet(f"{path}/files").count()}


def read(spark: SparkSession, path: str) -> Index | None:
    """The stored index; None if there is none, it cannot be read, or it is of another version."""
    try:
        meta = spark.read.parquet(f"{path}/meta")
        row = meta.first()
        if row is None or row["version"] != VERSION:
            return None
        rows = spark.read.parquet(f"{path}/rows")
        return Index(rows.drop("counts"), spark.read.parquet(f"{path}/postings"), meta, spark.read.parquet(f"{path}/files"), rows)
    except Exception as e:
        if any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER", "UNRESOLVED_COLUMN")):
            return None
        raise


def opened(spark: SparkSession, path: str, sections: Callable[[], DataFrame], files: Callable[[], DataFrame]) -> Index:
    """The stored index, built first if there is none that can be used."""
    index = read(spark, path)
    if index is None:
        write(build(sections(), files()), path)
        index = read(spark, path)
    return index


def refresh(old: Index, sections: DataFrame, files: DataFrame, verify: bool = False) -> Index:
    """The index after a change: unchanged files keep their rows, the others' sections are analysed again; statistics are always new."""
    changes = diff(old.files, files, verify)
    redo = sections.join(changes.where("change in ('new', 'changed')").select("file_id"), "file_id", "left_semi")
    part = build(redo, files)
    rows = refreshed(old.rows, changes, part.rows)
    kept = rows.drop("counts")
    return Index(kept, refreshed(old.postings, changes, part.postings), search.meta_of(kept), files, rows)
