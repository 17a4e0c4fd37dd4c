"""What the training-data operators share: table access, the shared folder, written intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from sparkquill.session import shared_folder

#: Text that an operator handles at once in a worker; longer single texts form a chunk of their own.
CHUNK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: its lineage is cut and it is computed once."""
    place = new_folder(df.sparkSession, what)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def open_store(uri: str):
    """(pyarrow file system, path in it) of a folder that Spark names by URI or plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


_kept: dict = {}


def kept_in_worker(key, make: Callable):
    """The one object that a Python worker keeps between tasks. Asking for another drops it, so caches of several operators never add up."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def release_memory() -> None:
    """Gives freed memory of a worker back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def text_chunks(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES, keeps: bool = False) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches with at most `limit` bytes of text each (or one row), and their texts, one slice listed at a time.

    Unless the caller keeps an object between tasks (keeps), what an earlier operator kept is dropped.
    """
    if not keeps:
        _kept.clear()
    for batch in batches:
        place = batch.schema.get_field_index(text)
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + limit, "right")))
            part = batch.slice(begin, end - begin)
            yield part, part.column(place).to_pylist()
            begin = end
    release_memory()
