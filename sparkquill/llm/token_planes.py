"""Token ids in bit-plane files: tokenize, write shards in ascending doc_id order, read them back.

File format, one file per shard, all numbers little-endian:

    magic "SQPLANE1"
    per chunk of CHUNK_IDS ids (the last may be shorter): its planes, each a zstandard frame
    document table: zstandard frame of (doc_id int64, valid uint8, n_tokens int64) columns
    chunk index: zstandard frame of JSON
    trailer: offset of the index uint64, its length uint64, magic

The ids of a chunk, as unsigned 32-bit integers, are transposed into 4 byte planes or 32 bit planes:
plane k holds byte (bit) k of every id. High planes are nearly constant and vanish in compression.
The chunk index has offset, lengths of planes, ids and first id of every chunk, so any id range is
read by decoding only the chunks that it touches.

Defined results: null texts are empty and give only the end id; a null doc_id comes first; rows that
repeat a doc_id are each written, in an order fixed by a hash of their text; an empty table gives no
file and no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkquill.llm.common import kept_in_worker, new_folder, open_store, table, text_chunks, written

MAGIC = b"SQPLANE1"
CHUNK_IDS = 1 << 16
END_ID = 0
#: Encoded units in a generation of a worker's cache (about 0.2 KB each); two generations are kept, the older one goes when the newer is full.
CACHE_UNITS = 200_000
LONGEST_CACHED = 64
#: Letters below this code point (Latin, Greek, Cyrillic) are letters in every Unicode version in use.
LETTERS_BELOW = 0x500
LETTERS_END = chr(LETTERS_BELOW)
_MARKS = {".", ",", ";", ":", "!", "?"}

_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


class _Odd(Exception):
    """White space beside a space or line end: the text needs the slower split."""


class UnitEncoder:
    """Ids of whole texts as little-endian uint32 bytes, each distinct unit encoded once by the tokenizers library.

    The byte-level pre-tokenizer always breaks before a single space, and before and after a single
    line end, that stand between two characters which are no white space. So a text may be cut there
    and the ids of the units joined; texts with other white space are cut only at such spaces. Special
    tokens hold no white space, so none is cut: as the library does by itself, their strings in a text
    give their ids, or with special_as_text those of ordinary text.
    """

    def __init__(self, path: str, cache_units: int = CACHE_UNITS, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        if any(c.isspace() for t in self.tokenizer.get_added_tokens_decoder().values() for c in t.content):
            raise ValueError("a special token with white space")
        model, alphabet = self.tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        printable = {c: alphabet.pre_tokenize_str(chr(c))[0][0] for c in [32, *range(LETTERS_BELOW)] if c == 32 or chr(c).isalpha()}
        encode = self.encode

        class Units(dict):
            """Unit to ids. A unit of letters is one pre-token, which the BPE model takes directly; one mark after letters is another."""

            def __init__(self, lead: str, strict: bool):
                self.lead, self.strict, self.old = lead, strict, {}

            def __missing__(self, unit: str) -> bytes:
                if self.strict and (not unit or unit[0].isspace() or unit[-1].isspace()):
                    raise _Odd
                if ids := self.old.get(unit):
                    pass
                elif unit.isalpha() and max(unit) < LETTERS_END:
                    ids = array("I", [t.id for t in model.tokenize((self.lead + unit).translate(printable))]).tobytes()
                elif unit[-1:] in _MARKS and unit[:-1].isalpha() and max(unit) < LETTERS_END:
                    ids = self[unit[:-1]] + marks[unit[-1]]
                else:
                    ids = encode(self.lead + unit)
                if len(unit) <= LONGEST_CACHED:
                    if len(self) >= cache_units:
                        self.old = dict(self)
                        self.clear()
                    self[unit] = ids
                return ids

        marks = {c: self.encode(c) for c in _MARKS if c}
        self.first, self.later = Units("", True), Units(" ", True)
        self.any_first, self.any_later = Units("", False), Units(" ", False)
        self.line_end = self.encode("\n")

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        try:
            lines = []
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                lines.append(self.first[first] + b"".join(map(self.later.__getitem__, rest)))
            return self.line_end.join(lines)
        except _Odd:
            first, *rest = _BETWEEN.split(text)
            return self.any_first[first] + b"".join(map(self.any_later.__getitem__, rest))


def encoder(path: str, special_as_text: bool = False) -> UnitEncoder:
    """The worker's encoder for a tokenizer file, kept between tasks."""
    return kept_in_worker(("encoder", path, special_as_text), lambda: UnitEncoder(path, special_as_text=special_as_text))


def split_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "bit":
        return [x.tobytes() for x in np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1, bitorder="little")]
    return [np.ascontiguousarray(x).tobytes() for x in octets.T]


def join_planes(parts: list[bytes], n: int, planes: str) -> np.ndarray:
    if planes == "bit":
        bits = np.unpackbits(np.stack([np.frombuffer(x, np.uint8) for x in parts]), axis=1, bitorder="little")[:, :n]
        octets = np.packbits(bits.T, axis=1, bitorder="little")
    else:
        octets = np.stack([np.frombuffer(x, np.uint8) for x in parts], axis=1)
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


class ShardWriter:
    """Writes one file; chunks leave memory as they fill."""

    def __init__(self, out, planes: str = "byte", chunk_ids: int = CHUNK_IDS, level: int = 3):
        import zstandard

        self.out, self.planes, self.chunk_ids = out, planes, chunk_ids
        self.zip = zstandard.ZstdCompressor(level)
        self.at, self.total, self.chunks, self.docs = 0, 0, [], []
        self.held: list[bytes] = []
        self.held_bytes = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def _chunk(self, data: bytes) -> None:
        ids = np.frombuffer(data, "<u4")
        begin = self.at
        sizes = [self._put(self.zip.compress(x)) for x in split_planes(ids, self.planes)]
        self.chunks.append({"offset": begin, "planes": sizes, "first": self.total, "ids": len(ids)})
        self.total += len(ids)

    def add(self, doc: int | None, ids: bytes) -> None:
        self.docs.append((doc, len(ids) // 4))
        self.held.append(ids)
        self.held_bytes += len(ids)
        if self.held_bytes >= 4 * self.chunk_ids:
            data, step = b"".join(self.held), 4 * self.chunk_ids
            full = len(data) - len(data) % step
            for i in range(0, full, step):
                self._chunk(data[i : i + step])
            self.held, self.held_bytes = [data[full:]], len(data) - full

    def close(self) -> None:
        if self.held_bytes:
            self._chunk(b"".join(self.held))
        docs = b"".join([
            np.array([0 if d is None else d for d, _ in self.docs], "<i8").tobytes(),
            np.array([d is not None for d, _ in self.docs], np.uint8).tobytes(),
            np.array([n for _, n in self.docs], "<i8").tobytes(),
        ])
        begin = self.at
        table_bytes = self._put(self.zip.compress(docs))
        index = self.zip.compress(json.dumps({"planes": self.planes, "ids": self.total, "docs": {"offset": begin, "bytes": table_bytes, "rows": len(self.docs)}, "chunks": self.chunks}).encode())
        begin = self.at
        self._put(index)
        self._put(begin.to_bytes(8, "little") + len(index).to_bytes(8, "little") + MAGIC)


class ShardReader:
    """Random access to a shard by id range, and its documents."""

    def __init__(self, file):
        import zstandard

        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        size = file.size()
        tail = file.read_at(24, size - 24)
        if tail[16:] != MAGIC:
            raise ValueError("no plane file")
        begin, n = int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:16], "little")
        self.index = json.loads(self.unzip.decompress(file.read_at(n, begin)))
        self.firsts = [c["first"] for c in self.index["chunks"]]

    def chunk(self, k: int) -> np.ndarray:
        c = self.index["chunks"][k]
        data, parts, at = self.file.read_at(sum(c["planes"]), c["offset"]), [], 0
        for n in c["planes"]:
            parts.append(self.unzip.decompress(data[at : at + n]))
            at += n
        return join_planes(parts, c["ids"], self.index["planes"])

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids from begin to end; only the chunks that hold them are read."""
        if end <= begin:
            return np.zeros(0, "<u4")
        a, b = (int(np.searchsorted(self.firsts, x, "right")) - 1 for x in (begin, end - 1))
        both = np.concatenate([self.chunk(k) for k in range(a, b + 1)])
        return both[begin - self.firsts[a] : end - self.firsts[a]]

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        d = self.index["docs"]
        data = self.unzip.decompress(self.file.read_at(d["bytes"], d["offset"]))
        n = d["rows"]
        keys, valid = np.frombuffer(data, "<i8", n), np.frombuffer(data, np.uint8, n, 8 * n)
        return [k if v else None for k, v in zip(keys.tolist(), valid.tolist(), strict=True)], np.frombuffer(data, "<i8", n, 9 * n)

    def stream(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, first id, ids, crc32 of the ids) of each document; one chunk is held at a time."""
        keys, sizes = self.documents()
        k, have, at = 0, b"", 0
        chunks = len(self.firsts)
        for key, n in zip(keys, sizes.tolist(), strict=True):
            crc, left = 0, 4 * n
            while left:
                if not have and k < chunks:
                    have, k = memoryview(self.chunk(k).tobytes()), k + 1
                part = have[:left]
                crc, left, have = zlib.crc32(part, crc), left - len(part), have[len(part) :]
            yield key, at, n, crc
            at += n


def write_shards(docs: DataFrame, path: str, folder: str, planes: str = "byte", chunk_ids: int = CHUNK_IDS, special_as_text: bool = False) -> DataFrame:
    """Writes the documents' ids to folder and returns a row per shard: shard, file, n_docs, n_ids.

    A task writes under a name of its own and renames at the end, so a task that runs again replaces
    its file with an equal one.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, place = open_store(folder)
        encode, end = encoder(path, special_as_text), int(END_ID).to_bytes(4, "little")
        shard, writer, part = context.partitionId(), None, ""
        for chunk, texts in text_chunks(batches, "text", keeps=True):
            if writer is None:
                store.create_dir(place, recursive=True)
                part = f"{place}/.attempt-{context.taskAttemptId()}"
                out = store.open_output_stream(part)
                writer = ShardWriter(out, planes, chunk_ids)
            for key, text in zip(chunk.column(0).to_pylist(), texts, strict=True):
                writer.add(key, encode(text) + end)
        if writer:
            writer.close()
            out.close()
            name = f"{place}/shard-{shard:06d}.planes"
            with contextlib.suppress(FileNotFoundError):
                store.delete_file(name)
            store.move(part, name)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "file": [name.rsplit("/", 1)[1]], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([writer.total], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    # Rows that repeat a doc_id may lie in several ranges, in the same order.
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(ordered.mapInArrow(run, "shard long, file string, n_docs long, n_ids long"), "planes-index")


def read_shards(index: DataFrame, folder: str) -> DataFrame:
    """A row per document of the shards: doc_id, start (ids before it in all shards), n_tokens, ids_crc32."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = open_store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{place}/{row['file']}") as file:
                    rows: list[tuple] = []
                    for x in ShardReader(file).stream():
                        rows.append(x)
                        if len(rows) == 50_000:
                            yield _rows(rows, row["base"])
                            rows = []
                    yield _rows(rows, row["base"])

    def _rows(rows: list[tuple], base: int) -> pa.RecordBatch:
        keys, at, n, crc = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64()), "start": pa.array([base + x for x in at], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    # One row per shard: their number is the number of write tasks.
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = max(1, index.count())
    based = index.withColumn("base", before).select("file", "base").repartition(shards)
    return based.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, planes: str = "byte", chunk_ids: int = CHUNK_IDS, folder: str | None = None, special_as_text: bool = False) -> DataFrame:
    """Writes the documents' token ids as plane files and returns what the files hold (see read_shards)."""
    folder = folder or new_folder(docs.sparkSession, "planes")
    return read_shards(write_shards(docs, path, folder, planes, chunk_ids, special_as_text), folder)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op5_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written in ascending doc_id order and read back."""
    return token_files(table(spark, sf_dir, "documents"), default_tokenizer())
