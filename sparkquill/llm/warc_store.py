"""WARC archives, read index first.

Writing: each task makes gzip files of WARC/1.1 records, a gzip member per record, and reports for
every record its file, offset, length, URL and payload digest. Equal payloads are stored once: the
record with the smallest page_id is a response, the others are revisits that refer to it.

Reading: rows of the index are selected first, sorted by file and offset, and their byte ranges are
coalesced where the gap is small; each coalesced range is one read, from which the records are
unpacked. So a selection of records reads little more than those records.

Defined results: null html is an empty payload, null URLs are left out of the header; a null page_id
counts as larger than all others; rows that repeat the smallest page_id with an equal payload are all
responses; an empty table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.llm.common import new_folder, open_store, table, text_chunks, written

FILE_BYTES = 1 << 30
#: Ranges at most so far apart are read at once, up to LARGEST_READ.
LARGEST_GAP = 64 << 10
LARGEST_READ = 8 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def make_record(page: int | None, url: str | None, payload: bytes, response: bool, refers_to: int | None) -> tuple[bytes, str]:
    """A record, and its payload digest."""
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if response else http
    head = {
        "WARC-Type": "response" if response else "revisit",
        "WARC-Record-ID": _record_id(page, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else re.sub(r"[\r\n]", "", url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": None if response else REVISIT_PROFILE,
        "WARC-Refers-To": None if response else _record_id(refers_to, digest),
        "X-Page-Id": page,
        "X-Refers-To-Page": None if response else refers_to,
        "X-Payload-Length": len(payload),
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n", digest


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload (empty for revisits) of a record; digest and lengths are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record: {first[:40]}")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and (fields["WARC-Payload-Digest"] != f"sha1:{digest_of(payload)}" or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return fields, payload


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def with_responses(pages: DataFrame) -> DataFrame:
    """page_id, url, html, first (smallest page_id with that payload).

    Only payloads that several rows have are joined, and their table is written first: so adaptive
    execution sees both sides of the join and splits a payload that very many pages share.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("payload", F.concat_ws("-", F.sha1("html"), F.octet_length("html")))
    firsts = written(rows.groupBy("payload").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload", "first", F.lit(True).alias("shared")), "payloads")
    first = F.when(F.col("shared"), F.col("first")).otherwise(F.col("page_id"))
    return rows.join(firsts, "payload", "left").select("page_id", "url", "html", first.alias("first"))


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the pages' records to folder and returns the index (see INDEX)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, place = open_store(folder)
        out, part, name, at, n = None, "", "", 0, 0

        def close() -> None:
            out.close()
            with contextlib.suppress(FileNotFoundError):
                store.delete_file(f"{place}/{name}")
            store.move(part, f"{place}/{name}")

        for chunk, texts in text_chunks(batches, "html"):
            rows = []
            for page, url, html, first in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist(), texts, chunk.column(3).to_pylist(), strict=True):
                if out is not None and at >= file_bytes:
                    close()
                    out = None
                if out is None:
                    store.create_dir(place, recursive=True)
                    name, at, n = f"pages-{context.partitionId():06d}-{n:04d}.warc.gz", 0, n + 1
                    part = f"{place}/.attempt-{context.taskAttemptId()}-{n}"
                    out = store.open_output_stream(part)
                response = page == first
                data, digest = make_record(page, url, html.encode("utf-8", "surrogatepass"), response, first)
                member = _gzip(data)
                out.write(member)
                rows.append((name, at, len(member), url, digest, page, "response" if response else "revisit"))
                at += len(member)
            columns = zip(*rows, strict=True)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            close()

    return written(with_responses(pages).mapInArrow(run, INDEX), "warc-index")


def coalesced(ranges: list[tuple[int, int]], gap: int = LARGEST_GAP, most: int = LARGEST_READ) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) ranges as (begin, end, members) reads."""
    out: list[tuple[int, int, list[tuple[int, int]]]] = []
    for at, n in ranges:
        if out and at - out[-1][1] <= gap and at + n - out[-1][0] <= most:
            begin, end, members = out[-1]
            out[-1] = (begin, max(end, at + n), members)
            members.append((at, n))
        else:
            out.append((at, at + n, [(at, n)]))
    return out


def read_records(selected: DataFrame, folder: str) -> DataFrame:
    """The records of selected index rows: page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = open_store(folder)
        for batch in batches:
            files: dict[str, list[tuple[int, int]]] = {}
            for name, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files.setdefault(name, []).append((at, n))
            for name, ranges in files.items():
                with store.open_input_file(f"{place}/{name}") as file:
                    for begin, end, members in coalesced(ranges):
                        data = file.read_at(end - begin, begin)
                        rows = []
                        for at, n in members:
                            fields, payload = parse_record(zlib.decompress(data[at - begin : at - begin + n], 31))
                            page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
                            rows.append((page and int(page), fields.get("WARC-Target-URI"), fields["WARC-Type"], payload, int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), refers and int(refers)))
                        kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
                        names = ("page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to")
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    ranges = selected.select("file", "offset", "length")
    files = max(1, ranges.select("file").distinct().count())
    dealt = ranges.repartitionByRange(files, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, archived and read back."""
    folder = new_folder(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((
    ((instr('0123456789abcdef', substr(h, CAST(i * 5 // 4 + 1 AS INTEGER), 1)) - 1) * 16
      + instr('0123456789abcdef', substr(h, CAST(i * 5 // 4 + 2 AS INTEGER), 1)) - 1)
    >> CAST(3 - (i * 5) % 4 AS BIGINT)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
"""
