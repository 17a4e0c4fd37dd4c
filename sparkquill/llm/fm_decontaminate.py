"""Benchmark decontamination with an FM-index per training shard.

A shard is some megabytes of documents. Its words become numbers, a suffix array gives the
Burrows-Wheeler transform, a wavelet matrix answers rank queries on it, backward search finds the
row range of every benchmark window, and sampled suffix positions turn rows into word positions.
The positions become merged removal spans.

Words that no benchmark item contains cannot lie inside an occurrence, so they act as the ends of
indexed runs, and runs shorter than the shortest window are left out: the index stays exact and
holds only what can match. Windows never cross documents.

The benchmark is compiled in blocks of bounded size, files in the shared folder. A shard's words are
numbered by its own vocabulary and indexed once; the blocks are read one after the other, first for
the words that they contain, then for their windows. A worker holds one block at a time, so its memory
does not grow with the benchmark.

Defined results: a null or empty text has no words and is never contaminated; null item texts have
no windows; a null item_id counts as the id "" ; items that repeat an item_id count once; documents
that repeat a doc_id are each reported. Other columns of the documents are ignored (report) or
passed on (filter, cut), whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.llm.common import kept_in_worker, new_folder, open_store, table, text_chunks

WINDOW = 10
SAMPLE_EVERY = 8
#: Text of a shard.
SHARD_BYTES = 8 << 20
#: Benchmark text that is compiled at once; a larger benchmark goes in several blocks.
BLOCK_BYTES = 8 << 20

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
_AZ = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[bytes]:
    """The text's words: A-Z lower-cased, split at every ASCII character that is no letter or digit."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def word_places(text: str) -> list[tuple[int, int]]:
    """Character ranges of the words, in order."""
    return [m.span() for m in _WORD.finditer(text.translate(_AZ))]


class Bits:
    """Bit vector with rank: 64-bit words and running counts."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w, low = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    """Rank and access over a sequence of numbers, a bit vector per binary digit."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = []
        for b in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            one = (seq >> b & 1).astype(bool)
            bits = Bits(one)
            self.levels.append((b, bits, len(seq) - bits.ones))
            seq = np.concatenate([seq[~one], seq[one]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        begin = np.zeros_like(at)
        for b, bits, zeros in self.levels:
            one = symbol >> b & 1 != 0
            r, s = bits.rank(at), bits.rank(begin)
            at, begin = np.where(one, zeros + r, at - r), np.where(one, zeros + s, begin - s)
        return at - begin

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before."""
        symbol, begin = np.zeros_like(at), np.zeros_like(at)
        for b, bits, zeros in self.levels:
            one = bits.get(at)
            r, s = bits.rank(at), bits.rank(begin)
            at, begin = np.where(one, zeros + r, at - r), np.where(one, zeros + s, begin - s)
            symbol |= one.astype(symbol.dtype) << b
        return symbol, at - begin


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffixes in order, each up to its next 0; equal ones by place (prefix doubling)."""
    n = len(seq)
    rank, h = seq.astype(np.int64), 1
    ends = np.append(np.flatnonzero(seq == 0), n)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols before the next 0
    width = int(rank.max(initial=0)) + 1
    while True:
        longer = np.zeros(n, np.int64)
        longer[: n - h] = rank[h:]
        key = rank * width + np.where(left > h, longer, 0)
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        h *= 2
        if sorted_key[0] >= width:  # there is no separator, so rank 0 must stay free
            new += 1
        if h >= n or np.array_equal(new, rank):
            return order
        rank, width = new, int(new.max()) + 1


class FMIndex:
    """Counts and locates patterns in runs of positive numbers that zeros separate."""

    def __init__(self, seq: np.ndarray, sigma: int, every: int = SAMPLE_EVERY):
        order = suffix_array(seq)
        self.n = len(seq)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        self.bwt = WaveletMatrix(seq[order - 1].astype(np.int64), sigma)
        run_begin = np.concatenate([[True], seq[:-1] == 0])
        sampled = (run_begin | (np.arange(self.n) % every == 0))[order]
        self.marked, self.samples = Bits(sampled), order[sampled]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of the pattern matrix, the range of suffixes that begin with it."""
        low, high = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        alive = np.arange(len(patterns))
        lo, hi = low.copy(), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, k]
            lo, hi = self.first[symbol] + self.bwt.rank(symbol, lo), self.first[symbol] + self.bwt.rank(symbol, hi)
            some = hi > lo
            alive, lo, hi = alive[some], lo[some], hi[some]
        low[alive], high[alive] = lo, hi
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text place of each suffix, by stepping back to a sampled one."""
        place, left, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(left):
            hit = self.marked.get(at)
            place[left[hit]] = self.samples[self.marked.rank(at[hit])] + steps
            left, at, steps = left[~hit], at[~hit], steps + 1
            symbol, before = self.bwt.access(at)
            at = self.first[symbol] + before
        return place


class Windows:
    """A block of benchmark items, compiled: vocabulary, distinct windows by length, and their items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[str] = []
        seen: dict[tuple[int, ...], list[int]] = {}
        for item, words in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for i in range(max(1, len(numbers) - window + 1) if numbers else 0):
                seen.setdefault(tuple(numbers[i : i + window]), []).append(len(self.ids))
            self.ids.append(item)
        self.by_length: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for n in sorted({len(k) for k in seen}):
            keys = [k for k in seen if len(k) == n]
            self.by_length[n] = np.array(keys, np.int64).reshape(len(keys), n), [seen[k] for k in keys]
        self.shortest = min(self.by_length, default=0)

    def patterns(self, numbers: dict[bytes, int]) -> Iterator[tuple[np.ndarray, list[list[int]]]]:
        """The windows in another numbering of words, by length, with their items; those with a word that it lacks are left out."""
        to = np.zeros(len(self.vocabulary) + 1, np.int64)
        for word, own in self.vocabulary.items():
            to[own] = numbers.get(word, 0)
        for windows, items in self.by_length.values():
            there = to[windows]
            some = np.flatnonzero((there > 0).all(axis=1))
            if len(some):
                yield there[some], [items[i] for i in some]


class ShardIndex:
    """An FM-index over the runs of benchmark words in a shard."""

    def __init__(self, numbers: np.ndarray, starts: np.ndarray, sigma: int, shortest: int):
        """numbers: 0 for words that no item has; starts: where documents begin; sigma: numbers used; shortest: words of the shortest window."""
        self.index = None
        if not len(numbers) or not shortest:
            return
        cut = np.zeros(len(numbers) + 1, bool)
        cut[starts[starts < len(numbers)]] = True
        inside = numbers > 0
        begins = np.flatnonzero(inside & (cut[:-1] | np.concatenate([[True], ~inside[:-1]])))
        ends = np.flatnonzero(inside & (cut[1:] | np.concatenate([~inside[1:], [True]]))) + 1
        long = ends - begins >= shortest
        begins, sizes = begins[long], (ends - begins)[long]
        if not len(begins):
            return
        # Each run and a 0 after it; origin: the word that each symbol is.
        offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.origin = np.arange(offsets[-1]) + np.repeat(begins - offsets[:-1], sizes + 1)
        seq = np.concatenate([numbers, [0]])[self.origin]
        seq[offsets[1:] - 1] = 0
        self.index = FMIndex(seq, sigma)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence."""
        low, high = self.index.ranges(patterns)
        found = np.flatnonzero(high > low)
        counts = (high - low)[found]
        if not len(found):
            return counts, found
        rows = np.repeat(low[found] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        return self.origin[self.index.locate(rows)], np.repeat(found, counts)


def compile_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Windows]:
    """The benchmark (item_id, text) in blocks of bounded size; the driver holds one at a time."""
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text")).where("text is not null")
    for item, text in rows.toLocalIterator():
        held.append((item or "", words_of(text)))
        size += len(text)
        if size >= block_bytes:
            yield Windows(held, window)
            held, size = [], 0
    if held:
        yield Windows(held, window)


class Finder:
    """Finds hit words and items in lists of texts, from compiled blocks in the shared folder."""

    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names

    def block(self, name: str) -> Windows:
        def read() -> Windows:
            store, place = open_store(self.folder)
            with store.open_input_stream(f"{place}/{name}") as file:
                return pickle.loads(file.read())

        return kept_in_worker(("windows", self.folder, name), read)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
        """Words, merged hit spans (in words) and item ids of each text."""
        words = [words_of(x) for x in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        edge = np.zeros(starts[-1] + 1, np.int32)
        items: list[set[str]] = [set() for _ in texts]
        own: dict[bytes, int] = {}  # the shard's words that some item has, numbered from 1
        shortest = 0
        distinct = set(chain.from_iterable(words)) if self.names else set()
        for name in self.names:
            block = self.block(name)
            shortest = min(shortest or block.shortest, block.shortest or shortest)
            for w in distinct & block.vocabulary.keys():
                own.setdefault(w, len(own) + 1)
        if own:
            get = own.get
            index = ShardIndex(np.fromiter((get(w, 0) for one in words for w in one), np.int64, starts[-1]), starts, len(own) + 1, shortest)
            for name in self.names if index.index else ():
                block = self.block(name)
                for patterns, owners in block.patterns(own):
                    n = patterns.shape[1]
                    for place, pattern in zip(*(x.tolist() for x in index.search(patterns)), strict=True):
                        edge[place] += 1
                        edge[place + n] -= 1
                        items[np.searchsorted(starts, place, "right") - 1].update(block.ids[i] for i in owners[pattern])
        hit = np.cumsum(edge[:-1]) > 0
        spans: list[list[tuple[int, int]]] = []
        for i, owners in enumerate(items):
            inside = np.diff(np.concatenate([[0], hit[starts[i] : starts[i + 1]].astype(np.int8), [0]])) if owners else np.zeros(0)
            spans.append(list(zip(np.flatnonzero(inside == 1).tolist(), np.flatnonzero(inside == -1).tolist(), strict=True)))
        return sizes, spans, items


def _finder(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> Finder:
    folder, names = new_folder(docs.sparkSession, "windows"), []
    store, place = open_store(folder)
    store.create_dir(place, recursive=True)
    for block in compile_blocks(benchmark, window, block_bytes):
        names.append(f"{len(names):06d}.windows")
        with store.open_output_stream(f"{place}/{names[-1]}") as out:
            out.write(pickle.dumps(block))
    return Finder(folder, names)


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, item_ids, spans (in words, merged), contaminated."""
    find = _finder(docs, benchmark, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, texts in text_chunks(batches, "text", shard_bytes, keeps=True):
            sizes, spans, items = find(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array([sum(b - a for a, b in x) for x in spans], pa.int64()),
                    pa.array(map(len, items), pa.int64()),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    pa.array([[{"begin": a, "end": b} for a, b in x] for x in spans], pa.list_(pa.struct({"begin": pa.int64(), "end": pa.int64()}))),
                    pa.array([bool(x) for x in spans], pa.bool_()),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "item_ids", "spans", "contaminated"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, item_ids array<string>, spans array<struct<begin: long, end: long>>, contaminated boolean")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, mode: str = "drop", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents, all columns as they were, without contaminated ones ("drop") or without the hit words' ranges of text ("cut")."""
    if mode not in ("drop", "cut"):
        raise ValueError(f"mode is drop or cut, not {mode}")
    find = _finder(docs, benchmark, window, block_bytes)

    def cut(text: str, spans: list[tuple[int, int]]) -> str:
        places, kept, last = word_places(text), [], 0
        for a, b in spans:
            kept.append(text[last : places[a][0]])
            last = places[b - 1][1]
        return "\n".join([*kept, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, texts in text_chunks(batches, "text", shard_bytes, keeps=True):
            _, spans, _ = find(texts)
            if mode == "drop":
                yield chunk.filter(pc.invert(pa.array([bool(x) for x in spans], pa.bool_())))
            elif not any(spans):
                yield chunk
            else:
                k = chunk.schema.get_field_index("text")
                clean = pa.array([cut(t, s) if s else t for t, s in zip(texts, spans, strict=True)], chunk.schema.field(k).type)
                yield chunk.set_column(k, chunk.schema.field(k), clean)

    return docs.mapInArrow(run, docs.schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the whole benchmark; the items as a digest."""
    report = contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    joined = F.array_join("item_ids", ",")
    return report.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(joined, 256).alias("items_sha256"), "contaminated")


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """What op1 returns, by comparing every window with every place (for tests)."""
    out = []
    for doc, text in docs:
        words = _WORD.findall((text or "").translate(_AZ))
        hit, owners = set(), set()
        for item, passage in items:
            own = _WORD.findall((passage or "").translate(_AZ))
            for i in range(max(1, len(own) - window + 1) if own else 0):
                part = own[i : i + window]
                for j in range(len(words) - len(part) + 1):
                    if words[j : j + len(part)] == part:
                        hit.update(range(j, j + len(part)))
                        owners.add(str(item))
        out.append((doc, len(words), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit)))
    return out
