"""Mixing sources to target weights with fixed-length blocks.

The words of a source, its documents in order of doc_id, form one stream that is cut into blocks of
BLOCK words (the last may be shorter). Output shards have a fixed number of slots. How many of them a
source fills is drawn from multinomials: over all shards together the counts are the targets; a run
of shards is halved, the left half draws its slots from the sources' slots of the whole run, none
more than it has, and the right half keeps the rest, down to single shards. So the draws add up to
the targets exactly, and every task finds the counts of its own shards. A source's n-th slot
takes the block that a keyed pseudorandom permutation of its block numbers (a Feistel network) maps n
to; each pass over the source has a permutation of its own, so no block comes a fourth time before
all have come three times. The last slot of a source is shortened to end on the target. Slots and
documents' pieces are joined by (source, block).

Targets: sources in order of code point, nulls last, weigh 1, 2, 3, repeating, and share all words by
weight; a target stops at CAP times the source's words, and what is over is shared again by weight
among the others until none is above.

Word counts and places come from a range partitioning of the narrow columns and one small row per
range and source; no source is gathered anywhere, whatever its share of the rows. The driver and each
drawing task hold one row per source, the recipe: some hundred bytes each.

Defined results: null and empty texts have size 0 and are taken 0 times; a null source is a source of
its own, as is the empty one; rows that repeat a doc_id are documents of their own, ordered by a hash
of their text and then of their other columns; an empty table gives no row; other columns are ignored
(or passed on by mixed_documents, each row's own).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkquill.llm.common import table, text_chunks, written

WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)
BLOCK = 256
#: Slots of an output shard; shards that a task draws.
SHARD_SLOTS = 4096
SHARDS_A_TASK = 8
#: The table of sources is broadcast up to so many of them.
BROADCAST_SOURCES = 100_000
SLOTS_AT_ONCE = 1 << 20
CAP = 3
WEIGHTS = (1, 2, 3)
SEED = 20240101

_MASK = (1 << 64) - 1


def targets(sizes: list[int], weights: list[int], cap: float = CAP) -> list[float]:
    """Shares of sum(sizes) by weight, none above cap times its size: the excess is shared again by weight."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n]
    left = total
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def _round(x, key: int, turn: int):
    """A round function of the Feistel network, on int or uint64 array."""
    if isinstance(x, int):
        x = ((x + key + turn * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9) & _MASK
        return ((x ^ (x >> 29)) * 0x94D049BB133111EB & _MASK) >> 32
    x = (x + np.array([(key + turn * 0x9E3779B97F4A7C15) & _MASK], np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(32)


class Permutation:
    """A keyed permutation of range(n): a balanced Feistel network on the next even power of two, walked until inside."""

    TURNS = 6

    def __init__(self, n: int, key: int):
        self.n, self.key = n, key & _MASK
        self.half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
        self.low = (1 << self.half) - 1

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out, todo = x.astype(np.uint64), np.arange(len(x))
        half, low = np.uint64(self.half), np.uint64(self.low)
        while len(todo):
            left, right = out[todo] >> half, out[todo] & low
            for t in range(self.TURNS):
                left, right = right, left ^ (_round(right, self.key, t) & low)
            out[todo] = left << half | right
            todo = todo[out[todo] >= self.n]
        return out.astype(np.int64)

    def inverse(self, y: int) -> int:
        while True:
            left, right = y >> self.half, y & self.low
            for t in range(self.TURNS - 1, -1, -1):
                left, right = right ^ (_round(left, self.key, t) & self.low), left
            y = left << self.half | right
            if y < self.n:
                return y


def _key(rank: int, turn: int, seed: int) -> int:
    return _round((rank << 20) + turn, seed, 99) << 32 | _round((rank << 20) + turn, seed, 98)


@dataclass
class Source:
    rank: int
    size: int
    target: float
    slots: int = 0
    last_words: int = 0  # of the last slot

    def plan(self, block: int, seed: int) -> None:
        """How many slots end on the rounded target, and what the last one takes."""
        goal, n = round(self.target), -(-self.size // block)
        passes, rest = divmod(goal, self.size) if self.size else (0, 0)
        self.slots, self.last_words = passes * n, 0
        if not rest:
            if passes:
                last = int(Permutation(n, _key(self.rank, passes - 1, seed))(np.array([n - 1]))[0])
                self.last_words = min(block, self.size - last * block)
            return
        short = Permutation(n, _key(self.rank, passes, seed)).inverse(n - 1)  # the slot of the last, perhaps shorter, block
        lacking = n * block - self.size
        m = -(-rest // block)
        if short < m and m * block - lacking < rest:
            m += 1
        before = (m - 1) * block - (lacking if short < m - 1 else 0)
        self.slots += m
        self.last_words = rest - before


def draw(counts: np.ndarray, shard_slots: int, seed: int, begin: int, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first slot of every source, slots of every source) of the shards from begin to end; counts: each source's slots."""
    runs = [(0, -(-int(counts.sum()) // shard_slots), np.zeros(len(counts), np.int64), counts.astype(np.int64))]
    while runs:
        low, high, done, left = runs.pop()
        if low >= min(high, end) or high <= begin:
            continue
        if high - low == 1:
            yield low, done, left
            continue
        half = (low + high + 1) // 2
        rng, take = np.random.default_rng((seed, low, high)), np.zeros(len(counts), np.int64)
        want = (half - low) * shard_slots  # only the last shard may have fewer
        while (need := want - int(take.sum())) > 0:
            still = left - take
            take += np.minimum(rng.multinomial(need, still / still.sum()), still)
        runs += [(half, high, done + take, left - take), (low, half, done, take)]


@dataclass
class Mix:
    """What mix() computes: tables for the documents' places, slots, and the sources."""

    placed: DataFrame  # doc_id, text_hash, source, rest_hash, rank, size, begin (words before it in its source)
    slots: DataFrame  # shard, rank, turn (pass over the source), block, words
    table: DataFrame  # rank, source_size, target
    block: int
    whole_rows: bool

    def pieces(self) -> DataFrame:
        """A row per taken piece of a document: doc_id, text_hash, begin_in_source, rank, shard, turn, first (word in the document), words."""
        block = self.block
        places = self.placed.where("size > 0").select("doc_id", "text_hash", "rank", "begin", "size", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))).alias("block"))
        start = F.col("block") * block
        taken = places.join(self.slots.hint("merge"), ["rank", "block"])  # the slots grow with the corpus: never broadcast
        first = F.greatest(F.col("begin"), start)
        last = F.least(F.col("begin") + F.col("size"), start + F.col("words"))
        return taken.where(last > first).select("doc_id", "text_hash", F.col("begin").alias("begin_in_source"), "rank", "shard", "turn", (first - F.col("begin")).alias("first"), (last - first).alias("words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED, whole_rows: bool = False) -> Mix:
    """Plans the mix of documents (doc_id, text, source). With whole_rows the other columns order rows that repeat these, and only then are read."""
    spark = docs.sparkSession
    order = ["source", "doc_id", "text_hash", "rest_hash"]
    narrow = written(
        docs.select(*_row_key(docs, whole_rows), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()),
        "sizes",
    )
    # A row per range and source: as many as ranges and sources together.
    sums = narrow.groupBy("source", "part").agg(F.sum("size").alias("words"))
    bases = sums.withColumn("base", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = [(r["source"], r["n"]) for r in sums.groupBy("source").agg(F.sum("words").alias("n")).collect()]
    totals.sort(key=lambda x: (x[0] is None, x[0] or ""))  # Python orders strings by code point
    aims = targets([n for _, n in totals], [weights[i % len(weights)] for i in range(len(totals))], cap)
    sources = [Source(i, n, t) for i, ((_, n), t) in enumerate(zip(totals, aims, strict=True))]
    for s in sources:
        s.plan(block, seed)
    few = F.broadcast if len(sources) <= BROADCAST_SOURCES else (lambda rows: rows)
    ranked = spark.createDataFrame([(i, name, s.size, s.target) for i, ((name, _), s) in enumerate(zip(totals, sources, strict=True))], "rank long, source string, source_size long, target double")
    local = Window.partitionBy("part", "source").orderBy("doc_id", "text_hash", "rest_hash").rowsBetween(Window.unboundedPreceding, -1)
    keyed = bases.join(few(ranked), bases["source"].eqNullSafe(ranked["source"])).select(bases["source"].alias("s"), bases["part"].alias("p"), "rank", "base")
    within = narrow.withColumn("inside", F.coalesce(F.sum("size").over(local), F.lit(0)))
    placed = within.join(keyed, within["source"].eqNullSafe(keyed["s"]) & (within["part"] == keyed["p"])).select("doc_id", "text_hash", "source", "rest_hash", "rank", "size", (F.col("base") + F.col("inside")).alias("begin"))
    return Mix(placed, _slots(spark, sources, block, shard_slots, seed), few(ranked.select("rank", "source_size", "target")), block, whole_rows)


def _row_key(docs: DataFrame, whole_rows: bool) -> list:
    """doc_id, text_hash, source and rest_hash (of the other columns, 0 if they do not matter)."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    other = F.xxhash64(F.to_json(F.struct(*(docs[c].alias(f"c{i}") for i, c in enumerate(rest))))) if whole_rows and rest else F.lit(0).cast("long")
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("source").cast("string").alias("source"), other.alias("rest_hash")]


def _slots(spark: SparkSession, sources: list[Source], block: int, shard_slots: int, seed: int) -> DataFrame:
    """Every slot with the block that its source's permutation maps it to."""
    counts = np.array([s.slots for s in sources], np.int64)
    recipe = spark.sparkContext.broadcast((counts, [(s.rank, s.size, s.last_words) for s in sources]))  # a row per source
    shards = -(-int(counts.sum()) // shard_slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, of = recipe.value
        for batch in batches:
            for task in batch.column(0).to_pylist():
                for shard, firsts, takes in draw(counts, shard_slots, seed, task * SHARDS_A_TASK, (task + 1) * SHARDS_A_TASK):
                    for i in np.flatnonzero(takes):
                        rank, size, last_words = of[i]
                        first, n, blocks = int(firsts[i]), int(takes[i]), -(-size // block)
                        for begin in range(first, first + n, SLOTS_AT_ONCE):
                            slot = np.arange(begin, min(begin + SLOTS_AT_ONCE, first + n), dtype=np.int64)
                            turn, place = slot // blocks, slot % blocks
                            taken = np.empty(len(slot), np.int64)
                            for t in np.unique(turn):
                                taken[turn == t] = Permutation(blocks, _key(rank, int(t), seed))(place[turn == t])
                            words = np.minimum(block, size - taken * block)
                            words[slot == counts[i] - 1] = last_words
                            yield pa.RecordBatch.from_pydict({"shard": np.full(len(slot), shard), "rank": np.full(len(slot), rank), "turn": turn, "block": taken, "words": words})

    tasks = -(-shards // SHARDS_A_TASK)
    return spark.range(0, tasks, 1, max(1, min(tasks, 4096))).mapInArrow(run, "shard long, rank long, turn long, block long, words long")


def taken(mixed: Mix) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken."""
    words = mixed.pieces().groupBy("rank", F.col("begin_in_source").alias("begin")).agg(F.sum("words").alias("taken"))
    some = mixed.placed.where("size > 0").select("doc_id", "size", "rank", "begin").join(words, ["rank", "begin"], "left").select("doc_id", "size", "rank", F.coalesce("taken", F.lit(0)).alias("taken"))
    none = mixed.placed.where("size = 0").select("doc_id", "size", "rank", F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none).join(mixed.table, "rank").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, mixed: Mix) -> DataFrame:
    """The mix as documents, all columns as they were but text (and n_chars): a row per document and pass over its source that takes of it.

    A document that a pass takes wholly keeps its text; of others the taken ranges of words remain,
    line by line. mixed comes from mix(docs, whole_rows=True): rows that differ in any column have
    their own places, and rows that are equal in all are interchangeable.
    """
    if not mixed.whole_rows:
        raise ValueError("the mix was not planned with whole_rows=True")
    names, spans = docs.columns, "taken_spans"
    while spans in names:
        spans += "_"
    key = ["doc_id", "text_hash", "source", "rest_hash"]
    rows = docs.select(F.struct(*_row_key(docs, True)).alias("row_key"), F.struct("*").alias("row"))
    placed = mixed.placed.where("size > 0")
    if not placed.groupBy(*key).count().where("count > 1").isEmpty():
        rows = rows.groupBy("row_key").agg(F.any_value("row").alias("row"))  # one for all equal rows, else each would take what all are due
    named = placed.select("rank", "begin", "size", F.struct(*key).alias("row_key"))
    parts = mixed.pieces().groupBy("rank", F.col("begin_in_source").alias("begin"), "turn").agg(F.sum("words").alias("total"), F.array_sort(F.collect_list(F.struct("first", "words"))).alias(spans))
    whole = F.when(F.col("total") == F.col("size"), F.lit(None)).otherwise(F.col(spans)).alias(spans)
    wanted = named.join(parts, ["rank", "begin"]).select("row_key", whole)
    text, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def cut(x: str, ranges: list[dict]) -> str:
        places, out, end = [m.span() for m in _WORD.finditer(x)], [], -1
        for r in ranges:
            if r["first"] == end:
                out[-1] = (out[-1][0], places[r["first"] + r["words"] - 1][1])
            else:
                out.append((places[r["first"]][0], places[r["first"] + r["words"] - 1][1]))
            end = r["first"] + r["words"]
        return "\n".join(x[a:b] for a, b in out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, texts in text_chunks(batches, "text"):
            columns = list(chunk.columns)
            ranges = columns.pop().to_pylist()
            new = [cut(x, r) if r is not None else x for x, r in zip(texts, ranges, strict=True)]
            columns[text] = pa.array(new, columns[text].type)
            if chars is not None:
                columns[chars] = pa.array(map(len, new), pa.int64()).cast(columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.join(wanted, "row_key").select("row.*", spans).mapInArrow(run, docs.schema)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, as words taken of each."""
    return taken(mix(table(spark, sf_dir, "documents")))
