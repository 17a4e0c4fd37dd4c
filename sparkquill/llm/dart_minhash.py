"""MinHash near-deduplication with DartMinHash signatures.

Elements are the distinct five-word shingles of a text (a shorter text is one shingle). An element of
weight w owns the strip [0, w) of an endless plane; darts fall on the plane at a rate of K per unit of
weight and rank, each with a coordinate of K, all derived by hashing from the element and the unit
cell of its strip. A text keeps, per coordinate, the earliest dart (least rank) inside its strips. It
throws darts only up to the rank at which all coordinates are most likely filled, ln K + 3 over its
total weight, and doubles that where one is empty: so the work is the elements plus K ln K darts.
Two texts agree in a coordinate with a probability of their weighted Jaccard similarity.

BANDS bands of ROWS coordinates give buckets. Texts with the same elements are one class beforehand.
First every class of a bucket is compared with one of them, the hub, and the links join classes into
components. A bucket of three or more that then still has several components is compared whole: its
members are cut into tiles of TILE, each pair of tiles is a group, and the sizes of all intersections
in a group come from one product of its incidence matrix. A group reports an edge per member at most,
never pairs. So every pair of a bucket is joined by links or compared exactly, and no candidate is
dropped; a similar pair is missed only if no band agrees, at similarity 0.8 one of 20 000.

A class's node begins with its first row (doc_id, hash of the text), ordered as these are: the root
of a component names the row that stays, and nothing is gathered by component.

Defined results: null texts and texts without words link with nothing and are kept; rows with a null
doc_id take part, and a group's component_id is its smallest doc_id that is not null; rows that
repeat a doc_id are each reported; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.llm.common import table, text_chunks, written
from sparkquill.llm.fm_decontaminate import words_of
from sparkquill.llm.graph_components import components, long_of, ordered_bytes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
K = BANDS * ROWS
#: Members of a bucket in a tile; columns of the incidence matrix at once.
TILE = 300
COLUMNS = 4096
BROADCAST_ROWS = 100_000
CHUNK = 4 << 20
CHUNK_ROWS = 4096

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit affects every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count) of every distinct shingle, ordered by text and hash.

    At most CHUNK_ROWS texts: the number takes the upper bits of the sorted key, the hash 52 bits.
    """
    words = [words_of(x) for x in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    numbers = mix(np.fromiter(map(zlib.crc32, chain.from_iterable(words)), np.uint64, int(sizes.sum())) + _STEP)
    of_text = np.where(sizes == 0, 0, np.maximum(sizes - size + 1, 1))
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    first = np.concatenate([[0], np.cumsum(of_text)])
    owner = np.repeat(np.arange(len(texts)), of_text)
    at = np.arange(first[-1]) - np.repeat(first[:-1] - begin, of_text)
    padded = np.concatenate([numbers, np.zeros(size, np.uint64)])
    h = np.zeros(len(at), np.uint64)
    for j in range(size):
        h = h * _STEP + np.where(j < sizes[owner], padded[at + j], np.uint64(0))
    key = np.sort((owner.astype(np.uint64) << np.uint64(52)) | (mix(h) >> np.uint64(12)))
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    places = np.flatnonzero(new)
    count = np.diff(np.append(places, len(key)))
    return (key[places] >> np.uint64(52)).astype(np.int64), key[places] & np.uint64((1 << 52) - 1), count


def darts(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, k: int = K) -> np.ndarray:
    """The signatures, (texts, k) of uint32; rows of texts without elements are 0."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(texts * k, empty)
    cells = np.ceil(weight).astype(np.int64)
    total = np.bincount(owner, weight, texts)
    who = np.repeat(owner, cells)
    cell = np.arange(len(who)) - np.repeat(np.cumsum(cells) - cells, cells)
    seed = mix(np.repeat(element, cells) + cell.astype(np.uint64) * _STEP)
    share = np.minimum(np.repeat(weight, cells) - cell, 1.0)
    limit = np.divide(np.log(k) + 3, total, out=np.zeros(texts), where=total > 0)
    todo = total > 0
    while todo.any():
        live = np.flatnonzero(todo[who])
        rank, throw = np.zeros(len(live)), 0
        while len(live):
            throw += 1
            h = mix(seed[live] + np.array([throw], np.uint64) * _M1)
            rank = rank - np.log(((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / k
            near = rank <= limit[who[live]]
            live, rank, h = live[near], rank[near], mix(h[near] + _STEP)
            inside = (h >> np.uint64(40)).astype(np.float64) * 2.0**-24 < share[live]
            coordinate = (h & np.uint64(0xFFFFFFFF)) % np.uint64(k)
            value = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (mix(h) >> np.uint64(32))
            np.minimum.at(best, (who[live] * k + coordinate.astype(np.int64))[inside], value[inside])
        todo = todo & (best.reshape(texts, k) == empty).any(axis=1)
        limit[todo] *= 2
    best[best == empty] = 0
    return (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(texts, k)


def bands_of(signatures: np.ndarray) -> np.ndarray:
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signatures), BANDS)) * _M2
    for j in range(ROWS):
        h = mix(h * _STEP + signatures[:, j::ROWS])
    return h.view(np.int64)


def _weights(counts: np.ndarray, weights: str) -> np.ndarray:
    if weights not in ("set", "count"):
        raise ValueError(f"weights is set or count, not {weights}")
    return np.ones(len(counts)) if weights == "set" else counts.astype(np.float64)


def _cells(owner: np.ndarray, element: np.ndarray, counts: np.ndarray, weights: str) -> tuple[np.ndarray, np.ndarray]:
    """Elements as a set: with counts as weights, each of an element's unit cells is one."""
    if weights == "set":
        return owner, element
    cell = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(owner, counts), np.where(cell > 0, mix(np.repeat(element, counts) + cell.astype(np.uint64) * _STEP) >> np.uint64(12), np.repeat(element, counts))


def _pieces(batches, *, rows: int = CHUNK_ROWS):
    for chunk, texts in text_chunks(batches, "text", CHUNK):
        for k in range(0, len(texts), rows):
            yield chunk.slice(k, rows), texts[k : k + rows]


def _sets(texts: list[str | None], weights: str) -> tuple[tuple, list[np.ndarray], list[bytes | None]]:
    """Shingles, and of each text its set in ascending order and the set's key (None without words)."""
    found = shingles(texts)
    owner, cell = _cells(*found, weights)
    order = np.lexsort((cell, owner)) if weights == "count" else slice(None)
    parts = np.split(cell[order], np.searchsorted(owner[order], np.arange(1, len(texts))))
    return found, parts, [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in parts]


def signatures(docs: DataFrame, weights: str = "count") -> DataFrame:
    """Per document, without a shuffle: doc_id, text_hash, key (of its element set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, texts in _pieces(batches):
            (owner, element, counts), _, keys = _sets(texts, weights)
            got = darts(owner, mix(element + _M1), _weights(counts, weights), len(texts))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(bands_of(got).ravel()))
            yield pa.RecordBatch.from_arrays([chunk.column(0), chunk.column(1), pa.array(keys, pa.binary()), bands], names=["doc_id", "text_hash", "key", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, key binary, bands array<long>")


def _element_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, weights: str) -> DataFrame:
    """node and elements (sorted uint64, as bytes) of the classes in nodes, from the text of each one's first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, texts in _pieces(batches):
            _, parts, _ = _sets(texts, weights)
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array([x.tobytes() for x in parts], pa.binary())], names=["node", "elements"])

    wanted = classes.join(nodes, "node", "left_semi").select("node", F.col("first.doc_id").alias("d"), F.col("first.text_hash").alias("h"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    # A repeated row gives its class twice here, and then an edge twice; edges are made distinct.
    return rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["d"]) & (rows["text_hash"] == wanted["h"])).select("node", "text").mapInArrow(run, "node binary, elements binary")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the wanted one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i) for i in (2, 3))
            good = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (a, b))
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    good.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                good.append(shared >= similarity * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("of_b")), "b")
    with_both = with_b.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("of_a")), "a")
    return with_both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a binary, b binary")


def _tile_edges(elements: list[np.ndarray], left: np.ndarray, inside: bool, similarity: float) -> np.ndarray:
    """For each member of a group the smallest member that it is linked with, directly or over others."""
    m = len(elements)
    sizes = np.fromiter(map(len, elements), np.int64, m)
    owner = np.repeat(np.arange(m), sizes)
    _, column, count = np.unique(np.concatenate(elements), return_inverse=True, return_counts=True)
    shared = count[column] > 1  # an element of one member is in no intersection
    column, owner = (np.cumsum(count > 1) - 1)[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((m, m), np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (begin, begin + COLUMNS))
        part = np.zeros((m, COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - begin] = 1
        both += part @ part.T
    linked = both >= similarity * (sizes[:, None] + sizes[None] - both)
    if not inside:
        linked &= left[:, None] != left[None]
    np.fill_diagonal(linked, True)
    root = np.arange(m)
    while True:
        least = np.where(linked, root[None], m).min(axis=1)
        least = np.minimum(least, root)[least]
        if (least == root).all():
            return root
        root = least


def _tiled(apart: DataFrame, sizes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that join what is similar within each bucket of apart (bucket, node, root); sizes: bucket, n."""
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = apart.join(sizes, "bucket").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("bucket", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "tile", "node", "root")
    rows = dealt.join(sets, "node").select("bucket", "p", "q", "tile", "node", "root", "elements")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if len({x[2] for x in held}) < 2:  # one component already
                return
            held.sort(key=lambda x: x[1])
            root = _tile_edges([np.frombuffer(x[3], np.uint64) for x in held], np.array([x[0] == group[1] for x in held]), group[1] == group[2], similarity)
            some = np.flatnonzero(root != np.arange(len(held)))
            if len(some):
                yield pa.RecordBatch.from_pydict({"a": pa.array([held[root[i]][1] for i in some], pa.binary()), "b": pa.array([held[i][1] for i in some], pa.binary())})

        for batch in batches:
            for bucket, p, q, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, p, q) != group:
                    yield from done()
                    group, held = (bucket, p, q), []
                held.append(rest)
        yield from done()

    return rows.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q").mapInArrow(run, "a binary, b binary")


def _small(held: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has at most BROADCAST_ROWS rows (of a few dozen bytes)."""
    return F.broadcast(held) if held.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else held


def _node(first: str, key: str):
    """First row and key of a class as bytes, ordered by whether a doc_id is there, doc_id and hash of the text."""
    doc = F.coalesce(F.col(f"{first}.doc_id"), F.lit(0).cast("long"))
    return F.concat(F.unhex(F.when(F.col(f"{first}.none"), "01").otherwise("00")), ordered_bytes(doc), ordered_bytes(F.col(f"{first}.text_hash")), F.col(key))


def _first(node: str):
    """The row (doc_id, text_hash) that a node names."""
    doc = F.when(F.hex(F.substring(node, 1, 1)) == "00", long_of(F.substring(node, 2, 8)))
    return F.struct(doc.alias("doc_id"), long_of(F.substring(node, 10, 8)).alias("text_hash"))


def near_duplicates(docs: DataFrame, weights: str = "count", similarity: float = SIMILARITY) -> DataFrame:
    """A row per document: doc_id, text_hash, has_words, class_id, component_id (smallest doc_id of its group), first (the row of the group that stays: doc_id, text_hash).

    weights: "count" weighs a shingle with its occurrences, "set" with 1.
    """
    signed = written(signatures(docs, weights), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    classes = signed.where("key is not null").groupBy("key").agg(first, F.any_value("bands").alias("bands"))
    classes = written(classes.withColumn("node", _node("first", "key")), "classes")
    members = classes.select(F.explode("bands").alias("bucket"), "node")
    shared = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node").alias("order"), "node"))["node"].alias("hub")).where("n > 1").select("bucket", "hub")
    crowded = written(members.join(shared, "bucket"), "buckets")
    sets = written(_element_sets(docs, classes, crowded.select("node").distinct(), weights), "elements")
    pairs = crowded.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    roots = written(components(_verified(pairs, sets, similarity)), "roots")

    # A bucket of two is done by now.
    rooted = crowded.select("bucket", "node").join(_small(roots), "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where("n > 2 and least <> most").select("bucket", "n")
    mixed = written(mixed, "mixed")
    if not mixed.isEmpty():
        sizes = _small(mixed)
        more = _tiled(rooted, sizes, sets, similarity)
        roots = written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "roots")

    by_key = classes.select("key", "node").join(_small(roots), "node", "left").select("key", _first_of_root())
    joined = signed.select("doc_id", "text_hash", "key").join(by_key, "key", "left")
    groups = joined.select("doc_id", "text_hash", "key", F.coalesce("first", F.struct("doc_id", "text_hash")).alias("first"))
    return groups.select("doc_id", "text_hash", F.col("key").isNotNull().alias("has_words"), F.hex("key").alias("class_id"), F.col("first.doc_id").alias("component_id"), "first")


def _first_of_root():
    return F.struct(*(F.coalesce(_first("root")[c], _first("node")[c]).alias(c) for c in ("doc_id", "text_hash"))).alias("first")


def deduplicated(docs: DataFrame, weights: str = "count", similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all columns as they were, one of each group: that with the smallest doc_id.

    Of rows that repeat doc_id and text the one with the smallest hash of the whole row stays. Rows without words all stay.
    """
    groups = written(near_duplicates(docs, weights, similarity), "groups")
    stays = groups.where(F.col("has_words") & F.struct("doc_id", "text_hash").eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    repeated = not stays.groupBy("d", "h").count().where("count > 1").isEmpty()
    wordless = groups.where(~F.col("has_words")).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    same = lambda other: rows["doc_id"].eqNullSafe(other["d"]) & (rows["text_hash"] == other["h"])
    if not repeated:
        kept = stays.unionByName(wordless.distinct())
        return rows.join(kept, same(kept)).select("row.*")
    stays, wordless = stays.distinct(), wordless.distinct()
    once = rows.join(stays, same(stays)).groupBy("doc_id", "text_hash").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return once.select("row.*").unionByName(rows.join(wordless, same(wordless)).select("row.*"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group; kept is true for the one that stays."""
    groups = near_duplicates(table(spark, sf_dir, "documents"))
    kept = ~F.col("has_words") | F.struct("doc_id", "text_hash").eqNullSafe(F.col("first"))
    return groups.select("doc_id", "class_id", "component_id", kept.alias("kept"))


def brute_force(texts: list[str | None], weights: str = "count", similarity: float = SIMILARITY) -> list[int]:
    """For each text the number of its group's first text, by comparing all pairs (for tests)."""
    from collections import Counter

    bags = []
    for x in texts:
        w = words_of(x)
        bags.append(Counter(tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))) if w else Counter())
    group = list(range(len(texts)))

    def root(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            if a and b:
                if weights == "set":
                    shared, total = len(a.keys() & b.keys()), len(a.keys() | b.keys())
                else:
                    shared, total = (a & b).total(), (a | b).total()
                if shared >= similarity * total and root(i) != root(j):
                    x, y = sorted((root(i), root(j)))
                    group[y] = x
    return [root(i) for i in range(len(texts))]
