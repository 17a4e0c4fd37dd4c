"""Embedding near-deduplication with spherical-cap filters.

Filter directions are a random product code: the rotated space is cut into BLOCKS parts, each part has
a codebook of random unit vectors, and every tuple of code words is a direction. A vector goes to the
CAPTURES filters whose directions are nearest to it, so none is left without; list decoding finds them
without looking at the others, as the best sums of two sorted lists lie under a hyperbola of ranks.
Vectors of one label and filter are compared exactly, in double precision. Labels of every size go
this way.

The number of filters follows from the size of the largest label. Two vectors that share no filter are
missed; the README has the share measured at cosine 0.98.

Vectors of a label that are equal component for component are one class; classes are compared, with
their sizes. A filter of more than TILE members is cut into tiles and every pair of tiles is a group of
its own, so no task holds a whole hot filter. A group reports per class how many vectors it links to
(a pair counts in the smallest filter that both share) and one edge per class to the smallest class of
its linked part, never pairs. A class's node begins with its smallest vec_id, so the root of a
component names the component, and nothing is gathered by component.

Vectors go once through a shuffle, in the width that they have in the table; the hot filters are
counted before, from their numbers alone.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components, and rows with a null label, link with nothing; a null vec_id forms no group of its own;
rows that repeat a vec_id are each reported and link as different vectors; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.llm.common import table, written
from sparkquill.llm.graph_components import components, long_of, ordered_bytes

COSINE = 0.98
CAPTURES = 24
#: Members of a filter that are aimed at, for the label with the most vectors.
MEMBERS = 24
LARGEST_BOOK = 4096
TILE = 1000
SEED = 11


@dataclass
class CapFilters:
    """A product code over dim dimensions with about `wanted` directions."""

    books: list[np.ndarray]
    captures: int

    @classmethod
    def build(cls, dim: int, largest: int, captures: int = CAPTURES, members: int = MEMBERS, seed: int = SEED) -> CapFilters:
        rng = np.random.default_rng(seed)
        share = min(0.25, members / max(1, largest))  # of vectors in a filter
        wanted = max(4, int(captures / share))
        blocks = min(2, dim)
        while wanted ** (1 / blocks) > LARGEST_BOOK and blocks < dim:
            blocks += 1
        size = max(2, round(wanted ** (1 / blocks)))
        rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        cuts = np.array_split(np.arange(dim), blocks)
        books = []
        for cut in cuts:
            words = np.zeros((size, dim))
            part = rng.normal(size=(size, len(cut)))
            words[:, cut] = part / np.linalg.norm(part, axis=1, keepdims=True) / np.sqrt(blocks)
            books.append(words @ rotation)
        return cls(books, captures)

    @property
    def directions(self) -> int:
        return math.prod(map(len, self.books))

    def decode(self, unit: np.ndarray) -> np.ndarray:
        """The filters of every row, ascending: those of the `captures` best directions, or all if there are fewer."""
        total, code = np.zeros((len(unit), 1)), np.zeros((len(unit), 1), np.int64)
        for book in self.books:
            scores, m = unit @ book.T, min(self.captures, len(book))
            word = np.argpartition(-scores, m - 1, axis=1)[:, :m]
            score = np.take_along_axis(scores, word, 1)
            order = np.argsort(-score, axis=1, kind="stable")
            word, score = np.take_along_axis(word, order, 1), np.take_along_axis(score, order, 1)
            # A sum of ranks i and j has (i + 1)(j + 1) - 1 others that are no smaller.
            i, j = np.nonzero(np.outer(np.arange(total.shape[1]) + 1, np.arange(m) + 1) <= self.captures)
            sums, codes = total[:, i] + score[:, j], code[:, i] * len(book) + word[:, j]
            order = np.argsort(-sums, axis=1, kind="stable")[:, : self.captures]
            total, code = np.take_along_axis(sums, order, 1), np.take_along_axis(codes, order, 1)
        return np.sort(code, axis=1)


def _split(vectors: DataFrame, sound: bool) -> DataFrame:
    """vec_id, label and embedding (floats, if the table has floats, or doubles) of the rows that can link, or of the others."""
    width = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{width}>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    return rows.where(good if sound else ~good)


def _classes(good: DataFrame, kind: str) -> DataFrame:
    """key, label, vector (as bytes of `kind`) of every row that can link; equal keys are one class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = np.cumsum(pc.list_value_length(lists).to_numpy()) * np.dtype(kind).itemsize
            data = (lists.flatten().to_numpy(zero_copy_only=False) + 0.0).astype(kind).tobytes()  # -0.0 becomes 0.0
            vectors = [data[a:b] for a, b in pairwise([0, *ends.tolist()])]
            keys = [hashlib.blake2b(label.encode() + b"\0" + v, digest_size=16).digest() for label, v in zip(batch.column(1).to_pylist(), vectors, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "label", "key", "vector"])

    return good.mapInArrow(run, "vec_id long, label string, key binary, vector binary")


def _unit(vectors: pa.Array, dim: int, kind: str) -> np.ndarray:
    """The vectors at length 1, in double precision; scaled first, so that no square is too large or too small."""
    x = np.frombuffer(b"".join(vectors.to_pylist()), kind).reshape(-1, dim).astype("<f8")
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _captured(classes: DataFrame, code: CapFilters, dim: int, kind: str) -> DataFrame:
    """A row per class of the usual length: label, node, vector, n, filters (ascending)."""
    shared = classes.sparkSession.sparkContext.broadcast(code)
    number, arrow = ("int", pa.int32()) if code.directions < 2**31 else ("long", pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                filters = shared.value.decode(_unit(part.column(2), dim, kind))
                begins = pa.array(np.arange(len(filters) + 1) * filters.shape[1], pa.int32())
                lists = pa.ListArray.from_arrays(begins, pa.array(filters.ravel(), arrow))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=["label", "node", "vector", "n", "filters"])

    usual = classes.where(F.octet_length("vector") == np.dtype(kind).itemsize * dim).select("label", "node", "vector", "n")
    return usual.mapInArrow(run, f"label string, node binary, vector binary, n long, filters array<{number}>")


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Of sorted batches: batches of whole groups, which agree in the first `keys` columns, and the groups' ends."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        n, new = batch.num_rows, np.zeros(batch.num_rows - 1, bool)
        for c in batch.columns[:keys]:
            new |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        ends = (np.flatnonzero(new) + 1).tolist()
        last = ends[-1] if ends else 0
        if last:
            yield batch.slice(0, last), [0, *ends]
        rest = batch.slice(last)
    if rest is not None:
        yield rest, [0, rest.num_rows]


def _compare(unit: np.ndarray, left: np.ndarray | None, n: np.ndarray, filters: np.ndarray, own: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that a group adds to each member (a pair counts if `own` is its smallest shared filter), and each member's root.

    left marks the first of two tiles, whose pairs are compared; None stands for a tile with itself.
    """
    if left is None:
        a, b = np.nonzero(np.triu(unit @ unit.T >= cosine, 1))
    else:
        i, j = np.flatnonzero(left), np.flatnonzero(~left)
        a, b = np.nonzero(unit[i] @ unit[j].T >= cosine)
        a, b = i[a], j[b]
    links, root = np.zeros(len(n), np.int64), np.arange(len(n))
    if not len(a):
        return links, root
    for s in range(0, len(a), 20_000):
        x, y = a[s : s + 20_000], b[s : s + 20_000]
        mine, unsure = np.ones(len(x), bool), np.arange(len(x))
        for k in range(filters.shape[1]):
            lower = filters[x[unsure], k]
            unsure, lower = unsure[lower < own], lower[lower < own]
            if not len(unsure):
                break
            shared = (filters[y[unsure]] == lower[:, None]).any(axis=1)
            mine[unsure[shared]] = False
            unsure = unsure[~shared]
        np.add.at(links, x[mine], n[y[mine]])
        np.add.at(links, y[mine], n[x[mine]])
    while True:  # smallest member reachable inside the group
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            return links, root
        root = least


def _compared(captured: DataFrame, dim: int, kind: str, cosine: float) -> DataFrame:
    """Per group and class with links: node, links, root (a class of the same component)."""
    counts = captured.select("label", F.explode("filters").alias("filter")).groupBy("label", "filter").agg(F.count("*").alias("m"))
    hot = written(counts.where(F.col("m") > TILE).select("label", "filter", F.ceil(F.col("m") / TILE).cast("int").alias("tiles")), "hot-filters")
    rows = captured.select("label", F.explode("filters").alias("filter"), "node", "vector", "n", F.col("filters").alias("all"))
    sized = rows.join(hot, ["label", "filter"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tiled = sized.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    grouped = tiled.select("label", "filter", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "tile", "node", "vector", "n", "all")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ends in _whole_groups(batches, 4):
            own, p, q, tile = (batch.column(k).to_numpy() for k in (1, 2, 3, 4))
            n, unit = batch.column(7).to_numpy(), _unit(batch.column(6), dim, kind)
            filters = batch.column(8).flatten().to_numpy().reshape(len(n), -1)
            links, root = np.zeros(len(n), np.int64), np.arange(len(n))
            for a, b in pairwise(ends):
                if b - a > 1:
                    left = None if p[a] == q[a] else tile[a:b] == p[a]
                    links[a:b], first = _compare(unit[a:b], left, n[a:b], filters[a:b], own[a], cosine)
                    root[a:b] = first + a
            some = np.flatnonzero((links > 0) | (root != np.arange(len(n))))
            if len(some):
                node = batch.column(5)
                yield pa.RecordBatch.from_arrays([node.take(pa.array(some)), pa.array(links[some]), node.take(pa.array(root[some]))], names=["node", "links", "root"])

    dealt = grouped.repartition("label", "filter", "p", "q").sortWithinPartitions("label", "filter", "p", "q", "node")
    return dealt.mapInArrow(run, "node binary, links long, root binary")


def linked(vectors: DataFrame, cosine: float = COSINE, captures: int = CAPTURES) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id (smallest vec_id reachable)."""
    good = _split(vectors, True)
    kind = "<f4" if good.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    keyed = written(_classes(good, kind), "vectors")
    classes = keyed.groupBy("key").agg(F.any_value("label").alias("label"), F.any_value("vector").alias("vector"), F.count("*").alias("n"), F.min("vec_id").alias("first"))
    no_id = F.when(F.col("first").isNull(), "01").otherwise("00")
    node = F.concat(F.unhex(no_id), ordered_bytes(F.coalesce("first", F.lit(0).cast("long"))), "key").alias("node")
    classes = written(classes.select("key", node, "label", "vector", "n", "first"), "vector-classes")
    usual = classes.groupBy(F.octet_length("vector").alias("bytes")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "bytes").first()
    rest = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    if usual is None:
        return rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    dim = usual["bytes"] // np.dtype(kind).itemsize
    largest = classes.groupBy("label").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0]
    code = CapFilters.build(dim, largest, captures)
    captured = written(_captured(classes, code, dim, kind), "captured")
    found = written(_compared(captured, dim, kind, cosine), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    smallest = F.when(F.col("root").isNull(), F.col("first")).when(F.hex(F.substring("root", 1, 1)) == "00", long_of(F.substring("root", 2, 8)))
    whole = classes.select("key", "node", "n", "first").join(links, "node", "left").join(roots, "node", "left")
    by_key = whole.select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), smallest.alias("component_id"))
    in_classes = keyed.select("vec_id", "key").join(by_key, "key").select("vec_id", "n_links", "component_id")
    alone = _split(vectors, False).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return in_classes.unionByName(alone)


def op7_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and group; kept is true for the smallest vec_id of the group."""
    rows = linked(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
