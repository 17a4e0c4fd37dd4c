"""Connected components of an edge table.

Large tables go by alternating large-star and small-star rounds; a table of at most ONE_TASK edges,
counted before, goes through union-find in one task, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquill.llm.common import written

#: Rounds shrink paths geometrically; more than this many mean a fault.
MOST_ROUNDS = 60
ONE_TASK = 200_000


def ordered_bytes(number: Column) -> Column:
    """Eight bytes of a long, ordered as the numbers are."""
    return F.unhex(F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def long_of(data: Column) -> Column:
    """The long of ordered_bytes."""
    return F.conv(F.hex(data), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").distinct()


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            up.setdefault(u, u)
            up.setdefault(v, v)
            x, y = root(u), root(v)
            up[max(x, y)] = min(x, y)
        kind = batch.schema.field(0).type
    if up:
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["node", "root"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """From edges (a, b) of any ordered type: node, root (the smallest node reachable), for every node with an edge.

    Minima are aggregated before the shuffle and joined back, so a node with very many edges is no
    row of its own size; skewed joins are left to adaptive execution. Each round is written to the
    shared folder. Null ends and loops are ignored.
    """
    held = written(_distinct(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "edges")
    if held.limit(one_task + 1).count() <= one_task:
        kind = held.schema["u"].dataType.simpleString()
        return held.coalesce(1).mapInArrow(_union_find, f"node {kind}, root {kind}")
    mark = None
    for _ in range(MOST_ROUNDS):
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = _distinct(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        held = written(_distinct(small), "small-star")
        now = held.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == mark or not now["n"]:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = held.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
