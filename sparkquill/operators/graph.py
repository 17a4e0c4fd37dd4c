"""The link graph: resolution, degrees, orphans, ghosts, breadth-first neighbourhoods, layout."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquill.functions.scalars import half_up, hash_seed
from sparkquill.functions.text import fold
from sparkquill.operators.lifecycle import replace_table
from sparkquill.operators.search import ranked_rows

LAYOUT_ROUNDS, GRAVITY = 200, 0.25
LARGEST_LAYOUT = 5000
LARGEST_LAYOUT_EDGES = 50 * LARGEST_LAYOUT


def page_links(pages: DataFrame) -> DataFrame:
    """from_id, target, anchor of the links of HTML pages, in order (line)."""
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)'), F.lit(1)).alias("target"), F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)'), F.lit(2)).alias("anchor"))
    return pages.select(F.col("page_id").alias("from_id"), F.posexplode(found).alias("line", "x")).select("from_id", F.col("line").cast("long").alias("line"), F.col("x.target").alias("target"), F.col("x.anchor").alias("anchor"))


def link_keys(files: DataFrame) -> DataFrame:
    """The keys a file answers to, by priority: id, folded path without extension, folded base name."""
    path = F.regexp_replace(fold(F.col("rel")), r"\.[^.]+$", "")
    base = F.element_at(F.split(path, "/"), -1)
    keys = F.array(*[F.struct(F.lit(i).alias("priority"), k.alias("key")) for i, k in enumerate((F.col("file_id"), path, base))])
    return files.select("file_id", "source", F.explode(keys).alias("k")).select("file_id", F.col("source").alias("to_source"), "k.priority", "k.key")


def resolved(links: DataFrame, files: DataFrame) -> DataFrame:
    """links (from_id, from_source, line, target, anchor) with to_id: by id, path, base name, base name of the target; the same source first; null if broken."""
    path = F.regexp_replace(fold(F.col("target")), r"\.[^.]+$", "")
    base = F.element_at(F.split(path, "/"), -1)
    wanted = links.select("from_id", "from_source", "line", "target", "anchor", F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(p).alias("priority"), k.alias("key")) for i, (p, k) in enumerate(((0, F.col("target")), (1, path), (2, path), (2, base)))])).alias("w"))
    wanted = wanted.select("from_id", "from_source", "line", "target", "anchor", "w.step", "w.priority", "w.key")
    candidates = wanted.join(link_keys(files), ["priority", "key"], "left")
    best = F.min(F.when(F.col("file_id").isNotNull(), F.struct("step", (F.col("to_source") != F.col("from_source")).alias("elsewhere"), "file_id"))).alias("best")
    return candidates.groupBy("from_id", "line", "target", "anchor").agg(best).select("from_id", "line", "target", "anchor", F.col("best.file_id").alias("to_id"))


def edges_of(links: DataFrame) -> DataFrame:
    """from_id, to_id, broken; a target that no file answers to is a ghost node of its own."""
    return links.select("from_id", F.coalesce("to_id", F.concat(F.lit("ghost:"), F.col("target"))).alias("to_id"), F.col("to_id").isNull().alias("broken"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, inbound, outbound, orphan, ghost. Edges are aggregated before they meet the nodes; parallel ones count."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("to_id").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("from_id").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    counted = ends.groupBy("e.node").agg(F.sum("e.i").alias("inbound"), F.sum("e.o").alias("outbound"))
    joined = nodes.select("node", F.lit(True).alias("real")).join(counted, "node", "full")
    none = F.lit(0).cast("long")
    return joined.select("node", F.coalesce("inbound", none).alias("inbound"), F.coalesce("outbound", none).alias("outbound"), F.col("real").isNull().alias("ghost")).withColumn("orphan", (F.col("inbound") + F.col("outbound") == 0) & ~F.col("ghost"))


def stats(node_degrees: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, ghosts, orphans, links, broken."""
    n = node_degrees.agg(F.count_if(~F.col("ghost")).alias("nodes"), F.count_if("ghost").alias("ghosts"), F.count_if("orphan").alias("orphans"))
    return n.crossJoin(edges.agg(F.count("*").alias("links"), F.count_if("broken").alias("broken")))


def anchor_text(links: DataFrame) -> DataFrame:
    """to_id and the text of the links to it, in order of from_id and line."""
    rows = links.where(F.col("to_id").isNotNull() & (F.coalesce("anchor", F.lit("")) != ""))
    return rows.groupBy("to_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("from_id", "line", "anchor"))), lambda x: x["anchor"]), " ").alias("anchors"))


def related(edges: DataFrame, start: list, depth: int = 2) -> DataFrame:
    """node, depth of everything within depth undirected steps of the start nodes; each round is an equi-join and an anti-join."""
    both = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).unionByName(edges.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"))).distinct()
    kind = both.schema["a"].dataType.simpleString()
    seen = edges.sparkSession.createDataFrame([(x,) for x in start], "node string").select(F.col("node").cast(kind).alias("node"), F.lit(0).alias("depth"))
    frontier = seen
    for d in range(1, depth + 1):
        frontier = frontier.join(both, frontier["node"] == both["a"]).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen


def ranked_related(seen: DataFrame, node_degrees: DataFrame) -> DataFrame:
    total = node_degrees.select("node", (F.col("inbound") + F.col("outbound")).alias("degree"))
    rows = ranked_rows(seen.where("depth > 0").join(total, "node"), [("depth", False), ("degree", True)], [F.asc("node")])
    return rows.select("node", F.col("depth").cast("long").alias("depth"), F.col("rank").cast("long").alias("rank"))


def layout(nodes: DataFrame, edges: DataFrame, positions: DataFrame | None = None, rounds: int = LAYOUT_ROUNDS) -> DataFrame:
    """node, x, y of a force layout. It is quadratic and for drawing: at most LARGEST_LAYOUT nodes and LARGEST_LAYOUT_EDGES edges between them, checked."""
    names = [r[0] for r in nodes.select("node").orderBy("node").limit(LARGEST_LAYOUT + 1).collect()]
    if len(names) > LARGEST_LAYOUT:
        raise ValueError(f"a layout has at most {LARGEST_LAYOUT} nodes")
    n, at = len(names), {x: i for i, x in enumerate(names)}
    ids = nodes.select("node").distinct()
    inside = edges.select("from_id", "to_id").where("from_id <> to_id").join(ids.withColumnRenamed("node", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("node", "to_id"), "to_id", "left_semi")
    ends = inside.select("from_id", "to_id").distinct().limit(LARGEST_LAYOUT_EDGES + 1).collect()
    if len(ends) > LARGEST_LAYOUT_EDGES:
        raise ValueError(f"a layout has at most {LARGEST_LAYOUT_EDGES} edges")
    pairs = [(at[a], at[b]) for a, b in ends]
    spark = nodes.sparkSession
    if not n:
        return spark.createDataFrame([], "node string, x double, y double")
    area = 1000 * np.sqrt(n / 100)
    seeds = np.array([np.random.default_rng(hash_seed(str(x))).random(2) for x in names])
    where = (area / 2 * np.sqrt(seeds[:, :1])) * np.stack([np.cos(2 * np.pi * seeds[:, 1]), np.sin(2 * np.pi * seeds[:, 1])], axis=1)
    warm = 0
    if positions is not None:
        saved = positions.select("node", "x", "y").join(ids, "node", "left_semi").limit(LARGEST_LAYOUT + 1).collect()
        if len(saved) > LARGEST_LAYOUT:
            raise ValueError(f"a layout has at most {LARGEST_LAYOUT} saved positions")
        for r in saved:
            where[at[r["node"]]] = r["x"], r["y"]
            warm += 1
    k = np.sqrt(area * area / n)
    start = area / (40 if warm > 0.8 * n else 8)
    a, b = (np.array(x, int) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int), np.zeros(0, int))
    for t in range(rounds):
        gap = where[:, None] - where[None]
        far = np.maximum(np.sqrt((gap**2).sum(2)), 0.01)
        push = (gap * (k * k / far**2)[:, :, None]).sum(1)
        pull = where[a] - where[b]
        pull = pull * (np.maximum(np.sqrt((pull**2).sum(1)), 0.01) / k)[:, None]
        np.add.at(push, a, -pull)
        np.add.at(push, b, pull)
        push -= GRAVITY * where
        size = np.maximum(np.sqrt((push**2).sum(1)), 0.01)
        where += push / size[:, None] * np.minimum(size, start * (1 - t / rounds))[:, None]
    return spark.createDataFrame(pd.DataFrame({"node": [str(x) for x in names], "x": where[:, 0], "y": where[:, 1]})).select("node", half_up(F.col("x"), 1).alias("x"), half_up(F.col("y"), 1).alias("y"))


def write(nodes: DataFrame, edges: DataFrame, path: str, rounds: int = LAYOUT_ROUNDS) -> None:
    """Stores the graph as tables nodes (with degrees and positions), edges and stats; the layout starts from the positions stored before.

    A graph that lost more than a tenth of its nodes is refused.
    """
    spark = nodes.sparkSession
    own = degrees(nodes, edges)
    old, before = None, None
    try:
        old = spark.read.parquet(f"{path}/nodes")
        before = old.count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    placed = layout(own.select("node"), edges, old, rounds)
    replace_table(own.join(placed, "node", "left"), f"{path}/nodes", before)
    replace_table(edges, f"{path}/edges")
    replace_table(stats(own, edges), f"{path}/stats")


def normalised(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph document repaired: nodes with defaults, a ghost for every end of an edge that no node has."""
    fixed = nodes.select("id", F.coalesce("label", "id").alias("label"), F.coalesce(F.try_to_number(F.col("size").cast("string"), F.lit("999999999")), F.lit(0)).cast("long").alias("size"), F.coalesce("ghost", F.lit(False)).alias("ghost")).where("id is not null").dropDuplicates(["id"])
    sound = edges.where("source is not null and target is not null")
    missing = sound.select(F.explode(F.array("source", "target")).alias("id")).distinct().join(fixed, "id", "left_anti")
    return fixed.unionByName(missing.select("id", F.col("id").alias("label"), F.lit(0).cast("long").alias("size"), F.lit(True).alias("ghost"))), sound
