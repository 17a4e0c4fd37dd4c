"""The layout sees every edge and saved position of its nodes, or refuses."""

import pytest
from pyspark.sql import functions as F

from sparkquill.operators import graph


def test_edges_and_positions_of_other_nodes_do_not_displace(spark, monkeypatch):
    monkeypatch.setattr(graph, "LARGEST_LAYOUT", 3)
    monkeypatch.setattr(graph, "LARGEST_LAYOUT_EDGES", 3, raising=False)
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    own = spark.createDataFrame([("a", "b"), ("b", "c")], "from_id string, to_id string")
    saved = spark.createDataFrame([(x, 10.0 * i, 5.0) for i, x in enumerate("abc")], "node string, x double, y double")
    others = spark.range(400).select(F.concat(F.lit("n"), "id").alias("k"))
    edges = others.select(F.col("k").alias("from_id"), F.concat("k", F.lit("x")).alias("to_id")).unionByName(own)
    positions = others.select(F.col("k").alias("node"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y")).unionByName(saved)
    assert sorted(map(tuple, graph.layout(nodes, edges, positions).collect())) == sorted(map(tuple, graph.layout(nodes, own, saved).collect()))
    assert sorted(map(tuple, graph.layout(nodes, edges, positions, rounds=0).collect())) == [("a", 0.0, 5.0), ("b", 10.0, 5.0), ("c", 20.0, 5.0)]


def test_too_many_edges_are_refused(spark, monkeypatch):
    monkeypatch.setattr(graph, "LARGEST_LAYOUT_EDGES", 1, raising=False)
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "from_id string, to_id string")
    with pytest.raises(ValueError, match="edges"):
        graph.layout(nodes, edges)
