"""Counts of neighbours over merged nodes against breadth-first search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import graph
from quillstone.plans import catalog


def breadth_first(edges, seeds, hops):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    near.pop(None, None)  # nothing is reached from a null end
    out = []
    for s in sorted(seeds):
        seen, front = {s}, {s}
        for hop in range(1, hops + 1):
            front = {y for x in front for y in near.get(x, ())} - seen
            seen |= front
            out += [(s, hop, len(front))] if front else []
    return sorted(out)


@pytest.mark.parametrize("hops", [1, 2, 4])
def test_counts_are_those_of_every_pair(spark, hops):
    rng = np.random.default_rng(hops)
    edges = [tuple(map(int, rng.integers(0, 60, 2))) for _ in range(45)]  # loops and repeated edges too
    edges += [(100 + i, 200 + i % 3) for i in range(30)] + [(200, 300), (201, 300), (300, 7)]  # leaves of hubs
    edges += [(400 + i, 450 + j) for i in range(5) for j in range(4)] + [(500, 500), (501, None), (502, None), (503, None), (503, 7), (504, None), (504, 7)]
    seeds = [*range(0, 60, 3), 100, 101, 102, 200, 300, 400, 401, 450, 500, 501, 503, 9999]
    rows = spark.createDataFrame(edges, "src long, dst long")
    asked = spark.createDataFrame([(s,) for s in seeds + seeds[:3]] + [(None,)], "seed long")
    got = sorted(tuple(r) for r in graph.neighbour_counts(rows, asked, hops).collect())
    assert got == breadth_first(edges, seeds, hops)


def test_leaves_cost_one_node_a_hub(spark, monkeypatch):
    kept, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    edges = spark.range(6000).select(F.concat(F.lit("c"), "id").alias("src"), F.concat(F.lit("n"), (F.col("id") % 5)).alias("dst"))
    edges = edges.union(spark.range(5).select(F.concat(F.lit("n"), "id"), F.lit("r")))
    seeds = spark.range(1000).select(F.concat(F.lit("c"), "id").alias("seed"))
    got = graph.neighbour_counts(edges, seeds, 3).groupBy("hop", "n").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1000), (2, 1200, 1000), (3, 4, 1000)]
    fronts = [df for df in kept if "bits" in df.columns]
    assert len(fronts) == 4 and max(df.count() for df in fronts) <= 15


def test_multi_hop_counts_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "neighbours", None)
    assert catalog.QUERIES["multi_hop"](spark, "/root/testdata/sf0.001").count()
