"""Connected components by alternating large and small stars, as joins and groupings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reviewmill.session import cut_lineage

HELD_EDGES = 500_000  # two numbers each
TASK_NODES = 1_000_000


def _star(pairs: DataFrame) -> DataFrame:
    """``u``, ``v`` and ``low``, the least node next to ``u`` or ``u`` itself."""
    low = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))
    return pairs.join(low, "u")


def _large(edges: DataFrame) -> DataFrame:
    """Hang the greater neighbours of every node on its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hung = _star(both).where("v > u")
    return hung.select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Hang every node and its lesser neighbours on the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    star = _star(down)
    hung = star.select(F.col("v").alias("u"), F.col("low").alias("v"))
    own = star.select("u", F.col("low").alias("v"))
    return hung.unionByName(own).where("u <> v").distinct()


def _signature(edges: DataFrame) -> tuple:
    hashed = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(hashed)).first())


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: edges of a partition as stars around the least nodes they connect."""
    parent: dict[int, int] = {}

    def find(node: int) -> int:
        while parent[node] != node:
            parent[node] = parent[parent[node]]
            node = parent[node]
        return node

    def stars() -> pa.RecordBatch:
        pairs = [(node, find(node)) for node in parent]
        parent.clear()
        hung = [p for p in pairs if p[0] != p[1]]
        arrays = [pa.array([p[i] for p in hung], pa.int64()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(arrays, ["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        if len(parent) > TASK_NODES:
            yield stars()
    yield stars()


def components(edges: DataFrame, a: str, b: str, held: int = HELD_EDGES) -> DataFrame:
    """``node`` and ``component``, its least reachable node, for the nodes of ``edges``.

    Tasks contract their own edges first. As soon as no more than ``held`` edges are left, one
    task finishes; until then, rounds of stars move every node to the least node that it can
    see. Their number grows with the logarithm of the longest path; each one is written to the
    shared folder. Nodes that are the least of their component have no row.
    """
    schema = "u bigint, v bigint"
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = cut_lineage(edges.mapInArrow(_contract, schema))
    before = None
    while edges.count() > held:
        edges = cut_lineage(_small(_large(edges)).mapInArrow(_contract, schema))
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        edges = cut_lineage(edges.repartition(1).mapInArrow(_contract, schema))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
