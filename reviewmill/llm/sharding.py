"""Shards of near equal bytes by Karmarkar-Karp differencing over indivisible groups.

Rows with one group key stay together, so only sums per group take part: a group with a third
of all rows is one number. Groups are hashed into chunks of bounded size. Each chunk is one task
that starts with every group as a partial partition of its own and keeps combining the two
partial partitions with the largest spread, the heaviest shard of one with the lightest of the
other. What remains of a chunk is one partial partition, and these are combined in the same way,
in a tree of bounded fan-in, until one is left. Every level hands down only how its shards were
permuted. No task holds more than a chunk or the children of one tree node, and the driver none.

Defined results
---------------
* Text NULL: size 1, checksum 0, grouped with the empty text.
* The group key is a 64-bit hash; two texts that share it by chance stay together, which changes
  no promise. Repeated rows are members of their group.
* Row keys may be NULL or repeated; slots follow (key, checksum, size), NULLs first.
* An empty table gives an empty result. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewmill.session import cut_lineage

CHUNK_GROUPS = 50_000
FAN_IN = 4_096
SLOT_ROWS = 100_000


def differencing(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions, one a row of ``parts`` (sums per shard), into one.

    Returns the shard that each column of each row went to, and the sums of the shards.
    """
    n, shards = parts.shape
    parent = np.full((2 * n - 1, shards), -1, dtype=np.int64)  # shard in the partition above
    above = np.full(2 * n - 1, -1, dtype=np.int64)
    order = np.argsort(parts, axis=1, kind="stable")[:, ::-1]
    ordered = np.take_along_axis(parts, order, axis=1)
    live = {i: (row, cols) for i, (row, cols) in enumerate(zip(ordered.tolist(), order.tolist()))}
    heap = [(row[-1] - row[0], i) for i, (row, _) in live.items()]
    heapq.heapify(heap)
    turned = range(shards - 1, -1, -1)
    node = n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (sums_a, cols_a), (sums_b, cols_b) = live.pop(a), live.pop(b)
        above[a] = above[b] = node
        parent[a, cols_a] = np.arange(shards)
        parent[b, cols_b] = np.arange(shards)[::-1]
        sums = [sums_a[j] + sums_b[t] for j, t in zip(range(shards), turned)]
        cols = sorted(range(shards), key=sums.__getitem__, reverse=True)
        sums = [sums[j] for j in cols]
        live[node] = (sums, cols)
        heapq.heappush(heap, (sums[-1] - sums[0], node))
        node += 1
    place = np.tile(np.arange(shards), (2 * n - 1, 1))
    for i in range(2 * n - 3, -1, -1):
        place[i] = place[above[i]][parent[i]]
    sums, cols = live[node - 1] if n else ([0] * shards, list(range(shards)))
    total = np.zeros(shards, dtype=np.int64)
    total[cols] = sums
    return place[:n], total


def _split_chunk(shards: int):
    """Group function: shard of every group within its chunk, and the chunk's sums."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "group"], ascending=[False, True], kind="stable")
        parts = np.zeros((len(pdf), shards), dtype=np.int64)
        parts[:, 0] = pdf["bytes"].to_numpy()
        place, total = differencing(parts)
        return pd.DataFrame(
            {"group": pdf["group"], "chunk": pdf["chunk"], "bin": place[:, 0].astype("int32")}
        ).assign(sums=[total.tolist()] + [None] * (len(pdf) - 1))

    return run


def _split_nodes(shards: int):
    """Group function: where the shards of each child went, and the sums of the node."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("child")
        place, total = differencing(np.array(pdf["sums"].tolist(), dtype=np.int64).reshape(-1, shards))
        return pd.DataFrame({"child": pdf["child"], "node": pdf["node"]}).assign(
            place=place.astype("int32").tolist(), sums=[total.tolist()] + [None] * (len(pdf) - 1)
        )

    return run


def _tree(nodes: DataFrame, n_nodes: int, shards: int, fan_in: int) -> DataFrame:
    """``child`` and ``place``, the final shard of each of its shards."""
    grouped = nodes.withColumn("node", F.floor(F.col("child") / fan_in).cast("bigint"))
    schema = "child bigint, node bigint, place array<int>, sums array<bigint>"
    placed = cut_lineage(grouped.groupBy("node").applyInPandas(_split_nodes(shards), schema))
    if n_nodes <= fan_in:
        return placed.select("child", "place")
    totals = placed.where("sums IS NOT NULL").select(F.col("node").alias("child"), "sums")
    above = _tree(totals, math.ceil(n_nodes / fan_in), shards, fan_in)
    above = above.select(F.col("child").alias("node"), F.col("place").alias("up"))
    up = F.transform("place", lambda p: F.element_at("up", p + 1))
    return placed.join(above, "node").select("child", up.alias("place"))


def assign_groups(
    groups: DataFrame, shards: int, chunk_groups: int = CHUNK_GROUPS, fan_in: int = FAN_IN
) -> DataFrame:
    """``group`` and ``shard`` for a frame of ``group`` (bigint) and ``bytes`` (bigint)."""
    groups = cut_lineage(groups.select("group", "bytes"))
    chunks = max(1, math.ceil(groups.count() / chunk_groups))
    chunked = groups.withColumn("chunk", F.pmod(F.xxhash64("group"), F.lit(chunks)))
    schema = "group bigint, chunk bigint, bin int, sums array<bigint>"
    split = cut_lineage(chunked.groupBy("chunk").applyInPandas(_split_chunk(shards), schema))
    nodes = split.where("sums IS NOT NULL").select(F.col("chunk").alias("child"), "sums")
    places = _tree(nodes, chunks, shards, fan_in)
    joined = split.join(places, split.chunk == places.child)
    return joined.select("group", F.element_at("place", F.col("bin") + 1).alias("shard"))


def slots(rows: DataFrame, n_rows: int, order: list[str], per_block: int = SLOT_ROWS) -> DataFrame:
    """``rows`` with ``slot``: places without gaps from 0 within each ``shard``.

    Shards are cut into hashed blocks of bounded size. A block's rows are numbered by
    themselves, after the counted rows of the blocks before it.
    """
    blocks = max(1, math.ceil(n_rows / per_block))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "_block").agg(F.count("*").alias("_rows"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    within = Window.partitionBy("shard", "_block").orderBy(*order)
    numbered = rows.withColumn("_rn", F.row_number().over(within))
    slot = (F.col("_before") + F.col("_rn") - 1).cast("bigint")
    return (
        numbered.join(counts.drop("_rows"), ["shard", "_block"])
        .withColumn("slot", slot)
        .drop("_block", "_rn", "_before")
    )


def shard_documents(
    docs: DataFrame,
    shards: int,
    key: str = "doc_id",
    text: str = "text",
    group: Column | None = None,
    chunk_groups: int = CHUNK_GROUPS,
    fan_in: int = FAN_IN,
    per_block: int = SLOT_ROWS,
) -> DataFrame:
    """Key, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row.

    ``group`` tells which rows are indivisible; equal texts unless given.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(content) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(content, "UTF-8")).cast("bigint").alias("text_crc32"),
        F.xxhash64(content if group is None else group).alias("group"),
    )
    rows = cut_lineage(rows)
    shard = assign_groups(
        rows.groupBy("group").agg(F.sum("size").alias("bytes")), shards, chunk_groups, fan_in
    )
    placed = rows.join(shard, "group").drop("group")
    numbered = slots(placed, rows.count(), ["_key", "text_crc32", "size"], per_block)
    return numbered.select(F.col("_key").alias(key), "size", "text_crc32", "shard", "slot")
