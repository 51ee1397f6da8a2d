"""Merkle manifest of a table, with proofs by pointer jumping.

Every row is a leaf, a digest of its columns. Leaves of one source, in the order of their keys, are
hashed three by three, level by level, to the root of the source; the roots of all sources, in
the order of the sources, likewise to the root of the table. So a source can be checked by itself,
and a row against the root with the digests beside its way up, its proof.

Leaves are numbered over the whole table by a range shuffle and the counted rows of its partitions,
so no source, however large, is ordered in one task. A level is one grouping by (source, number / 3)
and is written once. Proofs are not walked level by level: each node starts with the siblings of its
own run, as a segment towards its parent. In each round a node takes over the segment of the
ancestor that its own one ends at, which doubles the distance, until every leaf reaches the root:
ten billion leaves need six rounds. Only ancestors that some leaf can still ask for are doubled, a third as
many for each level, so what is joined to the leaves shrinks fast; it is broadcast if its rows times
the greatest length of a segment are within a bound. Leaves that have arrived are spread over
the tasks of the join. Digests are kept as 32 bytes and hashed as hexadecimal text.

Defined results
---------------
* A NULL column is hashed as ``-``, which no value is: values are led by their length.
* Rows with equal keys are ordered by their digest; equal rows have equal leaves but places of their own.
* NULL keys come first, and NULL is a source of its own, before all others (by UTF-8 bytes).
* A source of one row: the leaf is the source's root. One source: its root is the root of the table.
* An empty table has no leaf, no root (None) and no proofs. Columns not named are ignored.
* Texts of any length are hashed where they lie; they are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewmill.llm.common import stored
from reviewmill.operators.joins import sized

FAN_OUT = 3
HELD_BYTES = 16 * 1024 * 1024
ABOVE = -1  # number of the tree over the roots of all sources
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
BITS = 33  # row numbers within a partition


def leaf_of(columns: Sequence[str | Column]) -> Column:
    """Digest of a row: each column as its length in bytes, a colon and its text."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hexadecimal(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def combined(*digests: Column) -> Column:
    """Digest of digests that follow each other."""
    return F.unhex(F.sha2(hexadecimal(F.concat(*digests)), 256))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along its proof."""
    return F.aggregate(path, leaf, lambda digest, beside: combined(beside["left"], digest, beside["right"]))


def proof_text(path: Column) -> Column:
    """Digests of a proof as one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(hexadecimal(p["left"]), hexadecimal(p["right"]))), "")


def numbered(rows: DataFrame, order: Sequence[str], number: str, name: str) -> DataFrame:
    """``rows`` with their place from 0 in the given order, NULLs first.

    Each range of the order is sorted in a task of its own, after the counted rows of the ranges before
    it; one count for each range is all that is brought together.
    """
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = stored(ranges.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", BITS)
    counts = ranges.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    placed = ranges.withColumn("_part", part).join(F.broadcast(starts), "_part")
    within = F.col("_at").bitwiseAND(F.lit((1 << BITS) - 1))
    return placed.withColumn(number, F.col("_before") + within).drop("_at", "_part", "_before")


@dataclass
class Manifest:
    """Levels of all trees, and what the leaves carry.

    ``leaves`` and ``levels`` hold runs: ``tree``, ``up`` (place of the parent), ``run`` (the children) and
    ``digest`` (of the parent). ``lone`` are leaves that are the roots of their sources. ``sources`` has the source, ``tree``,
    number of leaves ``n``, ``height`` and ``subroot``.
    """

    leaves: DataFrame
    lone: DataFrame
    levels: list[DataFrame]
    above: list[DataFrame]
    sources: DataFrame
    root: str | None
    depth: int
    top: tuple[int, int]
    carried: list[str]


def _runs(nodes: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Runs of consecutive nodes of a tree, with the digest of each."""
    child = F.struct("place", "digest", *carried)
    up = F.floor(F.col("place") / FAN_OUT).cast("bigint")
    runs = nodes.groupBy("tree", "n", up.alias("up")).agg(F.array_sort(F.collect_list(child)).alias("run"))
    return runs.withColumn("digest", combined(*_digests(FAN_OUT)))


def _digests(stop: int, start: int = 0) -> list[Column]:
    """Digests of some children of a run; nothing where it is shorter."""
    none = F.lit(b"")
    return [none, *[F.coalesce(F.get("run", F.lit(k))["digest"], none) for k in range(start, stop)]]


def _parents(runs: DataFrame) -> DataFrame:
    n = F.ceil(F.col("n") / FAN_OUT).cast("bigint")
    return runs.select("tree", n.alias("n"), F.col("up").alias("place"), "digest")


def _children(runs: DataFrame) -> DataFrame:
    """``tree``, ``up``, ``node`` and ``beside``, the digests left and right of it in its run."""
    left = reduce(
        lambda after, k: F.when(F.col("_k") == k, F.concat(*_digests(k))).otherwise(after), range(FAN_OUT), F.lit(b"")
    )
    right = reduce(
        lambda after, k: F.when(F.col("_k") == k, F.concat(*_digests(FAN_OUT, k + 1))).otherwise(after),
        range(FAN_OUT),
        F.lit(b""),
    )
    each = runs.select("tree", "up", "run", F.posexplode("run").alias("_k", "node"))
    return each.select("tree", "up", "node", F.struct(left.alias("left"), right.alias("right")).alias("beside"))


def _grown(runs: DataFrame, most: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Levels over ``runs``, whose trees have at most ``most`` leaves, and ``tree``, ``height``, ``digest`` of the roots."""
    levels, roots, height = [], [], 1
    nodes, most = _parents(runs), math.ceil(most / FAN_OUT)
    while True:
        done = nodes.where("n = 1").select("tree", F.lit(height).cast("bigint").alias("height"), "digest")
        roots.append(done)
        if most <= 1:
            return levels, reduce(DataFrame.unionByName, roots)
        levels.append(stored(_runs(nodes.where("n > 1")), f"{name}-{height}"))
        nodes, most, height = _parents(levels[-1]), math.ceil(most / FAN_OUT), height + 1


def build(
    docs: DataFrame,
    columns: Sequence[str] = COLUMNS,
    source: str = "source",
    key: str = "doc_id",
    carry: dict[str, Column] | None = None,
) -> Manifest:
    """All levels over the rows of ``docs``; ``carry`` are expressions that stay with their leaf."""
    carry = carry or {}
    rows = docs.select(
        F.col(source).alias("_source"),
        F.col(key).alias("_key"),
        leaf_of(columns).alias("digest"),
        *[c.alias(f"_c_{name}") for name, c in carry.items()],
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = stored(rows, "manifest-rows")
    carried = ["_key", *[f"_c_{name}" for name in carry]]
    ordered = numbered(rows, ["_source", "_key", "digest", "_row"], "_number", "manifest-order")
    sources = ordered.groupBy("_source").agg(F.min("_number").alias("_first"), F.count("*").alias("n"))
    sources = stored(numbered(sources, ["_source"], "tree", "manifest-sources"), "manifest-trees")
    n_sources, most = sources.agg(F.count("*"), F.max("n")).first()
    known = sources.select(F.col("_source").alias("_known"), "_first", "n", "tree")
    nodes = ordered.join(sized(known), F.col("_source").eqNullSafe(F.col("_known")))
    nodes = nodes.select("tree", "n", (F.col("_number") - F.col("_first")).alias("place"), "digest", *carried)
    lone = nodes.where("n = 1")
    leaves = stored(_runs(nodes.where("n > 1"), carried), "manifest-leaves")
    levels, roots = _grown(leaves, most or 0, "manifest-level")
    roots = roots.unionByName(lone.select("tree", F.lit(0).cast("bigint").alias("height"), "digest"))
    sources = stored(sources.select("_source", "tree", "n").join(roots, "tree"), "manifest-roots")
    above, root, top = [], None, (ABOVE, 0)
    heights = sources.agg(F.max("height")).first()[0] or 0
    if n_sources == 1:
        only = sources.first()
        root, top = only.digest.hex(), (only.tree, only.height)
    elif n_sources:
        subroots = sources.select(F.lit(ABOVE).cast("bigint").alias("tree"), F.lit(n_sources).alias("n"), F.col("tree").alias("place"), "digest", "height")
        first = stored(_runs(subroots, ["height"]), "manifest-above")
        rest, last = _grown(first, n_sources, "manifest-above")
        above = [first, *rest]
        root, top = bytes(last.first().digest).hex(), (ABOVE, len(above))
    sources = sources.select(
        F.col("_source").alias(source), "tree", "n", "height", hexadecimal(F.col("digest")).alias("subroot")
    )
    return Manifest(leaves, lone, levels, above, sources, root, heights + len(above), top, carried)


def _pointers(manifest: Manifest) -> DataFrame:
    """Nodes above the leaves with their parents and the digests beside them."""

    def pointed(runs: DataFrame, tree: Column, level: Column | int, place: Column, parent_level: int) -> DataFrame:
        level = F.lit(level) if isinstance(level, int) else level
        return _children(runs).select(
            tree.alias("tree"),
            level.cast("bigint").alias("level"),
            place.alias("place"),
            F.struct(
                F.col("tree"), F.lit(parent_level).cast("bigint").alias("level"), F.col("up").alias("place")
            ).alias("at"),
            F.array("beside").alias("path"),
        )

    own, node = F.col("tree"), F.col("node.place")
    parts = [pointed(runs, own, i + 1, node, i + 2) for i, runs in enumerate(manifest.levels)]
    for i, runs in enumerate(manifest.above):
        if i == 0:  # roots of sources
            parts.append(pointed(runs, node, F.col("node.height"), F.lit(0).cast("bigint"), 1))
        else:
            parts.append(pointed(runs, own, i, node, i + 1))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _jumped(rows: DataFrame, pointers: DataFrame, top: tuple[int, int], spread: Column) -> DataFrame:
    """``rows`` whose ``at`` moved on by the segments of ``pointers``; at the root they stay."""
    there = (F.col("at.tree") == top[0]) & (F.col("at.level") == top[1])
    rows = rows.select("*", F.when(there, -1 - F.abs(spread % (1 << 40))).otherwise(F.col("at.place")).alias("_place"))
    on = [F.col("at.tree") == F.col("_t"), F.col("at.level") == F.col("_l"), F.col("_place") == F.col("_p")]
    ahead = pointers.select(
        F.col("tree").alias("_t"), F.col("level").alias("_l"), F.col("place").alias("_p"),
        F.col("at").alias("_at"), F.col("path").alias("_path"),
    )
    moved = rows.join(ahead, reduce(Column.__and__, on), "left")
    return moved.withColumns(
        {
            "path": F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("path", "_path")),
            "at": F.coalesce("_at", "at"),
        }
    ).drop("_place", "_t", "_l", "_p", "_at", "_path")


def proofs(manifest: Manifest) -> DataFrame:
    """Every leaf: its key as ``_key``, what it carries, ``digest``, ``tree`` and ``path``.

    ``path`` has the digests left and right of the leaf's way on every level up to the root.
    """
    kept = [F.col(f"node.{c}").alias(c) for c in manifest.carried]
    parent = F.struct("tree", F.lit(1).cast("bigint").alias("level"), F.col("up").alias("place"))
    rows = _children(manifest.leaves).select(
        "tree", F.col("node.place").alias("place"), F.col("node.digest").alias("digest"), *kept,
        parent.alias("at"), F.array("beside").alias("path"),
    )
    kind = rows.schema["path"].dataType
    itself = F.struct("tree", F.lit(0).cast("bigint").alias("level"), F.lit(0).cast("bigint").alias("place"))
    rows = rows.unionByName(
        manifest.lone.select(
            "tree", "place", "digest", *manifest.carried, itself.alias("at"), F.array().cast(kind).alias("path")
        )
    )
    pointers, reach, done = _pointers(manifest), 1, 0
    while pointers is not None and done < manifest.depth:
        pointers = stored(pointers, f"manifest-ahead-{reach}")
        small = pointers.count() * 64 * (reach + 1) <= HELD_BYTES
        ahead = F.broadcast(pointers) if small else pointers
        rows = _jumped(rows, ahead, manifest.top, F.xxhash64("tree", "place"))
        done += reach
        if done < manifest.depth:
            # leaves ask for ancestors at that distance only
            asked = pointers.where((F.col("level") >= 2 * reach) | (F.col("tree") == ABOVE))
            pointers = _jumped(asked, ahead, manifest.top, F.xxhash64("tree", "level", "place"))
        reach *= 2
    return rows.drop("at")


def verified(docs: DataFrame, changed: Column, columns: Sequence[str] = COLUMNS, source: str = "source", key: str = "doc_id") -> DataFrame:
    """Key, ``leaf``, ``subroot``, ``root``, ``path`` of every row, and ``folded_root`` of the leaf ``changed``."""
    manifest = build(docs, columns, source, key, {"changed": changed})
    subroots = manifest.sources.select(F.col("tree").alias("_tree"), "subroot")
    found = proofs(manifest).join(sized(subroots), F.col("tree") == F.col("_tree"))
    return found.select(
        F.col("_key").alias(key),
        hexadecimal(F.col("digest")).alias("leaf"),
        "subroot",
        F.lit(manifest.root).cast("string").alias("root"),
        "path",
        hexadecimal(folded(F.coalesce("_c_changed", "digest"), F.col("path"))).alias("folded_root"),
    )
