"""Near duplicates by Jaccard similarity of word n-grams, exact, with a prefix-tree join.

1. Every text becomes the sorted set of the 64-bit hashes of its n-grams. Equal sets are one
   class; only the least key of a class goes on.
2. n-grams have one global order. Two sets that reach the threshold share an n-gram within the
   first ``n - ceil(t n) + 1`` of either, so only those count, and an n-gram found in one set only
   needs no partner. With the rarest ahead, a text with enough n-grams of its own drops out here,
   and common passages come too late to matter. Sets of at most ``SHORT`` n-grams are ordered by
   their counts among such sets. For longer ones it is enough to count a quarter, chosen by hash,
   that comes before the others; should a set have too few of the quarter, the first of its
   others by hash are added. A short set whose partner may be longer takes part in both orders.
3. Sets that share such an n-gram are hung on the least of them; the connected components of
   these stars are the units within which links can exist.
4. The sets of a unit, read from their texts once more, are put into a prefix tree, most common
   n-grams first. Each set walks the tree: sets with a common beginning share the count of its
   overlap, and a subtree is left when what remains of both sides cannot reach the threshold.
   Links join sets in a union-find; two sets already joined are not compared again.

A unit larger than a block is cut into hashed blocks. Blocks are joined by themselves first, then
their representatives, level by level, until each unit has one block left; so a group of copies
with a third of all rows comes together without all of its pairs. In units that still
have more than one part the sets outside the largest one are compared with all blocks, except for
pairs within a part. Where these fill several blocks, the unit is first told apart again as in 2
and 3, by all n-grams of its sets: sets of long texts often come into a large unit only because
a quarter holds too few n-grams of their own. No pairs are written, only which set was joined
with which.

All keys of an n-gram are sorted in one task. They are one for each set at most, a small share of
all rows unless sets are tiny. Texts are looked up for the sets of units, and
left out at the end, through bitmaps of keys where the keys are too many for a broadcast.

Defined results
---------------
* Text NULL, empty or of white space only: 0 n-grams, linked with nothing.
* Fewer words than ``n``: the whole sequence is the one n-gram.
* Key NULL: the n-grams are counted, the component is NULL and nothing is linked with the row.
* Rows that repeat a key are compared by their own texts. Ties go to the least key.
* Two n-grams with equal 64-bit hashes count as one.
* An empty table gives an empty result. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewmill.llm.common import free_worker_cache, sliced_by_bytes, stored
from reviewmill.llm.components import components
from reviewmill.operators.joins import join_keys, sized
from reviewmill.session import cut_lineage

WORDS, PERCENT = 5, 80
COUNTED = 4  # one n-gram in so many is counted
SHORT = 200  # in sets of at most so many, all are
BLOCK_SETS = 400
BLOCK_GRAMS = 1_500_000
ENOUGH = 0.6  # blocks are dealt anew as long as so few of their sets are left
SLICE_BYTES = 1_000_000
OUT_TEXTS = 512


class Measure(NamedTuple):
    """Words of an n-gram, and the least Jaccard similarity in percent."""

    words: int = WORDS
    percent: int = PERCENT

    def prefix(self, size: int) -> int:
        return size - (self.percent * size + 99) // 100 + 1

    def linked(self, common: int, size: int, other: int) -> bool:
        """common / (size + other - common) >= percent / 100"""
        return (100 + self.percent) * common >= self.percent * (size + other)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; A-Z are lower-cased, words end at ASCII white space."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(found))
    count = len(found) - width + 1
    grams = np.full(count, width, np.uint64)
    for i in range(width):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + count]
        grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(grams ^ (grams >> np.uint64(29)))


def _profile(measure: Measure):
    """Task function: size, key of the set, and the n-grams that may find a partner.

    ``short`` has all n-grams of a short set, ``grams`` the chosen ones of a set that may have a
    longer partner, ``counted`` of which belong to the quarter.
    """
    names = ["_key", "size", "set_key", "short", "counted", "grams"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())]
    both_from = measure.percent * SHORT // 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_cache()
        for batch in sliced_by_bytes(batches, 1, SLICE_BYTES):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first in range(0, len(keys), OUT_TEXTS):
                rows = []
                for key, text in zip(keys[first : first + OUT_TEXTS], texts[first : first + OUT_TEXTS]):
                    grams = shingles(text, measure.words)
                    short = grams if len(grams) <= SHORT else grams[:0]
                    inside = grams % np.uint64(COUNTED) == 0
                    chosen, rest = (grams[inside], grams[~inside]) if len(grams) >= both_from else (grams[:0], grams[:0])
                    lacking = max(0, measure.prefix(len(grams)) - len(chosen))
                    out = np.concatenate([chosen, rest[:lacking]]).view(np.int64)
                    digest = hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None
                    rows.append((key, len(grams), digest, short.view(np.int64), len(chosen), out))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

    return run


def _sets(measure: Measure):
    """Task function: (unit, key, text) to the set of each text."""
    names = ["unit", "key", "size", "grams"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_cache()
        for batch in sliced_by_bytes(batches, 2, SLICE_BYTES):
            texts = batch.column(2).to_pylist()
            for first in range(0, len(texts), OUT_TEXTS):
                grams = [shingles(t, measure.words) for t in texts[first : first + OUT_TEXTS]]
                part = batch.slice(first, OUT_TEXTS)
                sizes, raw = pa.array([len(g) for g in grams], pa.int64()), [g.tobytes() for g in grams]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sizes, pa.array(raw, pa.binary())], names)

    return run


class PrefixTree:
    """Ordered sets in a tree whose edges are runs of n-grams (places in the common order)."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int], stored_sets: list[int]):
        self.runs: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.children: list[list[int]] = [[]]
        self.ends: list[list[int]] = [[]]  # sets that end at a node
        order = sorted(stored_sets, key=lambda i: sets[i].astype(">u4").tobytes())
        path, depths = [0], [0]
        before = np.zeros(0, np.int64)
        for i in order:
            now = sets[i]
            same = min(len(before), len(now))
            unlike = np.flatnonzero(before[:same] != now[:same])
            shared = int(unlike[0]) if len(unlike) else same
            while depths[-1] > shared:
                last = path.pop()
                depth = depths.pop()
                if depths[-1] < shared:  # cut the edge where the two sets part
                    cut = len(self.runs[last]) - (depth - shared)
                    middle = self._node(self.runs[last][:cut])
                    self.runs[last] = self.runs[last][cut:]
                    self.children[middle].append(last)
                    siblings = self.children[path[-1]]
                    siblings[siblings.index(last)] = middle
                    path.append(middle)
                    depths.append(shared)
            if shared < len(now):
                node = self._node(now[shared:])
                self.children[path[-1]].append(node)
                path.append(node)
                depths.append(len(now))
            self.ends[path[-1]].append(i)
            before = now
        self._bounds(sets, sizes)

    def _node(self, run: np.ndarray) -> int:
        self.runs.append(run)
        self.children.append([])
        self.ends.append([])
        return len(self.runs) - 1

    def _bounds(self, sets: list[np.ndarray], sizes: list[int]) -> None:
        """Of every subtree: least and greatest set size, and the most n-grams below its root."""
        n = len(self.runs)
        self.least, self.most, self.below = [1 << 60] * n, [0] * n, [0] * n
        order, stack = [], [0]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += self.children[node]
        for node in reversed(order):
            for i in self.ends[node]:
                self.least[node] = min(self.least[node], sizes[i])
                self.most[node] = max(self.most[node], sizes[i])
            for child in self.children[node]:
                self.least[node] = min(self.least[node], self.least[child])
                self.most[node] = max(self.most[node], self.most[child])
                self.below[node] = max(self.below[node], len(self.runs[child]) + self.below[child])

    def partners(self, own: np.ndarray, size: int, marks: np.ndarray, measure: Measure) -> Iterator[tuple[int, int]]:
        """Stored sets that a set could be linked with, and how many n-grams they share."""
        share, whole = measure.percent, 100 + measure.percent
        stack = [(0, 0)]
        while stack:
            node, common = stack.pop()
            run = self.runs[node]
            if 100 * self.most[node] < share * size or 100 * size < share * self.least[node]:
                continue
            if len(run):
                common += int(np.count_nonzero(marks[run]))
                left = len(own) - int(np.searchsorted(own, run[-1], side="right"))
            else:
                left = len(own)
            if whole * (common + min(left, self.below[node])) < share * (size + self.least[node]):
                continue
            for i in self.ends[node]:
                yield i, common
            stack += [(child, common) for child in self.children[node]]


def _ordered(grams: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Every set as places in one order, most common first, without what only one set has."""
    every, place, counts = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    order = np.lexsort((every, -counts))
    rank = np.empty(len(every), np.int64)
    rank[order] = np.arange(len(every))
    shared = int((counts > 1).sum())
    ranks = np.split(rank[place], np.cumsum([len(g) for g in grams])[:-1])
    return [np.sort(r[r < shared]) for r in ranks], shared


def link_sets(
    grams: list[np.ndarray], parts: list[int], probes: list[int], stored_sets: list[int], measure: Measure
) -> list[int]:
    """For every set the least of the ``parts`` that it is joined with, over links of probes and stored sets."""
    sets, shared = _ordered(grams)
    sizes = [len(g) for g in grams]
    tree = PrefixTree(sets, sizes, stored_sets)
    parent = {p: p for p in parts}

    def find(p: int) -> int:
        while parent[p] != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        return p

    marks = np.zeros(shared, bool)
    for i in probes:
        marks[sets[i]] = True
        for j, common in tree.partners(sets[i], sizes[i], marks, measure):
            a, b = find(parts[i]), find(parts[j])
            if a != b and measure.linked(common, sizes[i], sizes[j]):
                parent[max(a, b)] = min(a, b)
        marks[sets[i]] = False
    return [find(p) for p in parts]


def _join_block(measure: Measure):
    """Group function: joins within one block, or between the sets of two."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "size"], kind="stable")
        grams = [np.frombuffer(g, np.uint64) for g in pdf["grams"]]
        side, every = pdf["side"].tolist(), range(len(pdf))
        one_block = all(s < 0 for s in side)
        probes = [i for i in every if one_block or side[i] == 0]
        kept = [i for i in every if one_block or side[i] == 1]
        found = link_sets(grams, pdf["part"].tolist(), probes, kept, measure)
        return pd.DataFrame({"unit": pdf["unit"], "part": pdf["part"], "joined": found}).drop_duplicates()

    return run


def _blocked(rows: DataFrame, salt: int, block_sets: int, block_grams: int) -> DataFrame:
    """``rows`` with the number of ``blocks`` of their unit and their ``block``."""
    weights = rows.groupBy("unit").agg(F.count("*").alias("sets"), F.sum("size").alias("grams_in"))
    blocks = F.greatest(F.ceil(F.col("sets") / block_sets), F.ceil(F.col("grams_in") / block_grams), F.lit(1))
    weights = weights.select("unit", blocks.cast("int").alias("_blocks")).where("_blocks > 1")
    rows = rows.join(sized(cut_lineage(weights)), "unit", "left")
    rows = rows.withColumn("blocks", F.coalesce("_blocks", F.lit(1))).drop("_blocks")
    return rows.withColumn("block", F.pmod(F.xxhash64("key", F.lit(salt)), F.col("blocks")).cast("int"))


def _links(sets: DataFrame, measure: Measure, block_sets: int, block_grams: int) -> DataFrame:
    """``part`` and ``joined``: which key every key of ``sets`` (unit, key, size, grams) is linked to."""
    joined_schema = "unit bigint, part bigint, joined bigint"
    within = ["unit", "block"]

    def joined(level: DataFrame) -> DataFrame:
        alone = level.withColumn("part", F.col("key")).withColumn("side", F.lit(-1))
        return cut_lineage(alone.groupBy(*within).applyInPandas(_join_block(measure), joined_schema))

    level = _blocked(sets, 0, block_sets, block_grams)
    tied = joined(level)
    large = cut_lineage(level.where("blocks > 1").select(*sets.columns))
    units, left, salt = sized(cut_lineage(large.select("unit").distinct())), large.count(), 0
    if not left:
        return tied.select("part", "joined")
    found = tied
    while True:
        # the representatives of the parts that the blocks of a large unit were joined to
        heads = found.join(units, "unit", "left_semi").select("unit", F.col("joined").alias("key")).distinct()
        heads = cut_lineage(large.join(sized(cut_lineage(heads)), ["unit", "key"], "left_semi"))
        before, left, salt = left, heads.count(), salt + 1
        if left > ENOUGH * before or left == 0:
            break
        found = joined(_blocked(heads, salt, block_sets, block_grams))
        tied = tied.unionByName(found)
    return tied.unionByName(_across(large, tied, measure, block_sets, block_grams)).select("part", "joined")


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: key and n-grams of a set to one row for each n-gram."""
    for batch in sliced_by_bytes(batches, 1, SLICE_BYTES):
        keys, sets = batch.column(0), [np.frombuffer(g, np.int64) for g in batch.column(1).to_pylist()]
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array(np.concatenate(sets))], ["key", "gram"])


def _open(parts: DataFrame) -> DataFrame:
    """Sets of units in several parts, with the ``largest`` part of their unit."""
    counts = parts.groupBy("unit", "part").agg(F.count("*").alias("sets"))
    largest = counts.groupBy("unit").agg(
        F.max_by("part", F.struct("sets", "part")).alias("largest"), F.count("*").alias("parts_in")
    )
    return parts.join(sized(cut_lineage(largest.where("parts_in > 1").select("unit", "largest"))), "unit")


def _finer(parts: DataFrame, measure: Measure, block_sets: int, block_grams: int) -> DataFrame:
    """``parts`` of open units, with those units told apart further whose sets outside the largest part fill several blocks.

    Their sets were found by a quarter of the n-grams, of which too few may be their own. Now all
    n-grams count, and only those in several sets of such units: most sets have no partner left.
    """
    outside = parts.where("part <> largest").groupBy("unit").agg(F.count("*").alias("sets"), F.sum("size").alias("grams_in"))
    wide = cut_lineage(outside.where((F.col("sets") > block_sets) | (F.col("grams_in") > block_grams)).select("unit"))
    if wide.isEmpty():
        return parts
    wide = sized(wide)
    sets = cut_lineage(parts.join(wide, "unit", "left_semi").drop("unit", "largest"))
    sizes = sets.select("key", "size", F.col("size").alias("counted"))
    grams = sets.select("key", "grams").mapInArrow(_pairs_of, "key bigint, gram bigint")
    units = sized(cut_lineage(_units(_stars(sizes, grams, measure, F.lit(True)))))
    sets = sets.join(units, F.col("key") == F.col("node")).withColumnRenamed("component", "unit").drop("node")
    return parts.join(wide, "unit", "left_anti").unionByName(_open(cut_lineage(sets)))


def _across(sets: DataFrame, tied: DataFrame, measure: Measure, block_sets: int, block_grams: int) -> DataFrame:
    """Links between the blocks of units that are still in several parts.

    Units are told apart further first, see :func:`_finer`. Of two parts at least one is not the
    largest of its unit, so only the sets outside the largest parts are compared with all blocks. A group of copies with a third of all sets is copied once
    for every block of sets outside of it, and never compared with itself.
    """
    known = sized(components(tied, "part", "joined"))
    parts = sets.join(known, F.col("key") == F.col("node"), "left")
    parts = parts.withColumn("part", F.coalesce("component", "key")).drop("node", "component")
    parts = _finer(_open(parts), measure, block_sets, block_grams)
    outside = cut_lineage(parts.where("part <> largest").drop("largest"))
    probes = _blocked(outside, 0, block_sets, block_grams)
    every = _blocked(parts.drop("largest"), 0, block_sets, block_grams)

    def crossed(rows: DataFrame, others: DataFrame, own: str, other: str, side: int) -> DataFrame:
        number = sized(cut_lineage(others.select("unit", F.col("blocks").alias("_others")).distinct()))
        opposite = F.explode(F.sequence(F.lit(0), F.col("_others") - 1)).alias(other)
        rows = rows.withColumnRenamed("block", own).join(number, "unit")
        return rows.select("unit", own, opposite, F.lit(side).alias("side"), "key", "size", "part", "grams")

    pairs = crossed(probes, every, "probe_block", "block", 0)
    pairs = pairs.unionByName(crossed(every, probes, "block", "probe_block", 1))
    grouped = pairs.groupBy("unit", "probe_block", "block")
    return cut_lineage(grouped.applyInPandas(_join_block(measure), "unit bigint, part bigint, joined bigint"))


def _stars(sizes: DataFrame, grams: DataFrame, measure: Measure, counted: Column) -> DataFrame:
    """``key`` and ``low``, the least key that shares an n-gram of both prefixes.

    ``sizes`` has one row for each class: key, size, and how many of its n-grams are ``counted``,
    which is told by the given expression on ``gram``. ``grams`` are pairs of key and gram; they
    are dealt by gram once, and only those of several sets go on.
    """
    size = F.col("size")
    prefix = size - F.ceil(size * measure.percent / 100) + 1
    needs = sizes.groupBy("key").agg(
        F.count("*").alias("rows"), F.max(prefix).alias("prefix"), F.min("counted").alias("counted")
    )
    shared = grams.withColumn("sets", F.count("*").over(Window.partitionBy("gram"))).where("sets > 1")
    found = shared.join(needs, "key")
    by_order = Window.partitionBy("key").orderBy((~counted).cast("int"), "sets", "gram")
    whole = Window.partitionBy("key")
    place, known = F.row_number().over(by_order), F.sum(counted.cast("int")).over(whole)
    placed = found.select("gram", "key", "rows", "prefix", "counted", place.alias("place"), known.alias("known"))
    # counted n-grams of this set alone stand before the shared ones
    room = F.col("prefix") - (F.col("counted") - F.col("known"))
    inside = placed.where(~counted | (F.col("rows") > 1) | (F.col("place") <= room)).select("gram", "key")
    inside = cut_lineage(inside)
    ends = inside.groupBy("gram").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high")
    return inside.join(sized(cut_lineage(ends.select("gram", "low"))), "gram").select("key", "low").distinct()


def _units(stars: DataFrame) -> DataFrame:
    """``node`` and ``component`` of every set in a star."""
    tied = components(stars, "key", "low")
    return tied.unionByName(tied.select(F.col("component").alias("node"), "component").distinct())


def _candidates(profiles: DataFrame, measure: Measure) -> DataFrame:
    """``node`` and ``component``: units of sets that share an n-gram of both prefixes."""
    short = profiles.where(F.size("short") > 0).select("key", "size", F.col("size").alias("counted"), F.col("short").alias("grams"))
    quarter = F.pmod(F.col("gram"), F.lit(COUNTED)) == 0
    long = profiles.where(F.size("grams") > 0).select("key", "size", "counted", "grams")

    def stars(sets: DataFrame, counted: Column) -> DataFrame:
        return _stars(sets.drop("grams"), sets.select("key", F.explode("grams").alias("gram")), measure, counted)

    return _units(stars(short, F.lit(True)).unionByName(stars(long, quarter)))


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
    block_sets: int = BLOCK_SETS,
    block_grams: int = BLOCK_GRAMS,
) -> DataFrame:
    """Key, ``n_shingles`` and ``component_id``, the least key reachable over links, of every row."""
    measure = Measure(words, percent)
    rows = docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text"))
    profiles = stored(
        rows.mapInArrow(_profile(measure), "_key bigint, size bigint, set_key binary, short array<bigint>, counted bigint, grams array<bigint>"),
        "profiles",
    )
    known = profiles.where("_key IS NOT NULL AND size > 0")
    classes = cut_lineage(known.groupBy("set_key").agg(F.min("_key").alias("key")))
    copies = known.select("_key", "set_key").join(classes, "set_key").where("_key <> key")
    copies = cut_lineage(copies.select("_key", "set_key"))
    firsts = join_keys(known, copies, ["_key", "set_key"], "left_anti").withColumnRenamed("_key", "key")
    units = cut_lineage(_candidates(firsts.select("key", "size", "short", "counted", "grams"), measure))

    texts = join_keys(rows, units.withColumnRenamed("node", "_key"), ["_key"], "inner")
    texts = texts.select(F.col("component").alias("unit"), F.col("_key").alias("key"), "_text")
    sets = texts.mapInArrow(_sets(measure), "unit bigint, key bigint, size bigint, grams binary")
    sets = stored(sets.where("size > 0"), "sets")
    found = components(_links(sets, measure, block_sets, block_grams), "part", "joined")

    of_class = classes.join(found, F.col("key") == F.col("node"), "left")
    of_class = of_class.select("set_key", F.coalesce("component", "key").alias("component"))
    joined = profiles.select("_key", "size", "set_key").join(of_class, "set_key", "left")
    component = F.when(F.col("_key").isNotNull(), F.coalesce("component", "_key"))
    return joined.select(
        F.col("_key").alias(key), F.col("size").alias("n_shingles"), component.alias("component_id")
    )


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """The row with the least key of each group of linked texts, with all its columns.

    Rows are told apart by key and text, so unlike texts under one key are judged each by itself, and
    so are NULL keys, which come last. Texts without words are linked with nothing; all of them stay.
    """
    row = next(name for name in (f"_row{i}" for i in count()) if name not in docs.columns)
    rows = docs.withColumn(row, F.xxhash64(key, text))
    found = near_duplicates(rows.select(row, text), row, text, words, percent).where("n_shingles > 0")
    found = stored(found.select(row, "component_id"), "near")
    keys = rows.select(row, F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), F.col(row).alias("row")).alias("_order"))
    members = stored(found.distinct().join(keys.distinct(), row), "members")
    firsts = members.groupBy("component_id").agg(F.min("_order").alias("_first"), F.count("*").alias("_n"))
    firsts = sized(cut_lineage(firsts.where("_n > 1").select("component_id", F.col("_first.row").alias("_first"))))
    out = cut_lineage(members.join(firsts, "component_id").where(F.col(row) != F.col("_first")).select(row))
    rest = join_keys(rows, out, [row], "left_anti").select(*rows.columns)
    repeated = cut_lineage(found.groupBy(row).count().where("count > 1").select(row))
    if repeated.isEmpty():
        return rest.drop(row)
    once = join_keys(rest, repeated, [row], "left_anti").select(*rows.columns)
    again = join_keys(rest, repeated, [row], "left_semi").select(*rows.columns).dropDuplicates([key, text])
    return once.unionByName(again).drop(row)
