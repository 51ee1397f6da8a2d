"""Sequences of bounded length by best-fit packing in a tree.

Texts become token ids in tasks. Longer documents are cut into whole sequences and one rest at
their start, so only rests and short documents have to be packed. Hashed chunks of items pack
themselves best-fit, longest first. Bins that are nearly full are finished; of the others the
emptiest are handed up, at most ``up_bins`` from a group, where the bins of several groups are
items of the next best-fit round. Chunks are alike, being hashed, so what is left in one finds
its match above, and no task gets more than ``fan_in * up_bins`` bins however large the table.

A bin carries its members as packed records, so nothing is joined back.

Defined results
---------------
* Text NULL is empty: one piece that holds the end id alone. Longer texts are never shortened.
* Row keys may be NULL or repeated; each row is a document of its own.
* An empty table gives an empty result. Columns other than the named ones are ignored.
* The result depends on the rows alone, not on their order or on the number of partitions.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reviewmill.llm import word_ids
from reviewmill.llm.common import sliced, worker_cache
from reviewmill.session import cut_lineage

CAPACITY = 2048
CHUNK_ITEMS = 20_000
FAN_IN = 8
UP_BINS = 2_000
SLACK = 16

ITEM = np.dtype(
    [("key", "<i8"), ("null", "u1"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")]
)
PIECES = pa.schema(
    [
        ("_key", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("ids", pa.binary()),
    ]
)


def _cut(path: str, end: bytes, capacity: int, with_ids: bool):
    """Task function: the pieces of every document of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(f"spaced:{path}", lambda: word_ids.SpacedWords(path))
        for batch in sliced(batches):
            rows: list[list] = [[] for _ in PIECES]
            keys = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for key, ids in zip(keys, encoder.encode(texts)):
                ids += end
                n = len(ids) // 4
                starts = [0, *range(n % capacity or capacity, n, capacity)]
                for number, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    part = ids[4 * a : 4 * b]
                    row = (key, number, a, b - a, zlib.crc32(part), part if with_ids else None)
                    for column, value in zip(rows, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, PIECES)], schema=PIECES)

    return run


def cut_documents(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids: key, ``piece``, ``start``, ``length``, ``ids_crc32``, ``ids``.

    ``ids`` (little-endian unsigned 32-bit) is NULL unless asked for.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text"))
    end = np.uint32(end_id).tobytes()
    schema = "_key bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
    return rows.mapInArrow(_cut(tokenizer, end, capacity, with_ids), schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Positions of the items in each bin; an item goes where it leaves the least room.

    Bins are listed by the room they have. Which rooms occur is a bit mask, so the smallest
    room that is enough is its lowest set bit.
    """
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        length = lengths[item]
        enough = rooms >> length << length
        if enough:
            room = (enough & -enough).bit_length() - 1
            found = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[found].append(item)
        else:
            room, found = capacity, len(bins)
            bins.append([item])
        by_room[room - length].append(found)
        if room > length:
            rooms |= 1 << (room - length)
    return bins


def _bins(loads: list[int], members: list[bytes], ids: tuple[int, int], limits: tuple[int, int, int], last: bool):
    """Bins of one group: number, load, members and whether they are finished."""
    level, group = ids
    capacity, slack, up_bins = limits
    found = best_fit(loads, capacity)
    load = [sum(loads[i] for i in b) for b in found]
    under = sorted((b for b in range(len(found)) if load[b] < capacity - slack), key=lambda b: (load[b], b))
    handed = set() if last else set(under[:up_bins])
    return pd.DataFrame(
        {
            "bin": [level << 56 | group << 24 | b for b in range(len(found))],
            "node": group,
            "load": load,
            "members": [b"".join(members[i] for i in b) for b in found],
            "done": [b not in handed for b in range(len(found))],
        }
    )


def _pack_items(limits: tuple[int, int, int], last: bool):
    """Group function: bins of the items of one chunk."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_key", "piece", "ids_crc32", "length"], kind="stable")
        items = np.zeros(len(pdf), dtype=ITEM)
        items["null"] = pdf["_key"].isna()
        items["key"] = pdf["_key"].fillna(0).astype("int64")
        for name, column in (("piece", "piece"), ("start", "start"), ("length", "length"), ("crc", "ids_crc32")):
            items[name] = pdf[column].to_numpy()
        raw = items.tobytes()
        members = [raw[i : i + ITEM.itemsize] for i in range(0, len(raw), ITEM.itemsize)]
        return _bins(items["length"].tolist(), members, (0, int(pdf["node"].iloc[0])), limits, last)

    return run


def _pack_bins(level: int, limits: tuple[int, int, int], last: bool):
    """Group function: bins of the bins handed up to one node."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        ids = (level, int(pdf["node"].iloc[0]))
        return _bins(pdf["load"].tolist(), pdf["members"].tolist(), ids, limits, last)

    return run


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Task function: the pieces in finished bins with their places."""
    for pdf in batches:
        if not len(pdf):
            continue
        counts = pdf["members"].str.len() // ITEM.itemsize
        items = np.frombuffer(b"".join(pdf["members"]), dtype=ITEM)
        lengths = items["length"].astype("int64")
        ends = np.cumsum(lengths)
        before = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)[:-1]])]
        keys = pd.Series(items["key"].astype("int64"), dtype="Int64").mask(items["null"].astype(bool))
        yield pd.DataFrame(
            {
                "_key": keys,
                "piece": items["piece"],
                "start": items["start"],
                "length": lengths,
                "ids_crc32": items["crc"].astype("int64"),
                "sequence_id": np.repeat(pdf["bin"].to_numpy(), counts),
                "offset": ends - lengths - np.repeat(before, counts),
            }
        )


def pack(
    pieces: DataFrame,
    capacity: int = CAPACITY,
    chunk_items: int = CHUNK_ITEMS,
    fan_in: int = FAN_IN,
    up_bins: int = UP_BINS,
    slack: int = SLACK,
) -> DataFrame:
    """``pieces`` (of :func:`cut_documents`) with ``sequence_id`` and ``offset``.

    A sequence number holds the level, the group and the bin within it.
    """
    pieces = cut_lineage(pieces.select("_key", "piece", "start", "length", "ids_crc32"))
    nodes = max(1, math.ceil(pieces.count() / chunk_items))
    limits, level = (capacity, slack, up_bins), 0
    schema = "bin bigint, node bigint, load bigint, members binary, done boolean"
    chunk = F.pmod(F.xxhash64("_key", "piece", "ids_crc32"), F.lit(nodes))
    rows = pieces.withColumn("node", chunk).groupBy("node")
    bins = cut_lineage(rows.applyInPandas(_pack_items(limits, nodes == 1), schema))
    finished = bins.where("done")
    while nodes > 1:
        nodes, level = math.ceil(nodes / fan_in), level + 1
        handed = bins.where("NOT done").withColumn("node", F.floor(F.col("node") / fan_in).cast("bigint"))
        task = _pack_bins(level, limits, nodes == 1)
        bins = cut_lineage(handed.groupBy("node").applyInPandas(task, schema))
        finished = finished.unionByName(bins.where("done"))
    out = "_key bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return finished.select("bin", "members").mapInPandas(_unpack, out)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    capacity: int = CAPACITY,
    **packing: int,
) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    found = pack(cut_documents(docs, tokenizer, key, text, end_id, capacity), capacity, **packing)
    return found.withColumnRenamed("_key", key)
