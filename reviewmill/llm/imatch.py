"""I-Match fingerprints over randomised lexicon subsets.

The lexicon holds the terms whose share of documents lies in a band: neither common nor rare. A
term with at least a share s of the documents takes s of them away, so the lexicon has at most
(mean distinct terms of a document) / s terms, whatever the size of the table: half a million for
250 terms and s = 1/2000. That bound lets it go to every task.

A fingerprint has several subsets of the lexicon, drawn by hash at falling rates, so that short
and long texts both have subsets that keep only a few of their terms. Of each subset, the sorted
distinct terms of the text that are in it are hashed. The likeness of two fingerprints is the
share of equal hashes at the rate that suits the two texts best (see :func:`likeness`).

For edited texts every document needs the next one by key. Blocks of ascending keys are shuffled
to tasks, each with a copy of the first row of the block after it, and a task walks its sorted
rows once; texts are compressed for the shuffle. Term counts are added up in tasks before they are shuffled.

Defined results
---------------
* Text NULL is empty. The next document of the last one is the first, also if it is the same.
* A text without lexicon terms has ``=`` and one hash of all its terms; it is like an equal
  fingerprint (1) and unlike any other (0). Texts without terms share one fingerprint.
* Keys may be repeated or NULL: NULLs come first, equal keys in order of a hash of the text.
* An empty table gives an empty result. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from reviewmill.llm.common import block_of, key_bounds, worker_cache

BAND = (1 / 2000, 1 / 10)
RATES = tuple(2.0**-i for i in range(2, 10))
SUBSETS_PER_RATE = 6
BLOCK_DOCS = 4_000
FLUSH_TERMS = 400_000
PACKED_AT_ONCE = 256
TERM = re.compile(r"\w+")
EMPTY = "-" * 8
LOWEST = -(1 << 63)


def terms_of(text: str) -> set[str]:
    return set(TERM.findall(text.lower()))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: documents of each term, added up until the table of terms is full."""
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(out, ["term", "docs"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                counts.update(terms_of(text))
            if len(counts) > FLUSH_TERMS:
                yield flush()
    if counts:
        yield flush()


def lexicon(docs: DataFrame, text: str = "text", band: tuple[float, float] = BAND) -> list[str]:
    """Sorted terms whose share of all documents lies in ``band``."""
    texts = docs.select(F.col(text).alias("text"))
    n = texts.count()
    counts = texts.mapInArrow(_count_terms, "term string, docs bigint").groupBy("term").agg(F.sum("docs").alias("docs"))
    inside = counts.where((F.col("docs") >= band[0] * n) & (F.col("docs") <= max(1.0, band[1] * n)))
    return sorted(inside.select("term").toArrow().column(0).to_pylist())


class Subsets:
    """Which subsets each lexicon term is in, and the fingerprint of a set of terms."""

    def __init__(self, terms: list[str], rates: tuple[float, ...], per_rate: int, seed: int):
        self.places = {term: place for place, term in enumerate(terms)}
        self.size = len(rates) * per_rate
        hashes, members = np.zeros(len(terms), "<u8"), []
        limits = [int(rate * (1 << 32)) for rate in rates]
        for place, term in enumerate(terms):
            raw = hashlib.blake2b(term.encode(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
            hashes[place] = int.from_bytes(raw, "little")
        for subset in range(self.size):
            mixed = (hashes + np.uint64(subset + 1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            inside = (mixed >> np.uint64(32)) < limits[subset // per_rate]
            members.append(np.flatnonzero(inside))
        place = np.concatenate(members) if members else np.zeros(0, int)
        subset = np.repeat(np.arange(self.size), [len(m) for m in members])
        order = np.lexsort((subset, place))
        self.subset = subset[order]
        self.first = np.searchsorted(place[order], np.arange(len(terms) + 1))
        self.hashes = hashes

    def fingerprint(self, terms: set[str]) -> str:
        """Of each subset, a hash of the sorted distinct terms in it."""
        found = sorted(place for place in map(self.places.get, terms) if place is not None)
        if not found:
            return "=" + hashlib.blake2b("\n".join(sorted(terms)).encode(), digest_size=16).hexdigest()
        places = np.array(found)
        starts, counts = self.first[places], self.first[places + 1] - self.first[places]
        each = np.repeat(places, counts)  # sorted terms, so sorted within every subset
        within = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
        subset = self.subset[np.repeat(starts, counts) + within]
        order = np.argsort(subset, kind="stable")
        raw = self.hashes[each[order]].tobytes()
        ends = (8 * np.searchsorted(subset[order], np.arange(self.size), side="right")).tolist()
        parts, start = [], 0
        for end in ends:
            parts.append(hashlib.blake2b(raw[start:end], digest_size=4).hexdigest() if end > start else EMPTY)
            start = end
        return "".join(parts)


def likeness(a: str, b: str, per_rate: int = SUBSETS_PER_RATE) -> float:
    """Share of equal hashes at the rate where it is highest.

    A rate counts if at least half of its subsets hold a term of either text; coarse subsets of a
    long text seldom survive an edit, and fine ones of a short text are empty. All subsets that
    hold a term, taken together, count as well.
    """
    if a[0] == "=" or b[0] == "=":
        return float(a == b)
    shares, equal, seen = [], 0, 0
    for start in range(0, len(a), 8 * per_rate):
        pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(start, min(start + 8 * per_rate, len(a)), 8)]
        held = [x == y for x, y in pairs if x != EMPTY or y != EMPTY]
        equal, seen = equal + sum(held), seen + len(held)
        if 2 * len(held) >= per_rate:
            shares.append(sum(held) / len(held))
    return max([*shares, equal / max(seen, 1)])


class Row(NamedTuple):
    key: int | None
    text: str
    fingerprint: str


NAMES = ["_key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _result(row: Row, after: Row, subsets: Subsets, per_rate: int) -> tuple:
    n = len(row.text)
    edited = row.text[: n - n // 4] + after.text[: n // 4]
    other = subsets.fingerprint(terms_of(edited))
    digest = hashlib.sha256(edited.encode()).hexdigest()
    near = likeness(row.fingerprint, other, per_rate), likeness(row.fingerprint, after.fingerprint, per_rate)
    return row.key, n, digest, row.fingerprint, other, *near


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: texts compressed for the shuffle, with a hash for the order of equal keys."""
    press = zstandard.ZstdCompressor(level=3, write_checksum=False)
    for batch in batches:
        for start in range(0, batch.num_rows, PACKED_AT_ONCE):
            some = batch.slice(start, PACKED_AT_ONCE)
            raw = [(t or "").encode() for t in some.column(1).to_pylist()]
            hashes = [hashlib.blake2b(r, digest_size=8).digest() for r in raw]
            arrays = [some.column(0), pa.array(hashes, pa.binary()), pa.array(map(press.compress, raw), pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["_key", "hash", "packed"])


def _walk(shared, rates: tuple[float, ...], per_rate: int, seed: int):
    """Task function: sorted rows of (block, copy of the next block's first row?, key, text)."""
    version = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subsets = worker_cache("imatch", lambda: Subsets(shared.value, rates, per_rate, seed), version)
        unpress = zstandard.ZstdDecompressor()
        block, ended, last = None, False, None
        for batch in batches:
            out = []
            for number, copied, key, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if number != block:
                    block, ended, last = number, False, None
                if ended:
                    continue  # further rows with the next block's first key
                text = unpress.decompress(packed).decode()
                row = Row(key, text, subsets.fingerprint(terms_of(text)))
                if last is not None:
                    out.append(_result(last, row, subsets, per_rate))
                last, ended = row, bool(copied)
            if out:
                arrays = [pa.array(list(c), t) for c, t in zip(zip(*out), TYPES)]
                yield pa.RecordBatch.from_arrays(arrays, NAMES)

    return run


def fingerprint_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    band: tuple[float, float] = BAND,
    rates: tuple[float, ...] = RATES,
    per_rate: int = SUBSETS_PER_RATE,
    seed: int = 1,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near they are (see the module)."""
    rows = docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text"))
    order = F.coalesce("_key", F.lit(LOWEST))
    bounds = key_bounds(rows, "_key", F.lit(1), block_docs)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(rows, "_text", band))
    blocks = rows.select(block_of(F.col("_key"), bounds).alias("block"), order.alias("key"))
    firsts = sorted(tuple(r) for r in blocks.groupBy("block").agg(F.min("key")).collect())
    numbers = [block for block, _ in firsts]
    copies = F.lit(None).cast("int")  # the block that a block's first row is copied to
    if firsts:
        before = dict(zip(numbers, [numbers[-1], *numbers]))
        spread = range(numbers[-1] + 1)
        first_of = dict(firsts)
        keys = F.expr("array(" + ",".join(_long(first_of.get(b)) for b in spread) + ")")
        to = F.expr("array(" + ",".join(str(before.get(b, -1)) for b in spread) + ")")
        at = F.col("block") + 1
        copies = F.when(F.element_at(keys, at) == F.col("order"), F.element_at(to, at))
    packed = rows.mapInArrow(_packed, "_key bigint, hash binary, packed binary")
    placed = packed.select(block_of(F.col("_key"), bounds).alias("block"), order.alias("order"), "_key", "hash", "packed")
    own = F.struct(F.col("block").alias("block"), F.lit(0).alias("copied"))
    copy = F.struct(copies.alias("block"), F.lit(1).alias("copied"))
    both = F.filter(F.array(own, copy), lambda x: x.block.isNotNull())
    dealt = placed.select(F.explode(both).alias("to"), "order", "_key", "hash", "packed")
    dealt = dealt.select("to.block", "to.copied", "order", "_key", "hash", "packed")
    sorted_rows = dealt.repartitionById(len(bounds) + 1, "block").sortWithinPartitions("block", "copied", "order", "hash")
    schema = (
        "_key bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    walked = sorted_rows.select("block", "copied", "_key", "packed")
    return walked.mapInArrow(_walk(shared, rates, per_rate, seed), schema).withColumnRenamed("_key", key)


def _long(value: int | None) -> str:
    if value is None:
        return "CAST(NULL AS bigint)"
    return f"CAST('{value}' AS bigint)"
