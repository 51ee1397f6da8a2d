"""Periodic runs of words, found over a Re-Pair grammar of the word ids.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are identical), of length
``max(6, 4 * q)`` at least, that no neighbouring word extends.

The words of a slice of texts get numbers, and the most frequent pair of neighbouring symbols is
replaced by a nonterminal, over and over (Re-Pair). Counting is done once a round: all repeated
pairs of the round are replaced in the order of their frequency class (powers of two, then a
hash), each where neither of its symbols is taken, so a round leaves no replaced pair behind and a
nonterminal is made only once. What no longer repeats is paired up to one symbol for each text.
Pairs never reach over two texts, but texts of a slice share nonterminals: a passage that many of
them repeat is looked into once.

A run of a text reaches over the boundary between the two halves of exactly one node of its
derivation, the lowest that holds it, and lies in it whole. So for every nonterminal the runs over
its boundary are computed once, within its own words; each has two periods on one side of the
boundary, which leaves few candidate periods, and two hashed binary searches give its ends. The
found runs are translated to every position of the derivation, and stretches that were cut at
the edge of a nonterminal are merged with the longer ones of the same period. Hashes only bound
the search: each stretch is compared word by word, and a wrong one starts it anew with another base.

Texts are cut into slices by bytes, so a task holds a slice or one long text, about 150 bytes a
word; no rows are shuffled.

Defined results
---------------
* Text NULL, empty or of white space only: no words, no run, ``collapsed`` is empty.
* Keys may be NULL or repeated: every row is answered by itself; the order of rows is kept.
* Among the longest runs the least start, then the least period is ``longest``; NULL without a run.
* Words are bytes between ASCII white space, so text in any script has a defined result.
* An empty table gives an empty result. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reviewmill.llm.common import sliced_by_bytes

SHORTEST = 6
EXPONENT = 4
SLICE_BYTES = 2_000_000
FLAT = 1 << 20  # candidate periods looked at together
PRIME = (1 << 31) - 1
MIX = 0x9E3779B97F4A7C15
WORD = r"[^\x20\x09-\x0D]+"


class _Prefixes:
    """Hashes of all stretches of ``words``."""

    def __init__(self, words: np.ndarray, base: int):
        n = len(words)
        powers = np.ones(n + 1, dtype=np.int64)
        step, done = base, 1
        while done <= n:
            more = min(done, n + 1 - done)
            powers[done : done + more] = powers[:more] * step % PRIME
            step, done = step * step % PRIME, 2 * done
        self.powers = powers
        self.sums = np.zeros(n + 1, dtype=np.int64)
        np.cumsum((words + 1) % PRIME * powers[:n] % PRIME, out=self.sums[1:])
        self.sums %= PRIME

    def equal(self, low: np.ndarray, shift: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches at ``low`` and ``low + shift`` look equal."""
        near = (self.sums[low + length] - self.sums[low]) % PRIME
        far = (self.sums[low + shift + length] - self.sums[low + shift]) % PRIME
        return near * self.powers[shift] % PRIME == far

    def reach(self, at: np.ndarray, shift: np.ndarray, most: np.ndarray, ahead: bool) -> np.ndarray:
        """How many words from ``at`` on (or before it) equal those ``shift`` later."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(at if ahead else at - middle, shift, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def _flat(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(node, period)`` for the periods from 1 to ``counts`` of each node, a part at a time."""
    nodes = np.flatnonzero(counts > 0)
    sizes = counts[nodes]
    ends = np.cumsum(sizes)
    start = 0
    while start < len(nodes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + FLAT, "right")))
        some = sizes[start:stop]
        first = np.cumsum(some) - some
        yield np.repeat(nodes[start:stop], some), np.arange(some.sum()) - np.repeat(first, some) + 1
        start = stop


def _joined(parts: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate(part) for part in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3


def _candidates(words: np.ndarray, s: np.ndarray, b: np.ndarray, e: np.ndarray):
    """Node, period and a place of possible runs over the boundaries ``b`` of ``[s, e)``.

    A run of four periods has two of them on one side of the boundary, so the word next to the
    boundary, and its neighbours, occur again one period on.
    """
    found = []
    most = np.where(e - s >= SHORTEST, (e - s) // EXPONENT, 0)
    for right in (True, False):
        side = np.minimum(most, (e - b if right else b - s) // 2)
        for node, q in _flat(side):
            at = b[node]
            if not right:
                at = at - q
            for step in (0, -1, 1 if right else -2):
                near = at + np.where(q > 1, step, max(step, -1) if step < 0 else 0)
                keep = words[near] == words[near + q]
                node, q, at = node[keep], q[keep], at[keep]
            found.append((node, q, at))
    return _joined(found)


def _crossing(words: np.ndarray, prefixes, s: np.ndarray, b: np.ndarray, e: np.ndarray):
    """Node, start, end and period of the runs over each boundary, in words of the slice."""
    node, q, at = _candidates(words, s, b, e)
    if not len(node):
        return node, node, node, node
    hashed = prefixes()
    low = at - hashed.reach(at, q, at - s[node], ahead=False)
    high = at + hashed.reach(at, q, e[node] - at - q, ahead=True) + q
    long = high - low >= np.maximum(SHORTEST, EXPONENT * q)
    node, low, high, q = node[long], low[long], high[long], q[long]
    order = np.lexsort((q, high, low, node))
    node, low, high, q = node[order], low[order], high[order], q[order]
    first = np.ones(len(node), dtype=bool)  # of one stretch the smallest period counts
    first[1:] = (node[1:] != node[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return node[first], low[first], high[first], q[first]


def _chosen(keys: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the repeated pairs, at ascending places ``at``, are replaced.

    The greatest pair next to no greater one, then the greatest of those it left free, and so on.
    Where a symbol follows itself, every second pair is taken.
    """
    mixed = keys.astype(np.uint64) * np.uint64(MIX)
    rank = (np.frexp(counts.astype(np.float64))[1].astype(np.uint64) << np.uint64(56)) | (mixed >> np.uint64(8))
    taken = []
    while len(at):
        apart = at[1:] - at[:-1] != 1
        new = np.ones(len(at), dtype=bool)  # a plateau of equal pairs starts here
        new[1:] = apart | (rank[1:] != rank[:-1])
        starts = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        even = (np.arange(len(at)) - starts) % 2 == 0
        below_left = np.ones(len(at), dtype=bool)
        below_left[1:] = apart | (rank[1:] >= rank[:-1])
        below_right = np.ones(len(at), dtype=bool)
        below_right[:-1] = apart | (rank[:-1] >= rank[1:])
        picked = even & below_left & below_right
        taken.append(at[picked])
        blocked = picked.copy()
        blocked[1:] |= picked[:-1] & ~apart
        blocked[:-1] |= picked[1:] & ~apart
        at, rank = at[~blocked], rank[~blocked]
    return np.sort(np.concatenate(taken)) if taken else at


def _may_repeat(keys: np.ndarray) -> np.ndarray:
    """False only for keys that occur once: nothing else falls into their bucket."""
    bits = max(8, len(keys).bit_length() + 1)
    buckets = (keys.astype(np.uint64) * np.uint64(MIX) >> np.uint64(64 - bits)).astype(np.int64)
    return np.bincount(buckets, minlength=1 << bits)[buckets] > 1


def _derivations(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
    """Round by round: ``(s, b, e)`` of one place of each new nonterminal; nonterminal and start of all places.

    ``starts`` and ``ends`` cut ``words`` into texts.
    """
    symbols, places = words.copy(), np.arange(len(words))
    stops = np.empty(len(words), dtype=np.int64)  # where a symbol ends
    stops[:] = places + 1
    last = np.zeros(len(words), dtype=bool)
    last[ends[ends > starts] - 1] = True
    fresh = int(words.max()) + 1 if len(words) else 0
    repeats = True
    while not last.all():
        if repeats:
            often = np.bincount(symbols) > 1
            pairs = np.flatnonzero(~last[:-1] & often[symbols[:-1]] & often[symbols[1:]])
            keys = symbols[pairs] * fresh + symbols[pairs + 1]
            shared = _may_repeat(keys)
            pairs, keys = pairs[shared], keys[shared]
            unique, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
            twice = counts[which] > 1
            chosen = _chosen(keys[twice], counts[which][twice], pairs[twice])
            repeats = len(chosen) > 0
            if not repeats:
                continue
            names = which[np.searchsorted(pairs, chosen)]
            used = np.zeros(len(unique), dtype=bool)
            used[names] = True
            names = (np.cumsum(used) - 1)[names]
        else:  # pair up neighbours from the start of each text
            heads = np.ones(len(symbols), dtype=bool)
            heads[1:] = last[:-1]
            offset = np.arange(len(symbols)) - np.maximum.accumulate(np.where(heads, np.arange(len(symbols)), 0))
            chosen = np.flatnonzero((offset % 2 == 0) & ~last)
            names = np.arange(len(chosen))
        sample = np.empty(names.max() + 1, dtype=np.int64)
        sample[names[::-1]] = chosen[::-1]
        yield places[sample], places[sample + 1], stops[sample + 1], names, places[chosen]
        symbols[chosen] = fresh + names
        stops[chosen], last[chosen] = stops[chosen + 1], last[chosen + 1]
        kept = np.ones(len(symbols), dtype=bool)
        kept[chosen + 1] = False
        symbols, places, stops, last = symbols[kept], places[kept], stops[kept], last[kept]
        fresh += len(sample)


def _merged(low: np.ndarray, high: np.ndarray, q: np.ndarray):
    """Stretches of one period that share at least a period of words, as one; by start, then period."""
    if not len(low):
        return low, high, q
    order = np.lexsort((-high, low, q))
    low, high, q = low[order], high[order], q[order]
    group = np.concatenate([[0], np.cumsum(q[1:] != q[:-1])])
    reach = np.maximum.accumulate(high + group * (high.max() + 1)) - group * (high.max() + 1)
    new = np.ones(len(low), dtype=bool)
    new[1:] = (q[1:] != q[:-1]) | (low[1:] + q[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(low)]]) - 1
    low, high, q = low[first], reach[last], q[first]
    order = np.lexsort((q, low))
    return low[order], high[order], q[order]


def _expand(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from ``first`` on, ``lengths`` of them, of all entries."""
    before = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) - np.repeat(before, lengths) + np.repeat(first, lengths)


def _holds(words: np.ndarray, low: np.ndarray, high: np.ndarray, q: np.ndarray) -> bool:
    """Whether the words of every stretch equal those one period on."""
    for start in range(0, len(low), 4096):
        part = slice(start, start + 4096)
        at = _expand(low[part], high[part] - low[part] - q[part])
        if not (words[at] == words[at + np.repeat(q[part], high[part] - low[part] - q[part])]).all():
            return False
    return True


def find_runs(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of the texts ``words[starts:ends]``, by start, then period."""
    base = 1_000_003
    while True:
        made: list[_Prefixes] = []

        def prefixes() -> _Prefixes:
            if not made:
                made.append(_Prefixes(words, base))
            return made[0]

        found, sound = [], True
        for s, b, e, names, places in _derivations(words, starts, ends):
            node, low, high, q = _crossing(words, prefixes, s, b, e)
            if not len(node):
                continue
            if not _holds(words, low, high, q):
                sound = False
                break
            first = np.searchsorted(node, np.arange(len(s)))
            runs = np.searchsorted(node, np.arange(len(s)), "right") - first
            each = _expand(first[names], runs[names])
            shift = np.repeat(places - s[names], runs[names])
            found.append((low[each] + shift, high[each] + shift, q[each]))
        if sound:
            return _merged(*_joined(found))
        base = base * 48_271 % PRIME


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _answer(texts: list[bytes | None]) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed text of each text of a slice."""
    split = [(text or b"").split() for text in texts]  # bytes are split at ASCII white space only
    sizes = np.array([len(words) for words in split], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    words = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
    low, high, q = find_runs(words, starts, ends)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, low + q, 1)
    np.add.at(covered, high, -1)
    kept = np.cumsum(covered)[:-1] == 0
    texts_of = np.searchsorted(ends, low, "right")
    offsets = np.searchsorted(texts_of, np.arange(len(split) + 1))
    touched = np.diff(offsets) > 0
    collapsed = [
        b" ".join(compress(words, kept[start:end])) if some else b" ".join(words)
        for words, start, end, some in zip(split, starts, ends, touched)
    ]
    fields = [pa.array(values) for values in (low - starts[texts_of], high - low, q)]
    runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(RUN)))
    return runs, pa.array(collapsed, pa.binary()).cast(pa.string())


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: key and text to key, runs and collapsed text."""
    for batch in sliced_by_bytes(batches, 1, SLICE_BYTES):
        runs, collapsed = _answer(batch.column(1).cast(pa.binary()).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), runs, collapsed], ["key", "runs", "collapsed"])


def runs_of(docs: DataFrame, key: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """Key, ``runs`` by start and period, ``longest`` of them, and the text ``collapsed``.

    Collapsed are the words that no run has after its first period, joined by one space.
    """
    rows = docs.select(F.col(key).alias("key"), (F.col(text) if isinstance(text, str) else text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    run = "struct<start: bigint, length: bigint, period: bigint>"
    found = rows.mapInArrow(_tasks, f"key {kind}, runs array<{run}>, collapsed string")
    ranked = F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"]))
    best = F.array_max(ranked)
    longest = F.when(
        F.size("runs") > 0,
        F.struct((-best["col2"]).alias("start"), best["length"].alias("length"), (-best["col3"]).alias("period")),
    )
    return found.select(F.col("key").alias(key), "runs", longest.alias("longest"), "collapsed")


def looped(text: Column, start: Column, period: Column) -> Column:
    """``text`` whose words from number ``start`` on repeat the first ``period`` of them."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    rest = F.size(words) - start
    cycle = F.slice(words, start + 1, period)
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil(rest / period).cast("int"))), F.lit(1), rest)
    return F.array_join(F.concat(F.slice(words, F.lit(1), start), tail), " ")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))
