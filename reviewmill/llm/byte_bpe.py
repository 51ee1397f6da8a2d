"""Byte-level BPE with Spark's higher-order functions; decoding by concatenating pieces.

Tasks gather texts into rows of bounded size. A row has the distinct pre-tokens of its texts, and
places: which pre-tokens make up a distinct word, and which words a text. Spark folds the merges
over the distinct pre-tokens: a pre-token is a string with one character for each piece, at first
a piece for each byte. ``aggregate`` looks up every pair of neighbours and, as long as one is
ranked, puts the piece of the lowest rank in place of its pair, the leftmost of equals. The rank
map is an array of small maps entered by a hash of the pair, since Spark looks through a map from
its start; it is one row, broadcast, so an executor reads it once and not every task anew. Characters
are in the order of the ranks, so the least character is the lowest rank. The ids are then laid out by
the places.

Decoding looks every id up in a literal array of pieces and joins them.

Nothing is shuffled, rank map and pieces are as large as the vocabulary, and a task holds one row at a
time; a text longer than the bound has a row of its own. The fold takes the square of the length
of a pre-token, so those above ``LONG_BYTES`` (a run of one character, say) are encoded by the
tiktoken library instead, which gives the same ids.

Defined results
---------------
* Text NULL is empty and has no ids.
* Rows with NULL or repeated keys are encoded like any other; an empty table gives no rows.
* Columns other than the named ones are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewmill.llm import word_ids
from reviewmill.llm.common import worker_cache

ROW_CHARS = 10_000_000
SLOTS = 1 << 17
FIRST_LETTER = 0x100
DONE = "\x01"  # no piece has this letter
LONG_BYTES = 160
OUT_TEXTS = 256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def _letter(rank: int) -> str:
    """One character for a piece; ascending, and clear of control characters and surrogates."""
    code = rank + FIRST_LETTER
    return chr(code if code < 0xD800 else code + 0x800)


def _ranks_of(letters: str) -> np.ndarray:
    codes = np.frombuffer(letters.encode("utf-32-le"), "<u4")
    return (codes - np.where(codes < 0xD800, FIRST_LETTER, FIRST_LETTER + 0x800)).astype("<u4")


def _slot(pair: Column) -> Column:
    return F.pmod(F.hash(pair), F.lit(SLOTS))


def rank_map(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """Merged piece by pair of pieces as one row ``ranks``: an array of maps, entered by the pair's hash."""
    rows = [
        (_letter(ranks[piece[:cut]]) + _letter(ranks[piece[cut:]]), _letter(rank))
        for piece, rank in ranks.items()
        for cut in range(1, len(piece))
        if piece[:cut] in ranks and piece[cut:] in ranks
    ]
    pairs = spark.createDataFrame(pa.table({"pair": [r[0] for r in rows], "piece": [r[1] for r in rows]}))
    slots: list[dict[str, str]] = [{} for _ in range(SLOTS)]
    for row in pairs.withColumn("slot", _slot(F.col("pair"))).toArrow().to_pylist():
        slots[row["slot"]][row["pair"]] = row["piece"]
    maps = pa.array([[list(s.items()) for s in slots]], pa.list_(pa.map_(pa.string(), pa.string())))
    return spark.createDataFrame(pa.table({"ranks": maps}))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once; lambdas do not share common parts by themselves.

    As the end of a fold over nothing, which unlike ``transform`` does not copy what it returns.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


def merge(word: Column, ranks: Column) -> Column:
    """The pieces of one pre-token, a character each, after all merges.

    A word without ranked pairs gets the sign ``DONE`` at its end, so further steps leave it alone.
    """
    rest, done = F.lit(1 << 30), F.lit(DONE)

    def made(pair: Column) -> Column:
        return F.element_at(F.get(ranks, _slot(pair)), pair)

    def join(word: Column, pairs: Column, lowest: Column) -> Column:
        # array_position leaves its loop by an exception, which takes longer than all else
        place = F.instr(F.array_join(pairs, "", DONE), lowest)
        return _let(
            place, lambda at: F.concat(F.substring(word, F.lit(1), at - 1), lowest, F.substring(word, at + 2, rest))
        )

    def choose(word: Column, pairs: Column) -> Column:
        return _let(
            F.array_min(pairs),
            lambda lowest: F.when(lowest.isNull(), F.concat(word, done)).otherwise(join(word, pairs, lowest)),
        )

    def step(word: Column, _: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(word) - 1)
        neighbours = F.transform(places, lambda i: F.substring(word, i, F.lit(2)))
        ended = F.endswith(word, done) | (F.length(word) < 2)
        return F.when(ended, word).otherwise(_let(F.transform(neighbours, made), lambda p: choose(word, p)))

    def finish(word: Column) -> Column:
        return F.when(F.endswith(word, done), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)

    steps = F.sequence(F.lit(2), F.length(word))
    return F.when(F.length(word) < 2, word).otherwise(F.aggregate(steps, word, step, finish))


class _Row:
    """Distinct pre-tokens and words of some texts, and the places of both."""

    def __init__(self, pattern, ranks: dict[bytes, int]):
        self.pattern, self.ranks = pattern, ranks
        self.byte_letters = {b: _letter(ranks[bytes([b])]) for b in range(256)}
        self.tokens: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.word_sizes, self.word_tokens = array("i"), array("i")
        self.keys: list = []
        self.text_sizes, self.text_words = array("i"), array("i")
        self.chars = 0

    def _learn(self, word: str) -> None:
        text = word[1:] if word[0] == "\r" else word if word[0] == "\n" else " " + word
        # letters alone, with a space before them or not, are one pre-token
        found = [text] if word.isalpha() else self.pattern.findall(text)
        self.word_sizes.append(len(found))
        for token in found:
            self.word_tokens.append(self.tokens.setdefault(token, len(self.tokens)))
        self.words[word] = len(self.words)

    def add(self, key, text: str) -> None:
        words = word_ids.spaced_words(text)
        if words is None:  # "\r" marks words to be taken as they are
            words = ["\r" + text] if text else []
        else:
            words[0] = "\r" + words[0][1:]
        for word in set(words).difference(self.words):
            self._learn(word)
        self.keys.append(key)
        self.text_sizes.append(len(words))
        self.text_words.extend(map(self.words.__getitem__, words))
        self.chars += len(text)

    def _letters(self, token: bytes) -> str:
        """A letter for each byte, one alone for a token that is a piece, none for a long one."""
        if token in self.ranks:
            return _letter(self.ranks[token])
        return token.decode("latin-1").translate(self.byte_letters) if len(token) <= LONG_BYTES else ""

    def batch(self) -> pa.RecordBatch:
        raw = [t.encode() for t in self.tokens]
        letters = [self._letters(t) for t in raw]
        long_ones = [t for t, r in zip(self.tokens, raw) if len(r) > LONG_BYTES and r not in self.ranks]
        columns = [
            pa.array([self.keys], pa.list_(pa.int64())),
            pa.array([letters], pa.list_(pa.string())),
            pa.array([long_ones], pa.list_(pa.string())),
            pa.array([_pack(self.word_sizes, self.word_tokens)], pa.binary()),
            pa.array([_pack(self.text_sizes, self.text_words)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["keys", "tokens", "long_tokens", "of_word", "of_text"])


def _pack(sizes: array, values: array) -> bytes:
    """Number of lists, their lengths, and their values, as 32-bit integers."""
    return array("i", [len(sizes)]).tobytes() + sizes.tobytes() + values.tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the lists (one more than there are) and their values."""
    numbers = np.frombuffer(raw, "<i4")
    n = int(numbers[0])
    return np.concatenate([[0], np.cumsum(numbers[1 : n + 1], dtype=np.int64)]), numbers[n + 1 :]


def _gather(path: str, pattern: str, row_chars: int):
    """Task function: texts in rows of about ``row_chars`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled = regex.compile(pattern)
        ranks = worker_cache(f"ranks:{path}", lambda: read_ranks(path))
        row = _Row(compiled, ranks)
        for batch in batches:
            for start in range(0, batch.num_rows, OUT_TEXTS):
                some = batch.slice(start, OUT_TEXTS)
                for key, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    row.add(key, text or "")
                    if row.chars >= row_chars:
                        yield row.batch()
                        row = _Row(compiled, ranks)
        if row.keys:
            yield row.batch()

    return run


def _library(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def _lists(starts: np.ndarray, values: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen lists one after the other: their lengths and all values."""
    lengths = starts[chosen + 1] - starts[chosen]
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return lengths, values[np.repeat(starts[chosen], lengths) + within]


def _lay_out(path: str, pattern: str):
    """Task function: ids of every text of a row, by the ids of its pre-tokens."""
    names = ["_key", "ids", "ids_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = batch.column(0)[i].as_py()
                folded = batch.column(1).slice(i, 1).flatten()
                starts = np.concatenate([[0], np.cumsum(pc.utf8_length(folded).to_numpy(), dtype=np.int64)])
                values = _ranks_of("".join(folded.to_pylist()))
                long_tokens = batch.column(2)[i].as_py()
                if long_tokens:
                    library = worker_cache(f"tiktoken:{path}", lambda: _library(path, pattern))
                    lists = np.split(values, starts[1:-1])
                    found = iter(long_tokens)
                    empty = np.flatnonzero(starts[1:] == starts[:-1])
                    for place, token in zip(empty.tolist(), found):
                        lists[place] = np.array(library.encode_ordinary(token), "<u4")
                    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
                    values = np.concatenate(lists)
                word_starts, word_tokens = _unpack(batch.column(3)[i].as_py())
                lengths, ids = _lists(starts, values, word_tokens)
                cum = np.concatenate([[0], np.cumsum(lengths)])
                id_starts = cum[word_starts]
                text_starts, text_words = _unpack(batch.column(4)[i].as_py())
                for first in range(0, len(keys), OUT_TEXTS):
                    last = min(first + OUT_TEXTS, len(keys))
                    words = text_words[text_starts[first] : text_starts[last]]
                    sizes, out = _lists(id_starts, ids, words)
                    cuts = np.concatenate([[0], np.cumsum(sizes)])[text_starts[first : last + 1] - text_starts[first]]
                    raw = out.astype("<u4").tobytes()
                    digests = [
                        hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())
                    ]
                    lists_of_ids = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(out.astype(np.int32)))
                    arrays = [pa.array(keys[first:last], pa.int64()), lists_of_ids, pa.array(digests)]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", row_chars: int = ROW_CHARS
) -> DataFrame:
    """Key, ``ids`` and ``ids_sha256`` (of little-endian unsigned 32-bit integers) of every text."""
    spark = docs.sparkSession
    ranks = rank_map(spark, read_ranks(ranks_path))  # one row
    rows = docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text"))
    gathered = rows.mapInArrow(
        _gather(ranks_path, pattern, row_chars),
        "keys array<bigint>, tokens array<string>, long_tokens array<string>, of_word binary, of_text binary",
    )
    folded = F.transform("tokens", lambda token: merge(token, F.col("ranks")))
    laid = gathered.crossJoin(F.broadcast(ranks)).select("keys", folded.alias("tokens"), "long_tokens", "of_word", "of_text")
    schema = "_key bigint, ids array<int>, ids_sha256 string"
    return laid.mapInArrow(_lay_out(ranks_path, pattern), schema).withColumnRenamed("_key", key)


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that an array of ids stands for. Pieces are joined as text of a letter a byte."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""), "ISO-8859-1")
