"""Token ids in binary files, each document compressed by itself with a shared dictionary.

A folder holds ``dictionary`` (zstandard, trained on serialized id arrays), ``manifest`` (Parquet,
a row for each file) and one file for each ascending range of keys::

    header   8 bytes magic, 1 byte width of an id (2 or 4), 32 bytes SHA-256 of the dictionary
    frames   one zstandard frame for each document, in ascending order of keys
    index    for each document: key, whether it is NULL, number of ids, place and length of its frame
    footer   place of the index, number of documents, 8 bytes magic

So a short document costs one read of the index and one of its frame. Ids are serialized as
little-endian unsigned integers of the width that the vocabulary needs.

Texts are encoded and compressed before they are shuffled; the shuffle carries frames. A task
writes its file under a name of its own attempt and then renames it, so a lost or repeated task
leaves a whole file with the same bytes. The dictionary is trained on at most ``SAMPLE_DOCS``
documents (lowest key hashes) and at most ``SAMPLE_BYTES`` of each; it decides the size of the
files, not their content. Files are reached through ``pyarrow.fs``, whatever store the folder is in.

Defined results
---------------
* Text NULL is empty: its only id is the end id.
* Keys may be NULL (they come first) or repeated (then in order of checksum and length).
* An empty table gives an empty folder and an empty result.
* Columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reviewmill.llm import word_ids
from reviewmill.llm.common import block_of, key_bounds, sliced, worker_cache

MAGIC = b"IDFRAMES"
HEADER = np.dtype([("magic", "S8"), ("width", "u1"), ("dictionary", "V32")])
INDEX = np.dtype([("key", "<i8"), ("null", "u1"), ("ids", "<u8"), ("place", "<u8"), ("length", "<u4")])
FOOTER = np.dtype([("index", "<u8"), ("docs", "<u8"), ("magic", "S8")])
DICTIONARY_BYTES = 112 * 1024
SAMPLE_DOCS = 2_000
SAMPLE_BYTES = 8_192
FILE_DOCS = 16_000
LEVEL = 3
READ_DOCS = 2_000


def _serialize(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _deserialize(raw: bytes, width: int) -> bytes:
    return raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def _encoder(path: str) -> word_ids.WordIds:
    return worker_cache(f"spaceless:{path}", lambda: word_ids.SpacelessWords(path))


def _sample(path: str, end: bytes, width: int):
    """Task function: the serialized ids of the sampled documents, cut to the sample's bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            raw = [_serialize(ids + end, width)[:SAMPLE_BYTES] for ids in _encoder(path).encode(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], ["raw"])

    return run


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the plain content of the samples where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw)


def _frames(path: str, end: bytes, width: int, dictionary: bytes):
    """Task function: the frame of each document."""
    names = ["block", "key", "n_ids", "crc", "frame"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_dict_id=1, write_content_size=1)
        press = zstandard.ZstdCompressor(dict_data=_dictionary(dictionary), compression_params=options)
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            counts, crcs, frames = [], [], []
            for ids in _encoder(path).encode(texts):
                ids += end
                counts.append(len(ids) // 4)
                crcs.append(zlib.crc32(ids))
                frames.append(press.compress(_serialize(ids, width)))
            arrays = [batch.column(0), batch.column(1)]
            arrays += [pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), pa.array(frames, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


class _Writer:
    """One file, written under a name of this attempt."""

    def __init__(self, folder: str, block: int, header: bytes):
        self.store, root = fs.FileSystem.from_uri(folder)
        self.path = f"{root}/ids-{block:06d}.bin"
        self.draft = f"{root}/.draft-{block:06d}-{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.draft, compression=None)
        self.out.write(header)
        self.place, self.block, self.n_ids = len(header), block, 0
        self.index: list[tuple] = []

    def add(self, key: int | None, n_ids: int, frame: bytes) -> None:
        self.out.write(frame)
        self.index.append((key or 0, key is None, n_ids, self.place, len(frame)))
        self.place += len(frame)
        self.n_ids += n_ids

    def close(self) -> tuple[int, str, int, int]:
        self.out.write(np.array(self.index, dtype=INDEX).tobytes())
        self.out.write(np.array([(self.place, len(self.index), MAGIC)], dtype=FOOTER).tobytes())
        self.out.close()
        if self.store.get_file_info(self.path).type != fs.FileType.NotFound:
            self.store.delete_file(self.path)  # of an earlier attempt, with the same bytes
        self.store.move(self.draft, self.path)
        return self.block, self.path.rpartition("/")[2], len(self.index), self.n_ids


def _write(folder: str, header: bytes):
    """Task function: a file for each block of the sorted rows of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            for block, key, n_ids, frame in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if writer is None or writer.block != block:
                    if writer is not None:
                        done.append(writer.close())
                    writer = _Writer(folder, block, header)
                writer.add(key, n_ids, frame)
        if writer is not None:
            done.append(writer.close())
        columns = zip(*done) if done else ((), (), (), ())
        types = (pa.int32(), pa.string(), pa.int64(), pa.int64())
        arrays = [pa.array(list(c), t) for c, t in zip(columns, types)]
        yield pa.RecordBatch.from_arrays(arrays, ["block", "file", "n_docs", "n_ids"])

    return run


def write(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    file_docs: int = FILE_DOCS,
) -> str:
    """Write the ids of all documents below ``folder``, a new one in a store that all tasks share."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    width = 2 if _encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else 4
    end = np.uint32(end_id).tobytes()

    low = rows.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(SAMPLE_DOCS)
    sampled = rows.join(F.broadcast(low), "key", "left_semi").select("text").limit(SAMPLE_DOCS)
    samples = [r.raw for r in sampled.mapInArrow(_sample(tokenizer, end, width), "raw binary").collect()]
    dictionary = train_dictionary(sorted(samples))
    digest = hashlib.sha256(dictionary).digest()
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/dictionary", compression=None) as out:
        out.write(dictionary)

    header = np.array([(MAGIC, width, np.void(digest))], dtype=HEADER).tobytes()
    bounds = key_bounds(rows, "key", F.lit(1), file_docs)
    blocks = len(bounds) + 1
    frames = rows.select(block_of(F.col("key"), bounds).alias("block"), "key", "text").mapInArrow(
        _frames(tokenizer, end, width, dictionary),
        "block int, key bigint, n_ids bigint, crc bigint, frame binary",
    )
    ordered = frames.repartitionById(blocks, "block").sortWithinPartitions("block", "key", "crc", "n_ids")
    written = ordered.mapInArrow(_write(folder, header), "block int, file string, n_docs bigint, n_ids bigint")
    written.write.parquet(f"{folder}/manifest")
    return folder


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, folder: str, file: str, dictionary: bytes | None = None):
        self.store, root = fs.FileSystem.from_uri(folder)
        if dictionary is None:
            with self.store.open_input_stream(f"{root}/dictionary", compression=None) as source:
                dictionary = source.read()
        self.source = self.store.open_input_file(f"{root}/{file}")
        (header,) = np.frombuffer(self._at(0, HEADER.itemsize), HEADER)
        size = self.source.size()
        (footer,) = np.frombuffer(self._at(size - FOOTER.itemsize, FOOTER.itemsize), FOOTER)
        if header["magic"] != MAGIC or footer["magic"] != MAGIC:
            raise ValueError(f"{file} is not a file of token ids")
        if bytes(header["dictionary"]) != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{file} was written with another dictionary")
        self.width = int(header["width"])
        place, docs = int(footer["index"]), int(footer["docs"])
        self.index = np.frombuffer(self._at(place, docs * INDEX.itemsize), INDEX)
        self.press = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def _at(self, place: int, length: int) -> bytes:
        self.source.seek(place)
        return self.source.read(length)

    def ids(self, number: int) -> bytes:
        """Ids of the document with this place in the file, as unsigned 32-bit integers."""
        entry = self.index[number]
        frame = self._at(int(entry["place"]), int(entry["length"]))
        return _deserialize(self.press.decompress(frame), self.width)


def _read(folder: str, dictionary: bytes, with_ids: bool):
    """Task function: the documents of the listed files."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = Reader(folder, file, dictionary)
                for first in range(0, len(reader.index), READ_DOCS):
                    rows = []
                    for number in range(first, min(first + READ_DOCS, len(reader.index))):
                        entry, ids = reader.index[number], reader.ids(number)
                        n = len(ids) // 4
                        if n != entry["ids"]:
                            raise ValueError(f"document {number} of {file} is damaged")
                        key = None if entry["null"] else int(entry["key"])
                        rows.append((key, start, n, zlib.crc32(ids), ids if with_ids else None))
                        start += n
                    arrays = [pa.array(list(c), t) for c, t in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids`` of every document.

    ``start`` counts the ids of all documents before. Files are read one by one in tasks; their
    first starts are a running sum over the manifest, one row for each file.
    """
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/dictionary", compression=None) as source:
        dictionary = source.read()
    files = spark.read.schema("block int, file string, n_docs bigint, n_ids bigint").parquet(f"{folder}/manifest")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("bigint"))
    tasks = max(1, files.count())
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
    listed = starts.repartitionById(tasks, F.col("block")).select("file", "start")
    return listed.mapInArrow(_read(folder, dictionary, with_ids), schema)
