"""Ids by the libraries against ids by the operators: BPE, files, packing."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from samples import TEXTS, documents, empty_documents, rows_of, with_clashes
from tokenizers import Tokenizer

from reviewmill.llm import byte_bpe, packing, token_store, word_ids
from reviewmill.session import shared_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SPACELESS = public_tokenizers.path("word_bpe_49k.json")
SPACED = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a  b", "\n", "x\n\ny", "x\ty z", " lead", "tail ", "a <|endoftext|> b", "a\x1cb c!\x1c d", "a\xa0b c"]
ODD += ["it's we'll  don't", "İstanbul ΑΣ é ́x", "a\x00b \x00 c", "é x y.", "don't\nstop, now.", "你好 世界\n再见", "\r\nx", "3, 4. a."]


def raw(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("kind, path", [(word_ids.SpacelessWords, SPACELESS), (word_ids.SpacedWords, SPACED)])
def test_words_give_the_ids_of_whole_texts(kind, path):
    texts = ODD + [t or "" for _, t, _ in TEXTS]
    choose = random.Random(4)
    texts += ["".join(choose.choice(["ab", " ", "\n", ".", ",", "é", "'s", "12", "\t", "x"]) for _ in range(40)) for _ in range(200)]
    library = Tokenizer.from_file(path)
    wanted = [raw(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert kind(path).encode(texts) == wanted
    small = kind(path, kept_bytes=2_000)  # words are forgotten all the time
    assert [small.encode([t])[0] for t in texts] == wanted


def test_slices_of_texts_do_not_change_ids(monkeypatch):
    texts = [f"text number {i}, and some.\nMore" * (i % 5) for i in range(300)] + ["long words here " * 900 + "end"] + ODD
    for kind, path in ((word_ids.SpacelessWords, SPACELESS), (word_ids.SpacedWords, SPACED)):
        wanted = kind(path).encode(texts)
        assert wanted[1] == raw(Tokenizer.from_file(path).encode(texts[1], add_special_tokens=False).ids)
        monkeypatch.setattr(word_ids, "CHARS_AT_ONCE", 500)
        assert kind(path).encode(texts) == wanted
        monkeypatch.setattr(word_ids, "TEXTS_AT_ONCE", 3)
        assert kind(path).encode(texts) == wanted
        assert kind(path).encode([]) == []
        monkeypatch.undo()


def test_white_space_is_that_of_str_split():
    import sys

    import pyarrow as pa
    import pyarrow.compute as pc

    signs = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    matched = pc.match_substring_regex(pa.array(signs, pa.large_string()), f"[{word_ids.WHITE}]")
    assert [c for c, found in zip(signs, matched.to_pylist()) if found] == [c for c in signs if c.isspace()]


def test_byte_bpe_against_the_library(spark):
    ranks = byte_bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = TEXTS + [(100 + i, t, None) for i, t in enumerate(ODD)]
    found = byte_bpe.encode(with_clashes(documents(spark, rows)), RANKS, public_tokenizers.PATTERN, row_chars=500)
    found = found.withColumn("bytes", byte_bpe.decode(F.col("ids"), ranks)).collect()
    assert len(found) == len(rows)
    for row in found:
        text = next(t or "" for k, t, _ in rows if k == row.doc_id)
        assert row.ids == library.encode_ordinary(text)
        assert row.ids_sha256 == hashlib.sha256(raw(row.ids)).hexdigest()
        assert bytes(row.bytes) == text.encode()
    assert byte_bpe.encode(empty_documents(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_folded_words_against_the_library(spark):
    """Words that repeat themselves, end early or are one letter; the rank map is not in what every task gets."""
    ranks = byte_bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    choose = random.Random(7)
    words = ["".join(choose.choices("aabntheé你", k=choose.randrange(1, 40))) for _ in range(300)] + ["a" * 53, "zq" * 26]
    docs = documents(spark, [(i, w, None) for i, w in enumerate(words)])
    found = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert len(found._jdf.queryExecution().executedPlan().toString()) < 100_000
    assert {r.doc_id: r.ids for r in found.collect()} == {i: library.encode_ordinary(w) for i, w in enumerate(words)}


def test_rank_file():
    with open(RANKS, "rb") as lines:
        piece, rank = next(lines).split()
    assert byte_bpe.read_ranks(RANKS)[base64.b64decode(piece)] == int(rank)


def test_files_hold_every_document(spark):
    library = Tokenizer.from_file(SPACELESS)
    wanted = {k: library.encode(t or "", add_special_tokens=False).ids + [1] for k, t, _ in TEXTS}
    for docs, file_docs in ((documents(spark), 16_000), (with_clashes(documents(spark)), 4)):
        folder = token_store.write(docs, SPACELESS, shared_path(spark, "ids"), end_id=1, file_docs=file_docs)
        found = token_store.read(spark, folder, with_ids=True).collect()
        start = 0
        assert len(found) == len(TEXTS)
        for row in sorted(found, key=lambda r: r.start):
            assert row.start == start
            assert bytes(row.ids) == raw(wanted[row.doc_id])
            assert (row.n_tokens, row.ids_crc32) == (len(wanted[row.doc_id]), zlib.crc32(row.ids))
            start += row.n_tokens
        keys = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
        assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
        (file,) = spark.read.parquet(f"{folder}/manifest").orderBy("block").limit(1).collect()
        reader = token_store.Reader(folder, file.file)
        assert reader.ids(1) == raw(wanted[keys[1]])
        with pytest.raises(ValueError, match="another dictionary"):
            token_store.Reader(folder, file.file, b"other")


def test_no_document_no_file(spark):
    folder = token_store.write(empty_documents(spark), SPACELESS, shared_path(spark, "ids"))
    assert token_store.read(spark, folder).count() == 0


def test_dictionary_makes_short_documents_smaller():
    choose = random.Random(1)
    words = [raw([choose.randrange(40_000) for _ in range(3)]) for _ in range(300)]
    texts = [b"".join(choose.choice(words) for _ in range(30)) for _ in range(600)]
    dictionary = token_store.train_dictionary(texts, 16_000)
    import zstandard

    plain = sum(len(zstandard.ZstdCompressor().compress(t)) for t in texts)
    press = zstandard.ZstdCompressor(dict_data=token_store._dictionary(dictionary))
    assert sum(len(press.compress(t)) for t in texts) < 0.8 * plain
    assert token_store.train_dictionary([]) == b""


def check_packing(found, texts):
    library = Tokenizer.from_file(SPACED)
    sequences, pieces = {}, {}
    for row in found:
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
        pieces.setdefault(row.doc_id, []).append(row)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    for key, text, _ in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        copies = sum(k == key for k, *_ in texts)
        own = sorted(pieces[key], key=lambda r: r.piece)
        assert sum(r.length for r in own) == copies * len(ids)
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert (len(part), zlib.crc32(raw(part))) == (r.length, r.ids_crc32)
            assert r.length == 2048 or r.piece == 0
    return len(sequences), sum(r.length for r in found)


def test_packing_edge_rows(spark):
    found = packing.pack_documents(documents(spark), SPACED).collect()
    check_packing(found, TEXTS)
    assert rows_of(packing.pack_documents(with_clashes(documents(spark)), SPACED)) == sorted(map(tuple, found), key=repr)
    assert packing.pack_documents(empty_documents(spark), SPACED).count() == 0


def test_packing_in_a_tree(spark):
    choose = random.Random(2)
    rows = [(i, "word " * choose.choice([1, 5, 40, 300, 700, 1500, 2500]), None) for i in range(900)]
    found = packing.pack_documents(documents(spark, rows), SPACED, chunk_items=60, fan_in=3, up_bins=10).collect()
    sequences, tokens = check_packing(found, rows)
    assert sequences <= 1.05 * math.ceil(tokens / 2048)


def test_best_fit_leaves_the_least_room():
    bins = packing.best_fit([6, 5, 4, 3, 2], 10)
    assert sorted(sorted(b) for b in bins) == [[0, 2], [1, 3, 4]]
    assert packing.best_fit([], 10) == []


def test_kept_words_leave_room_for_other_stages():
    """A worker that meets ever new words keeps a bounded part of them, and encodes all alike."""
    encoder = word_ids.SpacedWords(public_tokenizers.path("byte_bpe_50k.json"))
    for start in range(0, 450_000, 50_000):
        text = " ".join(f"w{i:x}" for i in range(start, start + 50_000))
        (ids,) = encoder.encode([text])
    assert ids == encoder.ids(text).tobytes()
    assert len(encoder.kept) + len(encoder.older) < 400_000


@pytest.mark.parametrize("kind, path", [(word_ids.SpacelessWords, SPACELESS), (word_ids.SpacedWords, SPACED)])
def test_words_are_asked_for_once_whatever_signs_end_them(kind, path, monkeypatch):
    encoder, asked = kind(path), []
    ask = encoder._ask
    monkeypatch.setattr(encoder, "_ask", lambda words: asked.extend(words) or ask(words))
    texts = ["a stem### stem*** stem.%%% stem!! stem", "a stem$$$ don't### it's. x_ 7## é<>", "a stem's'' ### stem,###"]
    assert encoder.encode(texts[:1]) + encoder.encode(texts[1:]) == [
        raw(encoder.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts
    ]
    assert asked.count("stem") == 1 and not any(w.startswith("stem") and w[-1] in "#*.%!$," for w in asked)


def test_kept_words_take_few_bytes_each():
    import tracemalloc

    import pyarrow as pa

    encoder = word_ids.SpacedWords(SPACED)
    texts = [" ".join(f"{c}{i:x}q" for i in range(30_000)) for c in "abcdefgh"]
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    for text in texts:
        encoder.encode([text])
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert len(encoder.kept) + len(encoder.older) > 100_000
    assert held < 120 * (len(encoder.kept) + len(encoder.older))
