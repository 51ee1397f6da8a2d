import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from samples import TEXTS, documents, empty_documents, rows_of, with_clashes

from reviewmill.llm import word_runs
from reviewmill.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def naive_runs(words):
    """All runs by trying every start, period and end."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        low = 0
        while low + q < n:
            high = low + q
            while high < n and words[high] == words[high - q]:
                high += 1
            if high - low >= max(6, 4 * q) and not any(
                all(words[i] == words[i + p] for i in range(low, high - p)) for p in range(1, q)
            ):
                found.append((low, high - low, q))
            low = max(low + 1, high - q + 1) if high - low > q else low + 1
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for low, n, q in runs for i in range(low + q, low + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def check(texts, found):
    for text, (runs, longest, kept) in zip(texts, found, strict=True):
        words = WORD.findall(text or "")
        wanted = naive_runs(words)
        assert [tuple(r) for r in runs] == wanted
        best = min(wanted, key=lambda r: (-r[1], r[0], r[2]), default=None)
        assert (longest and tuple(longest)) == best
        assert kept == collapsed(words, wanted)


def answers(texts):
    """What the task function makes of ``texts``, without Spark."""
    runs, kept = word_runs._answer([None if t is None else t.encode() for t in texts])
    out = []
    for found, text in zip(runs.to_pylist(), kept.to_pylist()):
        found = [(r["start"], r["length"], r["period"]) for r in found]
        out.append((found, min(found, key=lambda r: (-r[1], r[0], r[2]), default=None), text))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab ", max_size=80).map(" ".join), max_size=4))
def test_two_words_in_any_order(texts):
    check(texts, answers(texts))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=5), st.integers(1, 9)), max_size=8), st.integers(0, 2))
def test_nested_repetitions(parts, again):
    text = " ".join("".join(word * times for word, times in parts) * (1 + 4 * again))
    check([text, text, text[: len(text) // 2]], answers([text, text, text[: len(text) // 2]]))


def test_runs_among_random_words():
    draw = random.Random(5)
    texts = []
    for _ in range(60):
        words = [draw.choice("the of and to a in is".split() + [f"w{i}" for i in range(30)]) for _ in range(draw.randint(0, 120))]
        for _ in range(draw.randint(0, 3)):
            at, q = draw.randint(0, len(words)), draw.randint(1, 9)
            cycle = [draw.choice("xyz") for _ in range(q)]
            words[at:at] = (cycle * 8)[: draw.randint(q, 8 * q)]
        texts.append(" ".join(words))
    check(texts, answers(texts))


def test_ends_at_every_place():
    words = "p q r s".split()
    for n in range(3, 26):
        for q in range(1, 5):
            text = " ".join(["a"] + (words[:q] * 26)[:n] + ["b"])
            check([text], answers([text]))


def test_edge_rows(spark):
    found = word_runs.runs_of(documents(spark)).collect()
    texts = {}
    for key, text, _ in TEXTS:
        texts.setdefault(key, []).append(text)
    assert len(found) == len(TEXTS)
    for row in found:
        check([texts[row.doc_id][0]], [(row.runs, row.longest, row.collapsed)])


def test_extra_columns_and_empty_table(spark):
    plain = rows_of(word_runs.runs_of(documents(spark)))
    assert rows_of(word_runs.runs_of(with_clashes(documents(spark)))) == plain
    assert word_runs.runs_of(empty_documents(spark)).count() == 0


def test_a_text_is_answered_alike_alone_and_among_others(monkeypatch):
    texts = ["x y " * 40 + f"end {i} " + "p q r " * 9 for i in range(50)]
    together = answers(texts)
    assert [answers([t])[0] for t in texts] == together


def test_very_long_periodic_text():
    words = ["a"] * 300_000 + ["b"] + ["c", "d", "e"] * 100_000
    (runs, longest, kept), = answers([" ".join(words)])
    assert runs == [(0, 300_000, 1), (300_001, 300_000, 3)] and longest == runs[0]
    assert kept == "a b c d e"


def test_a_wrong_hash_starts_the_search_anew(monkeypatch):
    words = np.array([1, 2] * 6 + [1, 3] * 5 + [2, 2, 2, 2, 2, 2, 2, 3], dtype=np.int64)
    starts, ends = np.array([0]), np.array([len(words)])
    good = [a.tolist() for a in word_runs.find_runs(words, starts, ends)]
    made = []

    class Liar(word_runs._Prefixes):
        def __init__(self, words, base):
            super().__init__(words, base)
            made.append(base)

        def equal(self, low, shift, length):
            same = super().equal(low, shift, length)
            return same | (length == 7) if len(made) == 1 else same

    monkeypatch.setattr(word_runs, "_Prefixes", Liar)
    assert [a.tolist() for a in word_runs.find_runs(words, starts, ends)] == good and len(made) > 1


def test_query_over_the_test_tables(spark, sf_dir):
    found = {r.doc_id: r for r in QUERIES["op11_repair_runs"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    looped = 0
    for doc_id, text in docs:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            looped += 1
        row = found[doc_id]
        if n > 500:
            continue
        runs = naive_runs(words)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert row.n_runs == len(runs) and row.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        assert (row.start, row.length, row.period) == best
        assert row.exponent_milli == (best[0] if best[0] is None else 1000 * best[1] // best[2])
    assert looped > 5
