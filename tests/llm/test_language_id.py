import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import ENGLISH, GERMAN, GREEK, documents, empty_documents, rows_of, with_clashes

from reviewmill.llm import language_id
from reviewmill.llm.common import table


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, lang) for i in range(8) for t, lang in ((ENGLISH, "en"), (GERMAN, "de"), (GREEK, "el"), (ENGLISH, None))]
    return language_id.fit(documents(spark, rows))


def test_edge_rows(spark, model):
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(documents(spark), model).collect()}
    assert [found[k] for k in (4, 5, 6, 7)] == [("und", 0.0)] * 4
    assert [found[k][0] for k in (1, 2, 3, 8, 9, 14, None)] == ["en", "en", "de", "en", "el", "en", "en"]
    assert all(0 <= score <= 1 for _, score in found.values())
    assert rows_of(language_id.predict(with_clashes(documents(spark)), model)) == rows_of(
        language_id.predict(documents(spark), model)
    )


def test_mixed_text_has_spans(spark, model):
    text = f"{ENGLISH}. {GERMAN}! {GREEK}"
    (row,) = language_id.predict(documents(spark, [(1, text, None)]), model, with_spans=True).collect()
    assert [s.lang for s in row.spans] == ["en", "de", "el"]
    assert text[row.spans[2].start : row.spans[2].stop] == GREEK
    assert 0.3 < row.score < 0.5


def test_no_labels_and_no_rows(spark, model):
    nothing = language_id.fit(documents(spark, [(1, ENGLISH, None)]))
    assert {r.lang_pred for r in language_id.predict(documents(spark), nothing).collect()} == {"und"}
    assert language_id.predict(empty_documents(spark), model).count() == 0
    assert language_id.fit(empty_documents(spark)).languages == []


def test_rejected_documents_go_and_columns_stay(spark, model):
    docs = with_clashes(documents(spark))
    kept = language_id.keep_documents(docs, model)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 3, 8, 9, 10, 14, None}
    assert not {r.doc_id for r in kept.collect()} & {4, 5, 6, 7}


def test_scripts_that_no_language_uses_count_for_none(spark, model):
    chinese, georgian = "你好世界 我们回家了", "კატა და ძაღლი წავიდნენ ძველ სახლში"
    rows = [(1, chinese, None), (2, georgian, None), (3, f"word {georgian}", None), (4, f"{ENGLISH} 你好", None)]
    found = {r.doc_id: r for r in language_id.predict(documents(spark, rows), model, with_spans=True).collect()}
    assert [(found[k].lang_pred, found[k].score) for k in (1, 2)] == [("und", 0.0)] * 2
    assert 0 < found[3].score < 0.5 and found[4].lang_pred == "en" and 0.9 < found[4].score < 1
    assert [s.lang for s in found[1].spans] == ["und"] and [s.lang for s in found[4].spans] == ["en", "und"]
    assert {r.doc_id for r in language_id.keep_documents(documents(spark, rows), model).collect()} == {4}


def test_without_labels_texts_with_letters_stay(spark):
    nothing = language_id.fit(documents(spark, [(1, ENGLISH, None)]))
    kept = language_id.keep_documents(documents(spark), nothing)
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 8, 9, 10, 11, 12, 13, 14, None}


def test_paths_against_all_paths():
    random = np.random.default_rng(5)
    lengths = np.array([4, 0, 1, 5, 2])
    scores = random.normal(size=(lengths.sum(), 3)) * 3
    path = language_id.best_paths(scores, lengths, 2.0)
    start = 0
    for n in lengths:
        own = scores[start : start + n]

        def value(states):
            changes = sum(a != b for a, b in zip(states, states[1:]))
            return sum(own[i, s] for i, s in enumerate(states)) - 2.0 * changes

        best = max(map(value, itertools.product(range(3), repeat=int(n))))
        assert value(path[start : start + n].tolist()) == pytest.approx(best)
        start += n


def test_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.predict(docs, model).join(docs, "doc_id").where(language_id.held_out(F.col("doc_id"))).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in found)
    assert np.mean([r.lang == r.lang_pred for r in found]) >= 0.98


def test_a_long_text_is_read_in_parts(model, monkeypatch):
    text = " ".join(f"{ENGLISH}. {GERMAN}\u2003{GREEK}!" for _ in range(40)) + "x" * 3000
    scorer = language_id.Scorer(model)
    whole = language_id.predict_texts([text, ENGLISH, None, text], scorer, language_id.SWITCH)
    monkeypatch.setattr(language_id, "PART_CHARS", 100)
    parts = language_id.predict_texts([text, ENGLISH, None, text], language_id.Scorer(model), language_id.SWITCH)
    assert parts.language == whole.language and (parts.score == whole.score).all()
    assert all((a == b).all() for a, b in zip(parts.paths, whole.paths)) and len(whole.paths[0]) > 1000


def test_memory_of_a_long_text(model):
    """Numbers for each word, not objects: less than 60 bytes for a character at the peak."""
    import tracemalloc

    text = (ENGLISH + " " + GERMAN + "\n") * 2_000
    scorer = language_id.Scorer(model)
    tracemalloc.start()
    found = language_id.predict_texts([text], scorer, language_id.SWITCH)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.language[0] in ("en", "de") and peak < 60 * len(text)


def test_a_worker_holds_few_texts_as_words_at_a_time():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    scores = rng.random((language_id.BUCKETS, 4)).astype(np.float32)
    model = language_id.Model(list("abcd"), scores, np.ones((len(language_id.SCRIPT_NAMES), 4), bool))
    texts = [" ".join(f"{chr(97 + (i + j) % 26)}{chr(97 + j % 26)}word" for j in range(400)) for i in range(2_600)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["_key", "_text"])
    shared = type("Shared", (), {"value": tuple(model)})
    tracemalloc.start()
    found = list(language_id._predict(shared, language_id.SWITCH, False)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in found) == len(texts)
    assert peak < 25_000_000
