"""Language of texts, and of spans within them, by a Viterbi path over per-word scores.

The model holds smoothed log-frequencies of hashed letter trigrams per language, and the scripts
that a language is written in. A word's script leaves only the languages that use it as
candidates; the trigrams score them. The best path through the words of a text, where a change of
language costs ``SWITCH``, gives every word a language, so neighbouring words of one language form
spans. The language with the most letters is predicted, its share of the letters is the score.

The model is fitted on at most ``SAMPLE_DOCS`` labelled documents of each language (lowest key
hashes), counted in tasks; what reaches the driver are sums per trigram bucket. Prediction is one
pass without a shuffle. Words are scored once per worker, and paths run through all texts of a
batch at the same time.

Defined results
---------------
* Text NULL or without a letter: ``und``, score 0. No labelled document: ``und`` for all.
* Letters of a script that no language uses count for none, but in the total; a text of such letters
  alone is ``und``, score 0, and so are spans of them. Ties go to the first language by name.
* Without a labelled document :func:`keep_documents` keeps every text with a letter.
* Rows with NULL or repeated keys are predicted like any other; no key is an input.
* Columns other than the named ones are ignored, or passed through by :func:`keep_documents`.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewmill.llm.common import sliced_by_bytes, worker_cache

SAMPLE_DOCS = 1_000
SWITCH = 12.0
SMOOTHING = 0.1
BUCKETS = 1 << 16
OTHER_SCRIPT = -200.0
SCRIPT_SHARE = 0.01
KEPT_WORDS = 300_000
SLICE_BYTES = 1_500_000
PART_CHARS = 1_000_000
MIN_SCORE = 0.5
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
SPACE = re.compile(r"\s")

# First code points of the ranges of scripts (Unicode blocks), and their names.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"),
    (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
    (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"),
    (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB10, "other"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFE70, "arabic"), (0xFF00, "other"), (0x20000, "han"), (0x32000, "other"),
)
SCRIPT_STARTS = np.array([start for start, _ in SCRIPTS])
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
SCRIPT_OF_RANGE = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])


class Model(NamedTuple):
    languages: list[str]
    scores: np.ndarray  # bucket x language
    uses: np.ndarray  # script x language


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter trigrams of all words, and how many each word has (its letters)."""
    codes = np.frombuffer(("\x02" + "\x02".join(words) + "\x02").encode("utf-32-le", "replace"), "<u4")
    codes = codes.astype(np.uint64)
    mixed = codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    inside = codes[1:-1] != 2
    return (mixed >> np.uint64(48)).astype(np.int64)[inside], np.array([len(w) for w in words])


def _scripts(words: list[str]) -> np.ndarray:
    """Script of the first letter of each word."""
    first = np.array([ord(w[0]) for w in words], dtype=np.int64)
    return SCRIPT_OF_RANGE[np.searchsorted(SCRIPT_STARTS, first, side="right") - 1]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _parts(text: str) -> Iterator[str]:
    """Parts of about ``PART_CHARS`` characters, cut behind white space."""
    start = 0
    while start < len(text):
        cut = SPACE.search(text, start + PART_CHARS)
        stop = cut.end() if cut else len(text)
        yield text[start:stop]
        start = stop


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: trigrams per language and bucket, letters per language and script."""
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in sliced_by_bytes(batches, 1, SLICE_BYTES):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for part in _parts(text or ""):
                words = [w for w in words_of(part) if w.isalpha()]
                if not words:
                    continue
                buckets, lengths = _trigrams(words)
                grams.setdefault(lang, np.zeros(BUCKETS, np.int64))
                grams[lang] += np.bincount(buckets, minlength=BUCKETS)
                scripts.setdefault(lang, np.zeros(len(SCRIPT_NAMES), np.int64))
                scripts[lang] += np.bincount(_scripts(words), lengths, len(SCRIPT_NAMES)).astype(np.int64)
    for kind, counts in (("gram", grams), ("script", scripts)):
        for lang, values in counts.items():
            at = np.flatnonzero(values)
            arrays = [pa.array([kind] * len(at)), pa.array([lang] * len(at)), pa.array(at), pa.array(values[at])]
            yield pa.RecordBatch.from_arrays(arrays, ["kind", "lang", "place", "n"])


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCS) -> Model:
    """The model of a table of labelled texts, from at most ``sample`` of each language."""
    keys = labelled.select(F.col(key).alias("key"), F.col(lang).alias("lang")).where("lang IS NOT NULL").distinct()
    lowest = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    chosen = keys.withColumn("_rank", F.row_number().over(lowest)).where(F.col("_rank") <= sample).select("key", "lang")
    rows = labelled.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counted = (
        rows.join(F.broadcast(chosen), ["key", "lang"], "left_semi")
        .select("lang", "text")
        .mapInArrow(_count, "kind string, lang string, place bigint, n bigint")
        .groupBy("kind", "lang", "place")
        .agg(F.sum("n").alias("n"))
        .toArrow()
        .to_pydict()
    )
    languages = sorted(set(counted["lang"]))
    grams = np.zeros((BUCKETS, len(languages)))
    scripts = np.zeros((len(SCRIPT_NAMES), len(languages)))
    for kind, name, place, n in zip(*(counted[c] for c in ("kind", "lang", "place", "n"))):
        (grams if kind == "gram" else scripts)[place, languages.index(name)] = n
    scores = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * BUCKETS))
    uses = scripts >= SCRIPT_SHARE * scripts.sum(axis=0)
    return Model(languages, scores.astype(np.float32), uses & (scripts > 0))


class Scorer:
    """Scores of words, kept for the words met before."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)), np.float32)
        self.letters = np.zeros(0, np.int64)
        self.known = np.zeros(0, bool)  # written in a script that some language uses

    def _score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        buckets, counts = _trigrams(words)
        sums = np.add.reduceat(self.model.scores[buckets], np.cumsum(counts) - counts, axis=0)
        uses = self.model.uses[_scripts(words)]
        sums = np.where(uses, sums, OTHER_SCRIPT + sums.min(axis=1, keepdims=True))
        known = uses.any(axis=1)
        return np.where(known[:, None], sums - sums.max(axis=1, keepdims=True), 0.0), known

    def forget(self) -> None:
        """Start anew if too many words are kept; places found before no longer hold."""
        if len(self.places) > KEPT_WORDS:
            self._clear()

    def places_of_text(self, text: str) -> np.ndarray:
        """Places of the words of a long text, a part of it at a time."""
        return np.concatenate([self.places_of([words_of(part)])[0] for part in _parts(text)])

    def places_of(self, texts: list[list[str]]) -> list[np.ndarray]:
        new = list(set().union(*texts).difference(self.places)) if texts else []
        if new:
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
            scores, known = self._score(new)
            self.scores = np.concatenate([self.scores, scores.astype(np.float32)])
            self.known = np.concatenate([self.known, known])
            letters = [len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in new]
            self.letters = np.concatenate([self.letters, np.array(letters, np.int64)])
        return [np.fromiter(map(self.places.__getitem__, words), np.int64, len(words)) for words in texts]


def best_paths(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Language of every word; ``scores`` has the words of all texts one after the other.

    All texts advance together, the longest first, so a step works on the texts that still have
    words. Staying is kept as a flag per language, leaving as the one best language before.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts longer than a step
    path = np.zeros(len(scores), np.int16)
    stays = np.empty((len(scores), scores.shape[1]), bool)  # in the order of the steps
    bests = np.empty(len(scores), np.int16)
    places = np.concatenate([[0], np.cumsum(active)])
    value = scores[starts[: active[0]]].astype(np.float64) if longest else None
    ends = np.zeros(len(sizes), np.int64)
    for step in range(1, longest):
        before, n = int(active[step - 1]), int(active[step])
        if n < before:
            ends[n:before] = value[n:before].argmax(axis=1)
            value = value[:n]
        best = value.argmax(axis=1)
        leave = value[np.arange(n), best][:, None] - switch
        stay = value >= leave
        value = np.where(stay, value, leave) + scores[starts[:n] + step]
        stays[places[step] : places[step] + n] = stay
        bests[places[step] : places[step] + n] = best
    if longest:
        n = int(active[-1])
        ends[:n] = value.argmax(axis=1)
    state = ends.copy()
    for step in range(longest - 1, -1, -1):
        n = int(active[step])
        path[starts[:n] + step] = state[:n]
        if step:
            here = slice(places[step], places[step] + n)
            held = stays[here][np.arange(n), state[:n]]
            state[:n] = np.where(held, state[:n], bests[here])
    return path


class Prediction(NamedTuple):
    language: list[str]
    score: np.ndarray
    paths: list[np.ndarray]  # language of every word of each text, -1 for none


def predict_texts(texts: list[str | None], scorer: Scorer, switch: float) -> Prediction:
    model = scorer.model
    n_languages = len(model.languages)
    scorer.forget()
    long = {i: t for i, t in enumerate(texts) if t and n_languages and len(t) > PART_CHARS}
    places = scorer.places_of([words_of(t) if t and n_languages and i not in long else [] for i, t in enumerate(texts)])
    for i, text in long.items():
        places[i] = scorer.places_of_text(text)
    lengths = np.array([len(p) for p in places], np.int64)
    flat = np.concatenate(places) if places else np.zeros(0, np.int64)
    path = best_paths(scorer.scores[flat], lengths, switch)
    text_of = np.repeat(np.arange(len(texts)), lengths)
    cells = max(1, n_languages)
    known, counts = scorer.known[flat], scorer.letters[flat]
    letters = np.bincount(text_of * cells + path, counts * known, len(texts) * cells)
    letters = letters.reshape(len(texts), cells)
    total, best, most = np.bincount(text_of, counts, len(texts)), letters.argmax(axis=1), letters.max(axis=1)
    score = np.where(total > 0, most / np.maximum(total, 1), 0.0)
    language = [model.languages[b] if m > 0 else UNKNOWN for b, m in zip(best, most)]
    path = np.where(known, path, -1)
    return Prediction(language, score, np.split(path, np.cumsum(lengths)[:-1]) if len(texts) else [])


def _scorer(shared, version: str) -> Scorer:
    return worker_cache("language", lambda: Scorer(Model(*shared.value)), version)


def _spans(text: str, path: np.ndarray, languages: list[str]) -> list[dict]:
    """Runs of words of one language, as code point ranges from the first word to the last."""
    spans: list[dict] = []
    lowered = text.lower()
    source = lowered if len(lowered) == len(text) else text
    for match, place in zip(WORD.finditer(source), path.tolist()):
        lang = languages[place] if place >= 0 else UNKNOWN
        if spans and spans[-1]["lang"] == lang:
            spans[-1]["stop"] = match.end()
        else:
            spans.append({"start": match.start(), "stop": match.end(), "lang": lang})
    return spans


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())]))


def _predict(shared, switch: float, with_spans: bool):
    """Task function: prediction for each (key, text)."""
    version = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared, version)
        for batch in sliced_by_bytes(batches, 1, SLICE_BYTES):
            texts = batch.column(1).to_pylist()
            found = predict_texts(texts, scorer, switch)
            spans = [
                _spans(t or "", path, scorer.model.languages) if with_spans else None
                for t, path in zip(texts, found.paths)
            ]
            arrays = [batch.column(0), pa.array(found.language), pa.array(found.score), pa.array(spans, SPANS)]
            yield pa.RecordBatch.from_arrays(arrays, ["_key", "lang_pred", "score", "spans"])

    return run


def predict(
    docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", switch: float = SWITCH, with_spans: bool = False
) -> DataFrame:
    """Key, ``lang_pred``, ``score`` and, if asked for, ``spans`` (start, stop, lang) of every row."""
    rows = docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # a plain tuple, as broadcasts are not pickled by value
    schema = "_key bigint, lang_pred string, score double, spans array<struct<start:bigint,stop:bigint,lang:string>>"
    return rows.mapInArrow(_predict(shared, switch, with_spans), schema).withColumnRenamed("_key", key)


def _keep(shared, switch: float, min_score: float, place: int):
    """Task function: the rows with enough letters in one language, all columns as they are."""
    version = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared, version)
        for batch in sliced_by_bytes(batches, place, SLICE_BYTES):
            texts = batch.column(place).to_pylist()
            if not scorer.model.languages:
                yield batch.filter(pa.array([any(map(str.isalpha, t or "")) for t in texts], pa.bool_()))
                continue
            found = predict_texts(texts, scorer, switch)
            kept = [lang != UNKNOWN and score >= min_score for lang, score in zip(found.language, found.score)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return run


def keep_documents(
    docs: DataFrame, model: Model, text: str = "text", switch: float = SWITCH, min_score: float = MIN_SCORE
) -> DataFrame:
    """Rows of ``docs`` whose text has a language with at least ``min_score`` of its letters.

    If the model has no language, none can be rejected for it: rows with a letter stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # a plain tuple, as broadcasts are not pickled by value
    return docs.mapInArrow(_keep(shared, switch, min_score, docs.columns.index(text)), docs.schema)


def held_out(key: Column) -> Column:
    """Documents kept from fitting: CRC-32 of the key as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))
