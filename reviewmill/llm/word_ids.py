"""Token ids of whole texts by the tokenizers library, every distinct word encoded once.

Both kinds of tokenizer used here cut a text at white space before they look for merges, so the
ids of a text are the ids of its words, one after the other. A worker keeps the ids of the words
it met and asks the library for the others, many words in one call with a separator between them
that becomes a token of its own. Arrow cuts the texts, tells the words apart, finds those that are kept
and puts their ids in order, so Python looks only at words that are not kept. Texts whose white space could be read
in more than one way, or that may hold a special token, go to the library as a whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS_PER_CALL = 100  # the library takes longer for each word of a long text
MARKS = 1_000  # kept ends of words
KEPT_BYTES = 24_000_000  # of kept words
WORD_BYTES = 40  # of a kept word besides its letters and ids
TEXTS_AT_ONCE = 2_048
CHARS_AT_ONCE = 3_000_000  # or one longer text

# The white space that str.split cuts at.
WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PLAIN = rf"\A[^{WHITE}]+(?:[ \n][^{WHITE}]+)*\z"  # single spaces and line breaks between words
SEPARATORS = "\x1c\x1d\x1e\x1f"
MARKED = r"(\p{L})[!-&(-/:-@\[-^`{-~]+\z"  # a letter, and ASCII signs but "'" and "_" to the end of the word

NO_WORDS = pa.array([], pa.large_string())
NO_FACTS = (pa.array([], pa.large_binary()), np.array([], np.int32), np.array([], np.int32))


def spaced_words(text: str) -> list[str] | None:
    """Words of a text, cut before every single space or line break; None if there are others.

    A word comes with the character before it if that is a line break, and bare after a space.
    The first word comes with a line break that the text does not have.
    """
    words = text.split()
    breaks = text.count("\n")
    plain = (
        words
        and len(words) - 1 == text.count(" ") + breaks
        and sum(map(len, words)) + len(words) - 1 == len(text)
    )
    if not plain:
        return None
    if breaks:
        words = text.replace("\n", " \n").split(" ")
    words[0] = "\n" + words[0]
    return words


class WordIds:
    """``encode`` returns the ids of each text as little-endian unsigned 32-bit integers."""

    before = 0  # ids of a text's first word that stand for nothing in the text

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept_bytes, self.slices = kept_bytes, 0
        # words met since the last clearing, and before; with their ids, slices they are in, the last of them
        self.kept, self.older = NO_WORDS, NO_WORDS
        self.facts = {"kept": NO_FACTS, "older": NO_FACTS}
        self.marks: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def words(self, texts: pa.Array) -> tuple[list[bool], pa.ListArray]:
        """Which texts need not stay whole, and the words whose ids make up each of these."""
        raise NotImplementedError

    def _separated(self, words: Sequence[str]) -> tuple[str, int]:
        """One text with all words, each after a separator, and the separator's id."""
        raise NotImplementedError

    def _ask(self, words: list[str]) -> list[bytes]:
        text, separator = self._separated(words)
        ids = np.array(
            self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4"
        )
        cuts = np.flatnonzero(ids == separator)
        if len(cuts) != len(words):  # a word holds the separator itself
            return [self.ids(self._alone(w)).tobytes() for w in words]
        ends, raw = [*(4 * cuts[1:]).tolist(), 4 * len(ids)], ids.tobytes()
        return [raw[start:end] for start, end in zip((4 * cuts + 4).tolist(), ends)]

    def _alone(self, word: str) -> str:
        return word

    def _learn(self, missing: list[str]) -> list[bytes]:
        """Ids of words that are not kept."""
        ids: list[bytes] = []
        for start in range(0, len(missing), WORDS_PER_CALL):
            some = missing[start : start + WORDS_PER_CALL]
            ids += self._finished(some, self._ask(some))
        return ids

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            if len(self.marks) >= MARKS:
                self.marks.clear()
            self.marks[mark] = self.ids(mark).tobytes()
        return self.marks[mark]

    def _finished(self, words: list[str], ids: list[bytes]) -> list[bytes]:
        return ids

    def _known(self, words: pa.Array, name: str) -> pa.Array:
        """Ids of the words that are among the named ones, NULL of others."""
        ids, uses, last = self.facts[name]
        at = pc.index_in(words, value_set=getattr(self, name))
        places = at.drop_null().to_numpy()
        uses[places] += 1
        last[places] = self.slices
        return ids.take(at)

    def _of(self, words: pa.Array) -> pa.Array:
        """Ids of words.

        Signs after a letter at the end of a word are always cut off before merges are looked for,
        so words are asked for and kept without them.
        """
        stems = pc.replace_substring_regex(words, MARKED, r"\1")
        marked = pc.not_equal(pc.binary_length(stems), pc.binary_length(words))
        stems = stems.dictionary_encode()
        found = self._of_stems(stems.dictionary).take(stems.indices)
        marks = pc.replace_substring_regex(words.filter(marked), r"(?s)\A.*\p{L}", "").dictionary_encode()
        ids = pa.array(map(self._mark, marks.dictionary.to_pylist()), pa.large_binary()).take(marks.indices)
        none = pa.scalar(b"", pa.large_binary())
        return pc.replace_with_mask(found, marked, pc.binary_join_element_wise(found.filter(marked), ids, none))

    def _of_stems(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words."""
        self.slices += 1
        found = self._known(words, "older")
        for step in (lambda rest: self._known(rest, "kept"), self._new):
            gaps = found.is_null()
            found = pc.replace_with_mask(found, gaps, step(words.filter(gaps)))
        return found

    def _new(self, words: pa.Array) -> pa.Array:
        """Ids of words that are not kept; they are from now on."""
        found = pa.array(self._learn(words.to_pylist()), pa.large_binary())
        ids, uses, last = self.facts["kept"]
        self.kept = pa.concat_arrays([self.kept, words])
        more = np.full(len(words), self.slices, np.int32)
        self.facts["kept"] = (
            pa.concat_arrays([ids, found]), np.append(uses, np.ones_like(more)), np.append(last, more)
        )
        if self._size("kept") > self.kept_bytes / 2:
            self._clear()
        return found

    def _size(self, name: str) -> int:
        words, ids = getattr(self, name), self.facts[name][0]
        return WORD_BYTES * len(words) + sum(pc.sum(pc.binary_length(a)).as_py() or 0 for a in (words, ids))

    def _clear(self) -> None:
        """Keep half of what may be kept: words met in several slices first, then those met last."""
        words = pa.concat_arrays([self.older, self.kept])
        ids, uses, last = zip(self.facts["older"], self.facts["kept"])
        ids, uses, last = pa.concat_arrays(ids), np.concatenate(uses), np.concatenate(last)
        sizes = WORD_BYTES + pc.add(pc.binary_length(words), pc.binary_length(ids)).to_numpy()
        order = np.lexsort((last, uses > 1))[::-1]
        best = np.sort(order[np.cumsum(sizes[order]) <= self.kept_bytes / 2])
        self.older = words.take(pa.array(best))
        self.kept = NO_WORDS
        self.facts = {"kept": NO_FACTS, "older": (ids.take(pa.array(best)), uses[best], last[best])}

    def _slice(self, texts: Sequence[str]) -> Iterator[bytes]:
        cut, lists = self.words(pa.array(texts, pa.large_string()))
        words = lists.flatten().dictionary_encode()
        found = self._of(words.dictionary).take(words.indices)
        _, offsets, raw = found.buffers()
        ends, counts, start = np.frombuffer(offsets, np.int64), iter(lists.value_lengths().to_pylist()), 0
        for text, is_cut in zip(texts, cut):
            if is_cut:
                stop = start + next(counts)
                first = int(ends[start]) + 4 * self.before
                yield raw.slice(first, int(ends[stop]) - first).to_pybytes()
                start = stop
            else:
                yield self.ids(text).tobytes()

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        out: list[bytes] = []
        while len(out) < len(texts):
            start = len(out)
            most = CHARS_AT_ONCE + (ends[start - 1] if start else 0)
            stop = min(start + TEXTS_AT_ONCE, max(start + 1, int(np.searchsorted(ends, most, "right"))))
            out += self._slice(texts[start:stop])
            pa.default_memory_pool().release_unused()  # words of a slice, which would add up with other stages
        return out


class SpacelessWords(WordIds):
    """For a tokenizer that drops white space. The separator is a NUL between spaces."""

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES):
        super().__init__(path, kept_bytes)
        (self.nul,) = self.ids("\x00").tolist()

    def words(self, texts: pa.Array) -> tuple[list[bool], pa.ListArray]:
        plain = pc.match_substring_regex(texts, PLAIN)
        special = pc.match_substring(texts, "<|")
        cut, some = pc.and_not(plain, special).to_pylist(), texts
        if not all(cut):
            # str.split also cuts at the four separators U+001C to U+001F, the tokenizer does not
            spaced = [
                t if p else "" if s or any(c in t for c in SEPARATORS) else " ".join(t.split())
                for t, p, s in zip(texts.to_pylist(), cut, special.to_pylist())
            ]
            cut, some = [t != "" for t in spaced], pa.array([t for t in spaced if t], pa.large_string())
        return cut, pc.split_pattern(pc.replace_substring(some, "\n", " "), " ")

    def _separated(self, words: Sequence[str]) -> tuple[str, int]:
        return "".join(["\x00 " + w + " " for w in words]), self.nul


class SpacedWords(WordIds):
    """For a byte-level tokenizer, which puts a single space at the head of the next word.

    The separator is a line break. Texts with other white space, or two in a row, stay whole.
    """

    before = 1  # the line break that no text has before its first word

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES):
        super().__init__(path, kept_bytes)
        (self.newline,) = self.ids("\n").tolist()
        self.break_bytes = np.uint32(self.newline).tobytes()

    def words(self, texts: pa.Array) -> tuple[list[bool], pa.ListArray]:
        cut = pc.and_not(pc.match_substring_regex(texts, PLAIN), pc.match_substring(texts, "<|"))
        some = pc.replace_substring(texts.filter(cut), "\n", " \n")
        first, none = (pa.scalar(c, pa.large_string()) for c in ("\n", ""))
        return cut.to_pylist(), pc.split_pattern(pc.binary_join_element_wise(first, some, none), " ")

    def _separated(self, words: Sequence[str]) -> tuple[str, int]:
        return "".join([w if w[0] == "\n" else "\n " + w for w in words]), self.newline

    def _alone(self, word: str) -> str:
        return word[1:] if word[0] == "\n" else " " + word

    def _finished(self, words: list[str], ids: list[bytes]) -> list[bytes]:
        return [self.break_bytes + found if word[0] == "\n" else found for word, found in zip(words, ids)]
