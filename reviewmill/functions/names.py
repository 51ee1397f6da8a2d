"""Task-side search for names in texts, by a tree of their words.

These functions run in the Python workers. The module is pickled by value (see ``operators.requests``), so
workers need no copy of this package.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd

END = ""  # no word; holds the names that end at a node


def word_tree(names: Iterable[tuple[str, str]]) -> dict:
    """Nested dictionaries of words, from pairs of normal text and name."""
    tree: dict = {}
    for gram, name in names:
        node = tree
        for word in gram.split(" "):
            node = node.setdefault(word, {})
        node.setdefault(END, set()).add(name)
    return tree


def names_in(text: str, tree: dict) -> list[str]:
    """Names in a normal text: from every word the tree is followed as far as it goes."""
    found: set[str] = set()
    words = text.strip(" ").split(" ")
    for start, word in enumerate(words):
        node = tree.get(word)
        after = start + 1
        while node is not None:
            if END in node:
                found |= node[END]
            node = node.get(words[after]) if after < len(words) else None
            after += 1
    return sorted(found)


def search(shared):
    """Function over a batch of normal texts; ``shared`` is a broadcast tree."""

    def run(texts: pd.Series) -> pd.Series:
        tree = shared.value
        return pd.Series([None if text is None else names_in(text, tree) for text in texts], dtype=object)

    return run
