import random
import re

import pytest
from samples import TEXTS, documents, empty_documents, rows_of, with_clashes

from reviewmill.llm import ngram_join
from reviewmill.llm.components import components
from reviewmill.operators import joins


def brute_force(rows, words, percent):
    def shingles(text):
        found = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if w]
        if len(found) < words:
            return {tuple(found)} if found else set()
        return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}

    sets = [(key, shingles(text)) for key, text, _ in rows]
    parent = {key: key for key, _ in sets}

    def find(key):
        while parent[key] != key:
            key = parent[key]
        return key

    for i, (a, own) in enumerate(sets):
        for b, other in sets[:i]:
            if a is not None and b is not None and own and other:
                if 100 * len(own & other) >= percent * len(own | other):
                    low, high = sorted((find(a), find(b)))
                    parent[high] = low
    return sorted([(key, len(s), find(key)) for key, s in sets], key=repr)


def edited(choose, text, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[choose.randrange(len(words))] = f"new{choose.randrange(10_000)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def groups():
    """Groups of copies of two to many, chains, shared passages, short texts, other texts."""
    choose = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = " ".join(choose.choices(vocabulary, k=60))
    rows = []
    for size in (2, 3, 5, 90):
        text = " ".join(choose.choices(vocabulary, k=choose.randrange(40, 200)))
        rows += [edited(choose, text, choose.randrange(0, 5)) for _ in range(size)]
    chain = " ".join(choose.choices(vocabulary, k=150))
    for _ in range(25):
        chain = edited(choose, chain, 2)
        rows.append(chain)
    rows += [" ".join(choose.choices(vocabulary, k=choose.randrange(1, 90))) for _ in range(60)]
    rows += [passage + " " + " ".join(choose.choices(vocabulary, k=n)) for n in range(0, 60, 2)]
    rows += ["short", "SHORT", "two words", "two  words", "three little words", "a b c d", "a b c d e"]
    rows += [" ".join(f"only{i}" for i in range(30)) + " end" + str(j) * (j % 3) for j in range(6)]
    choose.shuffle(rows)
    return [(3 * i, text, "en") for i, text in enumerate(rows)]


@pytest.mark.parametrize("words, percent", [(4, 85), (5, 80), (1, 50)])
def test_components_against_brute_force(spark, groups, words, percent):
    found = ngram_join.near_duplicates(documents(spark, groups), words=words, percent=percent)
    assert rows_of(found) == brute_force(groups, words, percent)


def test_short_and_long_sets_have_different_orders(spark, groups, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT", 40)
    found = ngram_join.near_duplicates(documents(spark, groups), words=4, percent=85)
    assert rows_of(found) == brute_force(groups, 4, 85)


def test_units_cut_into_small_blocks(spark, groups):
    found = ngram_join.near_duplicates(documents(spark, groups), words=4, percent=85, block_sets=6)
    assert rows_of(found) == brute_force(groups, 4, 85)


def test_edge_rows(spark):
    wanted = [(key, size, group if key is not None else None) for key, size, group in brute_force(TEXTS, 4, 85)]
    found = ngram_join.near_duplicates(with_clashes(documents(spark)), words=4, percent=85)
    assert rows_of(found) == wanted
    assert ngram_join.near_duplicates(empty_documents(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    docs = with_clashes(documents(spark))
    kept = ngram_join.keep_one(docs, words=4, percent=85)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 3, *range(4, 15), None], key=repr)


def test_repeated_keys_are_judged_by_their_texts(spark):
    same = "one two three four five six seven eight nine ten"
    rows = [(7, same, "en"), (7, "quite another text under the same key as before", "en"), (7, same, "en"), (9, same + " eleven", "en")]
    rows += [(3, same, "en"), (9, "and a third text that shares its key with a copy", "en"), (None, same, "en"), (9, "", "en"), (9, "", "en")]
    kept = ngram_join.keep_one(documents(spark, rows), percent=50)
    wanted = [(3, same), (7, rows[1][1]), (9, rows[5][1]), (9, ""), (9, "")]
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(wanted)


def test_tree_bounds_lose_nothing():
    choose = random.Random(3)
    import numpy as np

    grams = [np.unique(np.array(choose.choices(range(60), k=choose.randrange(1, 40)), np.uint64)) for _ in range(120)]
    measure = ngram_join.Measure(1, 60)
    every = list(range(len(grams)))
    joined = ngram_join.link_sets(grams, every, every, every, measure)
    parent = every[:]
    for i in every:
        for j in range(i):
            common = len(np.intersect1d(grams[i], grams[j]))
            if 100 * common >= 60 * (len(grams[i]) + len(grams[j]) - common):
                low, high = sorted((parent[i], parent[j]))
                parent = [low if p == high else p for p in parent]
    assert joined == parent


def test_components_of_paths_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    for held in (1000, 0):  # in one task, and in rounds of stars
        found = components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7), "a", "b", held)
        assert set(rows_of(found)) == {(i, 0) for i in range(1, 41)} | {(101, 100), (102, 100)}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_sets_with_enough_grams_of_their_own_are_not_compared(spark, monkeypatch):
    """A quarter of the n-grams has too few of their own to tell all of these apart."""
    choose = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(45))
    texts = [passage + " " + " ".join(f"own{i}_{j}" for j in range(170 + i % 5)) for i in range(80)]
    texts.append(edited(choose, texts[40], 2))
    rows = [(i, text, "en") for i, text in enumerate(texts)]
    given, blocked = [], ngram_join._blocked

    def counted(sets, *rest):
        given.append(sets.count())
        return blocked(sets, *rest)

    monkeypatch.setattr(ngram_join, "_blocked", counted)
    found = ngram_join.near_duplicates(documents(spark, rows), words=5, percent=80, block_sets=4)
    assert rows_of(found) == brute_force(rows, 5, 80)
    assert given[0] > 20  # the sets of one unit, cut into blocks
    assert given[-1] <= 2  # those compared across blocks


def test_keys_beyond_a_broadcast_give_the_same_groups(spark, groups, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    rows = groups + [(groups[0][0], "another text under a key that is there", "en"), (None, groups[1][1], "en"), groups[2]]
    docs = documents(spark, rows).withColumnRenamed("lang", "_map0")
    kept = ngram_join.keep_one(docs, words=4, percent=85)
    assert kept.columns == docs.columns
    firsts = {group for _, _, group in brute_force(groups, 4, 85)}
    wanted = [(key, text) for key, text, _ in groups if key in firsts] + [rows[-3][:2]]
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(wanted)


def test_rows_without_a_key_are_not_shuffled(spark, monkeypatch):
    wide = spark.range(20_000).selectExpr("id AS k", "concat('text ', id) AS text", "1 AS _map0")
    keys = spark.range(0, 20_000, 10).selectExpr("id AS k")
    likely, others = joins.split_by_keys(wide, keys, ["k"], 2_000)
    assert likely.join(keys, "k", "left_semi").count() == 2_000
    assert likely.count() < 2_000 + 0.06 * 18_000 and likely.count() + others.count() == 20_000
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    nothing = spark.createDataFrame([(None, "no key", 1)], "k bigint, text string, _map0 int")
    for how, rows in (("left_semi", 2_000), ("left_anti", 18_001), ("inner", 2_000)):
        found = joins.join_keys(wide.unionByName(nothing), keys, ["k"], how)
        assert found.count() == rows and found.columns == wide.columns
