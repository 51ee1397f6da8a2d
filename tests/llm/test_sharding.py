import zlib

import numpy as np
from hypothesis import given, settings, strategies as st
from samples import TEXTS, documents, empty_documents, rows_of, with_clashes

from reviewmill.llm import sharding


def check(found, texts, shards):
    assert len(found) == len(texts)
    by_text = {}
    for key, size, crc, shard, slot in found:
        text = next(t or "" for k, t, *_ in texts if k == key)
        assert (size, crc) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
        assert by_text.setdefault(text, shard) == shard
    for number in range(shards):
        slots = sorted(slot for *_, shard, slot in found if shard == number)
        assert slots == list(range(len(slots)))


def test_edge_rows(spark):
    found = sharding.shard_documents(documents(spark), 3).collect()
    check([tuple(r) for r in found], TEXTS, 3)


def test_tree_of_many_chunks_and_blocks(spark):
    rows = [(i, f"text {i % 700} " * (i % 23), "en") for i in range(3000)]
    found = sharding.shard_documents(documents(spark, rows), 8, chunk_groups=40, fan_in=4, per_block=100)
    found = [tuple(r) for r in found.collect()]
    check(found, rows, 8)
    loads = np.bincount([r[3] for r in found], [r[1] for r in found])
    assert loads.max() - loads.min() <= 0.02 * loads.mean()


def test_a_group_with_a_third_of_all_rows_stays_whole(spark):
    rows = [(i, "copy " * 50 if i % 3 == 0 else f"other {i}", "en") for i in range(300)]
    check([tuple(r) for r in sharding.shard_documents(documents(spark, rows), 4).collect()], rows, 4)


def test_extra_columns_and_empty_table(spark):
    plain = rows_of(sharding.shard_documents(documents(spark), 3))
    assert rows_of(sharding.shard_documents(with_clashes(documents(spark)), 3)) == plain
    assert sharding.shard_documents(empty_documents(spark), 3).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=40), st.integers(2, 5))
def test_differencing_places_what_it_sums(sizes, shards):
    parts = np.zeros((len(sizes), shards), dtype=np.int64)
    parts[:, 0] = sizes
    place, total = sharding.differencing(parts)
    assert (np.sort(place, axis=1) == np.arange(shards)).all()
    assert np.bincount(place[:, 0], sizes, shards).astype(int).tolist() == total.tolist()
    assert total.max() - total.min() <= max(sizes)


def test_differencing_beats_greedy_where_it_should():
    parts = np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]])
    _, total = sharding.differencing(parts)
    assert sorted(total.tolist()) == [14, 16]
