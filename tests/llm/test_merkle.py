import hashlib
import zlib

import pytest
from pyspark.sql import functions as F
from samples import DOCUMENT, TEXTS, documents, empty_documents, rows_of, with_clashes

from reviewmill.llm import merkle
from reviewmill.llm.queries import QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def naive_leaf(row):
    texts = [None if v is None else str(v) for v in row]
    return sha("".join("-" if t is None else f"{len(t.encode())}:{t}" for t in texts))


def naive_tree(leaves):
    """Root, and the siblings of every leaf as (left, right) by level."""
    paths, owners, nodes = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(nodes) > 1:
        above, owned = [], []
        for start in range(0, len(nodes), 3):
            run = nodes[start : start + 3]
            for k in range(len(run)):
                for leaf in owners[start + k]:
                    paths[leaf].append((run[:k], run[k + 1 :]))
            above.append(sha("".join(run)))
            owned.append([leaf for k in range(len(run)) for leaf in owners[start + k]])
        nodes, owners = above, owned
    return nodes[0], paths


def naive(rows, drop):
    """Expected row of each (doc_id, source, lang, n_chars, text)."""
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subroots, found = [], []
    for source in sources:
        members = sorted(by_source[source], key=lambda r: (r[0] is not None, r[0] or 0, naive_leaf(r)))
        subroot, paths = naive_tree([naive_leaf(r) for r in members])
        subroots.append(subroot)
        found.append((members, paths))
    root, tops = naive_tree(subroots)
    out = []
    for subroot, (members, paths), top in zip(subroots, found, tops):
        for row, path in zip(members, paths):
            digest = naive_leaf((*row[:4], row[4].replace("\n", "") if row[4] is not None and drop(row[0]) else row[4]))
            for left, right in path + top:
                digest = sha("".join(left) + digest + "".join(right))
            proof = sha("".join("".join(left + right) for left, right in path + top))
            out.append((row[0], naive_leaf(row), subroot, root, proof, digest, digest == root))
    return sorted(out, key=repr)


def even(key):
    return key is not None and zlib.crc32(str(key).encode()) % 2 == 0


def over(spark, monkeypatch, docs):
    monkeypatch.setattr("reviewmill.llm.queries.table", lambda *_: docs)
    return rows_of(QUERIES["op13_merkle_manifest"](spark, ""))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")


@pytest.mark.parametrize(
    "sizes, held", [([1], 0), ([4], 0), ([1, 1], 0), ([1, 1, 1, 1], 0), ([100, 9, 10, 1, 2, 27, 3], 0), ([28, 1, 3], merkle.HELD_BYTES)]
)
def test_sources_of_all_sizes(spark, monkeypatch, sizes, held):
    monkeypatch.setattr(merkle, "HELD_BYTES", held)
    rows = [
        (1000 * s + i, None if s == 1 else f"sé{(7 * s) % 10}", "en", i, f"text\n{i}" if i % 3 else f"text {i}")
        for s, size in enumerate(sizes)
        for i in range(size)
    ]
    assert over(spark, monkeypatch, frame(spark, rows).repartition(5)) == naive(rows, even)


def test_many_sources(spark, monkeypatch):
    rows = [(i, f"source {i % 83}", "en", None, f"{i}\n") for i in range(200)]
    assert over(spark, monkeypatch, frame(spark, rows)) == naive(rows, even)


def test_edge_rows_and_repeated_rows(spark, monkeypatch):
    rows = [(k, "src" if k != 3 else None, lang, len(t or ""), t) for k, t, lang in TEXTS + TEXTS[:4]]
    assert over(spark, monkeypatch, frame(spark, rows)) == naive(rows, even)


def test_a_key_with_a_third_of_all_rows(spark, monkeypatch):
    rows = [(5 if i % 3 == 0 else i, "s", "en", 1, "copy" if i % 2 else f"text\n{i}") for i in range(120)]
    assert over(spark, monkeypatch, frame(spark, rows).repartition(7)) == naive(rows, even)


def test_extra_columns_and_empty_table(spark, monkeypatch):
    plain = over(spark, monkeypatch, documents(spark))
    assert over(spark, monkeypatch, with_clashes(documents(spark)).withColumns({"n": F.lit(1), "tree": F.lit(2)})) == plain
    assert over(spark, monkeypatch, empty_documents(spark)) == []
    assert merkle.build(spark.createDataFrame([], DOCUMENT)).root is None


def test_a_column_of_its_own_choice(spark):
    docs = frame(spark, [(i, "s", "en", 1, f"t{i}") for i in range(10)])
    manifest = merkle.build(docs, ["text"], key="text")
    root, paths = naive_tree([sha(f"2:t{i}") for i in range(10)])
    assert manifest.root == root and manifest.sources.first().n == 10
    found = merkle.proofs(manifest).select("_key", merkle.proof_text(F.col("path")).alias("proof")).collect()
    assert {r["_key"]: r.proof for r in found} == {
        f"t{i}": "".join("".join(a + b) for a, b in path) for i, path in enumerate(paths)
    }


def test_query_over_the_test_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*merkle.COLUMNS)
    wanted = naive([tuple(r) for r in docs.collect()], even)
    found = rows_of(QUERIES["op13_merkle_manifest"](spark, sf_dir))
    assert found == wanted and 0 < sum(row[-1] for row in found) < len(found)
