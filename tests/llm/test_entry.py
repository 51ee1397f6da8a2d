"""The queries of this package as the driver sees them."""

import re

import __spark_entry__ as driver
import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from samples import DOCUMENT, TEXTS, documents, with_clashes

from reviewmill.llm.queries import QUERIES


def test_every_operator_is_registered():
    names = set(driver.queries())
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= names


def test_the_rest_does_not_import_this_package():
    import pathlib

    root = pathlib.Path(driver.__file__).parent / "reviewmill"
    others = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert others and not any("reviewmill.llm" in p.read_text() or "corpus_pipeline" in p.read_text() for p in others)


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage makes of the edge rows with extra columns."""
    docs = with_clashes(documents(spark, TEXTS + [(50 + i, t, lang) for i, (_, t, lang) in enumerate(TEXTS[:3])]))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], ""))
    return out


def test_stages_keep_clean_documents_and_columns(stages):
    docs, language, single, masked, packed = stages
    assert language.schema == docs.schema and single.schema == docs.schema and masked.columns == docs.columns
    ids = [sorted((r.doc_id for r in s.select("doc_id").collect()), key=repr) for s in (language, single, masked)]
    assert not {4, 5, 6, 7} & set(ids[0]) and {1, 2, 3, 8, 10, 14, None} <= set(ids[0])
    assert {1, 3, 10, 14, None} <= set(ids[1]) and not {2, 50, 51, 52} & set(ids[1])
    assert ids[1] == ids[2]
    texts = {r.doc_id: r.text for r in masked.select("doc_id", "text").collect()}
    assert "[EMAIL]" in texts[14] and "[IP]" in texts[14]
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(ids[2])


def test_no_documents(spark):
    docs = spark.createDataFrame([], DOCUMENT)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_run_over_the_test_tables(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    sums = found.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert sums.where("n <> end OR n > 2048").count() == 0
    assert found.count() > 100
