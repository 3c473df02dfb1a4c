"""The pipeline: each stage's decisions take effect, columns stay, and run() applies the stages."""

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keepset.llm import catalog, quality, simhash, templates
from keepset.runtime import Scratch
from tests.llm.test_operators import empty, odd  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stages"))
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(docs)
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return [*out, docs]


def test_columns(written):
    for docs in written[:-1]:
        assert docs.columns == written[0].columns


def test_rejected_documents_go(spark, written):
    judged = quality.score(written[0], quality.fit(written[0], spark.read.parquet(f"{FOLDER}/labels.parquet")))
    assert {r[0] for r in judged.where("kept").select("doc_id").collect()} == {r[0] for r in written[1].select("doc_id").collect()}
    assert written[1].exceptAll(written[0]).isEmpty()


def test_lines_stand_in_one_document_only(written):
    line = F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")
    assert written[2].count() == written[1].count()
    assert written[2].select("doc_id", line).where(F.col("line").rlike("[^\\x20\\x09-\\x0D]")).groupBy("line").count().where("count > 1").isEmpty()


def test_one_of_each_group(spark, written):
    scratch = Scratch(spark, "test")
    groups = simhash.near_duplicates(written[2], scratch)
    want = {r[0] for r in groups.select("component_id").distinct().collect()}
    assert {r[0] for r in written[3].select("doc_id").collect()} == want
    scratch.release()


def test_no_item_is_left(spark, written):
    scratch = Scratch(spark, "test")
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert templates.matches(written[4], items, scratch).isEmpty() and not templates.matches(written[3], items, scratch).isEmpty()
    scratch.release()


def test_all_ids_are_packed(written):
    assert {r[0] for r in written[5].select("doc_id").distinct().collect()} == {r[0] for r in written[4].select("doc_id").collect()}


def test_run_gives_the_same_rows(spark, written):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = lambda df: sorted(map(tuple, df.groupBy("doc_id", "doc_tokens").agg(F.sum("length")).collect()))
    got = corpus_pipeline.run(spark, FOLDER)
    assert set(columns) <= set(got.columns) and whole(got) == whole(written[-1])


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, odd, empty, name):
    """Nulls, empty and long texts, repeated rows and columns whose names the stages use themselves."""
    stage = dict(corpus_pipeline.STAGES)[name]
    for folder in (odd, empty):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        out = stage(spark, docs, folder)
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
        if folder == empty:
            assert not rows
        elif name == "line dedup":
            assert len(rows) == docs.count()
        elif name == "packing":
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", x)[1]) for x in catalog.queries()) == list(range(1, 11))
