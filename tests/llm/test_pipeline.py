"""The pipeline's stages on awkward documents, and every registered query."""

from __future__ import annotations

import os

import duckdb
import pytest
from fixtures import awkward, empty

import corpus_pipeline
from siftwood.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A table folder whose documents are the awkward ones."""
    at = str(tmp_path_factory.mktemp("sf"))
    awkward(spark).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        assert docs.count() <= before
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 0


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_empty(spark, folder, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", [*queries.ORACLES])
def test_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    want = c.execute(queries.ORACLES[name])
    columns = sorted(x[0] for x in want.description)
    assert sorted(df.columns) == columns
    told = lambda rows, names: sorted(repr([r[names.index(x)] for x in columns]) for r in rows)
    assert told([tuple(r) for r in df.collect()], df.columns) == told(want.fetchall(), [x[0] for x in want.description])
