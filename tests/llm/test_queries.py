"""The registered queries against their SQL, and the pipeline's stages one by one."""

import math
import os

import duckdb
import pytest

import corpus_pipeline
from kestrata.llm.oracle import ORACLE_SQL
from kestrata.llm.queries import QUERIES


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted(names), sorted((tuple(clean(r[i]) for i in order) for r in values), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for f in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    df = QUERIES[name](spark, sf_dir)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(ORACLE_SQL[name])
    assert found == rows([d[0] for d in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_one_row_a_document(spark, sf_dir, name):
    ids = [r.doc_id for r in QUERIES[name](spark, sf_dir).select("doc_id").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())


def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        if name != "mixing":
            assert n * 0.5 < docs.count() <= n
            n = docs.count()
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() == docs.count() and {"doc_id", "shard", "slot"} <= set(out.columns)
