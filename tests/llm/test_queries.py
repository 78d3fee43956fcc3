import os

import duckdb
import pytest

import corpus_pipeline
from trialmill.llm import queries, sql


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_agrees_with_sql(spark, data, name):
    con = duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{data}/{file}'")
    result = con.execute(sql.SQL[name])
    columns = [d[0] for d in result.description]
    df = queries.QUERIES[name](spark, data)
    assert sorted(df.columns) == sorted(columns)
    assert plain(map(tuple, df.collect()), df.columns) == plain(result.fetchall(), columns)


def test_pipeline_is_its_stages_one_by_one(spark, data):
    out = corpus_pipeline.run(spark, data).collect()
    assert out and {len(r.ids_sha256) for r in out} == {64}
    docs, sizes = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, data).cache()
        sizes.append((name, after.count()))
        if name != "byte_bpe":
            assert after.columns == docs.columns
        docs = after
    key = lambda r: (r.doc_id, r.ids_sha256)
    assert sorted(map(key, docs.collect())) == sorted(map(key, out))
    assert sizes[3][1] == sizes[4][1]


def test_pipeline_on_empty_tables(spark, data, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{data}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
