import os

import duckdb
import pytest

import corpus_pipeline
from waylark.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    cursor = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in cursor.description]
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str(tuple(r[c] for c in sorted(columns))) for r in df.collect()) == sorted(str(tuple(r[columns.index(c)] for c in sorted(columns))) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op11_source_divergence"}))  # which has rows of groups
def test_a_row_for_each_document(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    table, key = {"op3": ("pages", "page_id"), "op5": ("embeddings", "media_id"), "op10": ("conversations", "turn"), "op13": ("embeddings", "vec_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    n = spark.read.parquet(f"{DATA}/{table}.parquet").count()
    assert df.select(key).distinct().count() == n if name.startswith("op7") else df.count() == n or name.startswith("op10")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = os.fspath(tmp_path / name)
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before
