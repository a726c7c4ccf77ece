import os

import pytest

from marlgraph.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_p1_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW entity_embeddings AS SELECT * FROM '{FOLDER}/entity_embeddings.parquet'")
    want = set(con.execute(queries.sql()["p1_found"]).fetchall())
    assert set(map(tuple, queries.p1_found(spark, FOLDER).collect())) == want and want


def test_p8_covers_every_document(spark):
    rows = queries.p8_ids(spark, FOLDER)
    assert rows.columns == ["doc_id", "ids"] and rows.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert rows.where("ids IS NULL").count() == 0


def test_p9_columns(spark):
    assert queries.p9_found(spark, FOLDER).columns == ["doc_id", "item_id"]


def test_p9_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("documents", "eval_items"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    want = set(con.execute(queries.sql()["p9_found"]).fetchall())
    exact = set(map(tuple, queries.p9_found(spark, FOLDER).collect()))
    assert exact == want and want and exact <= set(map(tuple, queries.p9_edits(spark, FOLDER).collect()))
