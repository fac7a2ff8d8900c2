"""Registered queries on small tables of odd rows, against their SQL."""

import os

import duckdb

from __spark_entry__ import oracle_sql, queries


def _equal(spark, d, name):
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{d}/{f}/*.parquet')")
    want = con.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    wanted = sorted(want.fetchall(), key=repr)
    got = sorted((tuple(r) for r in queries()[name](spark, str(d)).select(*columns).collect()), key=repr)
    assert got == wanted and got


def test_body_variants_of_an_answer_that_ends_with_a_quote(spark, tmp_path):
    texts = ['x = "', 'token = "23456789012345678901234567890', '"', 'a "b" c', '"all of it"', "", "01234567890123456789012345678\" and more"]
    rows = [(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate((t, g) for t in texts for g in ("en", "de"))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    _equal(spark, tmp_path, "body_variants")
