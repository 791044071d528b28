"""Every query with SQL against that SQL in DuckDB, on the smallest tables; every other query runs and has rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from weft import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return repr(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("copies", [4, 1200])
def test_blocking_metrics_equal_sql_with_and_without_blocks(spark, tmp_path, copies):
    """Signatures that more records share than allowed make no block, and SQL then has no row."""
    rows = [(k, "pen", "B", "T", 1, 2.0) for k in range(copies)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(
        str(tmp_path / "part.parquet")
    )
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    df = catalog.QUERIES["blocking_metrics"](spark, str(tmp_path))
    want = con.execute(catalog.ORACLES["blocking_metrics"])
    names = [d[0] for d in want.description]
    got = [tuple(r[n] for n in names) for r in df.collect()]
    assert got == want.fetchall()
    assert len(got) == (0 if copies == 1200 else 1)


def test_stream_counts(spark, tmp_path):
    from weft.operators.tokens import term_frequency
    from weft.queries.base import documents
    from weft.streaming import counts

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = counts.read_stream(spark, str(tmp_path / "in"), "doc_id long, text string, lang string, source string, n_chars long")
    query = counts.to_memory(counts.token_counts(stream, "text"), "token_counts")
    try:
        query.processAllAvailable()
        got = {(r["token"], r["freq"]) for r in spark.table("token_counts").collect()}
    finally:
        query.stop()
    assert got == {tuple(r) for r in term_frequency(documents(spark, SF)).collect()}
    query = counts.to_table(counts.token_counts(stream, "text"), str(tmp_path / "out"), str(tmp_path / "state"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_windowed_stream(spark, tmp_path):
    from weft.streaming import counts

    rows = [(f"2024-01-01 0{h}:10:00", "a b a") for h in range(3)]
    spark.createDataFrame(rows, "t string, text string").selectExpr("cast(t AS timestamp) AS ts", "text").write.parquet(str(tmp_path / "in"))
    stream = counts.read_stream(spark, str(tmp_path / "in"), "ts timestamp, text string")
    query = counts.to_memory(counts.windowed_counts(stream, "text", "ts"), "windows", "update")
    try:
        query.processAllAvailable()
        got = sorted((r["start"].hour, r["token"], r["freq"]) for r in spark.table("windows").collect())
    finally:
        query.stop()
    assert got == sorted((h, t, n) for h in range(3) for t, n in (("A", 2), ("B", 1)))
