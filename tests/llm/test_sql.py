"""Queries with an SQL equivalent give the same rows and types."""

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.mark.parametrize("name", ["op2_warc", "op5_embedding_dedup", "op10_minhash"])
def test_equals_sql(spark, name):
    from tidelog.llm.queries import ORACLE_SQL, QUERIES

    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, SF), db.sql(ORACLE_SQL[name])
    assert {c: KINDS[t] for c, t in ours.dtypes} == dict(zip(theirs.columns, map(str, theirs.types)))
    at = [theirs.columns.index(c) for c in ours.columns]
    assert sorted(map(tuple, ours.collect())) == sorted((tuple(r[i] for i in at) for r in theirs.fetchall()))


def test_sql_of_links(spark):
    """The smallest tables hold few links, so both sides are compared on rows with chains and ties as well."""
    from tidelog.llm import embedding_dedup
    from tidelog.llm.queries import ORACLE_SQL

    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.15], 1), (3, [1.0, 0.3], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, [0.0, 0.0], 1), (7, None, 1), (8, [1.0, None], 1), (9, [2.0, 0.0], 1), (10, [float("nan"), 1.0], 1), (9, [2.0, 0.0], 1), (3, [1.0, 0.3], 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.links(docs).collect()}
    db = duckdb.connect()
    db.execute("create table embeddings (vec_id bigint, embedding float[], label int)")
    db.executemany("insert into embeddings values (?, ?, ?)", rows)
    assert {a: (n, c, k) for a, n, c, k in db.sql(ORACLE_SQL["op5_embedding_dedup"]).fetchall()} == got
    assert got[1] == (2, 1, True) and got[2] == (3, 1, False) and got[3] == (1, 1, False) and got[9][1] == 1
