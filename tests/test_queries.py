"""Every registered query of the library against its DuckDB oracle on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from crowdweave.plans import attach_queries, commit_queries, delivery_queries, file_queries, intake_queries, mapping_queries, page_queries, queries, stream_queries, text_queries, workflow_queries

assert attach_queries and commit_queries and delivery_queries and file_queries and intake_queries and mapping_queries and page_queries and stream_queries and text_queries and workflow_queries  # their queries are registered when they are imported

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    frame = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    if name not in queries.ORACLE_SQL:
        return
    cursor = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert found == expected
