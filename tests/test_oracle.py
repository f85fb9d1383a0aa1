"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from folders import FOLDER

from quarrylens.plans import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    yield connection
    connection.close()


def _plain(value):
    if isinstance(value, float) and value == 0:
        return 0.0
    return tuple(_plain(v) for v in value) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sql, name):
    query = QUERIES[name]
    frame = query.run(spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted((tuple(_plain(row[c]) for c in columns) for row in frame.collect()), key=repr)
    if query.sql is None:
        assert got
        return
    found = sql.execute(query.sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(_plain(row[names.index(c)]) for c in columns) for row in found.fetchall()), key=repr)
    assert got == want


# The same rows must come out whatever the sample proposes as cut points.
LARGE = ("group_aggregate_median", "group_median_nullkey", "numeric_stats", "iqr_outliers_gaps", "histogram_auto",
         "box_by_group", "box_by_many_groups", "quantile_bin", "outlier_rows", "quality_score")


@pytest.mark.parametrize("name", LARGE)
def test_large_path_equals_sql(spark, sql, large_path, name):
    test_query_equals_sql(spark, sql, name)
