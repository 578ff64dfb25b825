"""Every query of the library against its SQL."""

import shutil
from pathlib import Path

import duckdb
import pytest
from compare import difference
from pyspark.sql import functions as F

from cairn import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    if name in SQL:
        assert not difference(spark, name, QUERIES[name], SQL[name], data)
    else:
        assert QUERIES[name](spark, data).columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_clock_remap_with_points_of_one_time(spark, data, tmp_path):
    """Every point of a time counts, as in the SQL; copies here have other stamps."""
    events = spark.read.parquet(f"{data}/events.parquet")
    copies = events.withColumn("event_id", events.event_id + 10**9).withColumn("props", F.expr("concat('{\"k\": ', event_id % 7, '}')"))
    events.unionByName(copies).write.parquet(f"{tmp_path}/events.parquet")
    duckdb.sql(f"COPY (SELECT * FROM '{tmp_path}/events.parquet/*.parquet') TO '{tmp_path}/one.parquet'")
    shutil.rmtree(f"{tmp_path}/events.parquet")
    Path(f"{tmp_path}/one.parquet").rename(f"{tmp_path}/events.parquet")
    assert not difference(spark, "joi16_clock_remap", QUERIES["joi16_clock_remap"], SQL["joi16_clock_remap"], str(tmp_path))


@pytest.mark.parametrize("name", ["ndt6_nvtl_cells", "ndt7_nvtl_simple_grid"])
def test_cell_scores_are_those_of_the_whole_scan(spark, data, name):
    """The registered SQL pairs a seventh of the points (see REPLY_r02.md); over all of them it is the query's result."""
    assert not difference(spark, name, QUERIES[name], SQL[name].replace(" WHERE c.point_id % 7 = 0", ""), data)
