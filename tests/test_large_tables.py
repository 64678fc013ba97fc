"""Queries over tables and files that Spark reads in several tasks, or in one that has most rows."""

import contextlib

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from cleanloom.operators.structure import cell_errors
from cleanloom.plans.queries import contacts
from cleanloom.sources.rows import RID, numbered


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    """Customers with keys from 0, in one row group, as a folder of tables."""
    folder = str(tmp_path_factory.mktemp("customers"))
    spark.range(6000, numPartitions=1).select(F.col("id").alias("c_custkey"), F.lit(1.5).alias("c_acctbal")).write.parquet(f"{folder}/customer.parquet")
    return folder


@contextlib.contextmanager
def option(spark, name, value):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def test_single_file_read_in_several_tasks_keeps_its_numbers(spark, customers):
    with option(spark, "spark.sql.files.maxPartitionBytes", "40000"):
        rows = queries()["write_single"](spark, customers).collect()
    found = {r["at"]: r["SKU"] for r in rows}
    assert sorted(found) == list(range(6300))
    assert [found[k] for k in (1, 2, 5999, 6001, 6002)] == ["1", "2", "5999", "20", "40"]


def largest_share(df):
    """The share of rows that the task with most of them has."""
    tasks = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("rows"), F.max(F.hash(*df.columns)))  # all columns are made
    counts = [r["rows"] for r in tasks.collect()]
    return max(counts) / sum(counts)


def test_rows_of_one_row_group_are_dealt_over_all_cores(spark, customers):
    for name in ("phones_of_regions", "dates_free_form"):
        assert largest_share(queries()[name](spark, customers)) < 0.2, name


def test_cells_are_judged_where_rows_are_read_and_errors_keep_their_rows(spark):
    rows = spark.range(6000, numPartitions=3).select(F.when(F.col("id") % 1000 == 7, F.lit("seven")).otherwise(F.col("id").cast("string")).alias("whole"))
    found = cell_errors(rows)
    # Rows are dealt by their block for numbers; judging cells, which is costly, comes before that.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("is no integer") > plan.index("Window")
    assert sorted(tuple(r) for r in found.collect()) == [(k + 9, "whole", "type-error", "'seven' is no integer") for k in range(0, 6000, 1000)]


def test_types_are_measured_over_all_cores(spark, customers):
    assert largest_share(contacts(spark, customers)) < 0.2
    types = {r["column"]: (r["type"], r["cells"]) for r in queries()["column_types"](spark, customers).collect()}
    assert types["whole"] == ("integer", 6300) and types["day"] == ("date", 6300) and types["city"] == ("text", 6300)


def test_numbered_rows_lie_in_many_tasks_and_are_contiguous_over_spans(spark):
    with option(spark, "spark.sql.adaptive.enabled", "false"), option(spark, "spark.sql.shuffle.partitions", "16"):
        assert largest_share(numbered(spark.range(200_000, numPartitions=2).withColumnRenamed("id", RID))) < 0.3
    ids = [k * 3 for k in range(9000)] + [k << 22 for k in range(1, 40)] + [(1 << 33) + k for k in range(50)] + [(5 << 40) + 1]
    rows = numbered(spark.createDataFrame([(i,) for i in reversed(ids)], f"{RID} long"))
    assert [tuple(r) for r in rows.orderBy(RID).collect()] == [(i, k) for k, i in enumerate(sorted(ids))]
