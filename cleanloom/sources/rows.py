"""Row numbers that follow the order of the source, without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RID = "_rid"
#: A block has 4,096 values of _rid, and a span as many blocks: a table of 10**12 rows has some 60,000 spans.
BLOCK = 12
SPAN = 12
#: Tasks a core over which `spread` deals rows.
TASKS = 4


def with_order(df: DataFrame) -> DataFrame:
    """df with _rid, which grows in the order of the scan (not contiguous)."""
    return df if RID in df.columns else df.withColumn(RID, F.monotonically_increasing_id())


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key over all cores, for work that is costly a row: Spark reads a file's row group, a million rows or so, in one task."""
    return df.repartition(TASKS * df.sparkSession.sparkContext.defaultParallelism, key)


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """df with contiguous numbers from 0 in the order of _rid.

    Rows are counted for each block of 2**BLOCK values of _rid, blocks are added up within spans of 2**SPAN blocks (a row a span,
    broadcast), and rows are ranked within their block. So a recomputed task gives the same numbers, and rows lie in as many tasks
    as they have blocks, which the work that follows is spread over.
    """
    keyed = df.withColumn("_block", F.shiftright(F.col(RID), BLOCK))
    sizes = keyed.groupBy("_block").count().withColumn("_span", F.shiftright("_block", SPAN))
    spans = sizes.groupBy("_span").agg(F.sum("count").alias("_rows"))
    earlier = spans.select(F.col("_span").alias("_in"), (F.sum("_rows").over(Window.orderBy("_span")) - F.col("_rows")).alias("_earlier"))
    started = sizes.withColumn("_before", F.sum("count").over(Window.partitionBy("_span").orderBy("_block")) - F.col("count"))
    before = started.join(F.broadcast(earlier), F.col("_span") == F.col("_in")).select(F.col("_block").alias("_at"), (F.col("_earlier") + F.col("_before")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(RID)) - 1
    out = keyed.withColumn("_inside", inside).join(before, F.col("_block") == F.col("_at"))
    return out.select(*df.columns, (F.col("_before") + F.col("_inside")).alias(name))
