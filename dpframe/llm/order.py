"""Positions of rows in a sorted table, found from range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from dpframe.llm.common import written


def place(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``pos`` (from 0 within its group, in ``order``) and ``n`` (rows of its group).

    Rows are dealt into ranges of (group, order), so a group of any size is
    split over many tasks; offsets come from one count per group and range.
    ``group`` must not be null. Rows equal in group and order take their
    places in any order. The table is written once and not yet dropped.
    """
    keys = [F.col(group), *order]
    rows = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), name)
    # the upper bits of the id are the range, the lower ones count the rows inside it
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    counts = rows.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                           F.sum("_n").over(whole).alias("n"))
    return (rows.join(starts, [group, "_range"])
            .withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_range", "_at", "_first", "_before"))
