"""Numbering the rows of a table in an order, without a window over the table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import new_path

#: Rows that one range holds, about.
ROWS = 1_000_000


def numbered(df: DataFrame, order: Sequence[str], rows: int = ROWS, column: str = "_at") -> DataFrame:
    """`df` with its place, from 0, in the order of columns that tell rows apart; NULLs come first.

    Rows are dealt into sorted ranges by all order columns, about `rows` to a range, so that no value is too frequent for
    one, and written to the shared folder with their place in the range; the ranges' counts give offsets.  What is done for
    a row does not depend on the number of ranges.
    """
    spark = df.sparkSession
    ranges = max(1, math.ceil(df.count() / rows))
    path = new_path(spark)
    placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_ranked", F.monotonically_increasing_id())
    placed.write.parquet(path)
    kept = spark.read.schema(placed.schema).parquet(path)
    part, rank = F.shiftright("_ranked", 33), F.col("_ranked").bitwiseAND((1 << 33) - 1)  # of the range, and in it
    sizes = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    before = sizes.select("_part", F.coalesce(earlier, F.lit(0)).alias("_before"))
    joined = kept.withColumns({"_part": part, "_rank": rank}).join(before, "_part")
    return joined.withColumn(column, F.col("_before") + F.col("_rank")).drop("_part", "_rank", "_before", "_ranked")
