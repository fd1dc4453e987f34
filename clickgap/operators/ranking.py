"""Row numbers of a whole sorted table (T5-T7) without a one-partition
window: rows are dealt to partitions by ranges of the sort key and sorted
there; a row's place is its number in its partition plus the rows of the
partitions before. Only the partition sizes (one row each) are collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickgap.session import materialize

_BITS = 33      # monotonically_increasing_id: partition above, row number below


def number_rows(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """``df`` + ``name``: 1, 2, ... in ``order``. Rows that are equal in
    every sort key get neighbouring places in any order."""
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(sorted_rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", _BITS)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return rows.withColumn("_part", part).join(F.broadcast(before), "_part") \
        .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1)) + 1) \
        .drop("_part", "_at", "_before")
