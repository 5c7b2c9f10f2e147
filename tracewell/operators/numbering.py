"""Consecutive numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.columns import col
from tracewell.operators.blocks import BLOCK, rows_per_task
from tracewell.session import cut_lineage


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``name`` = 1..n in the order given; ``order`` must be total.

    The counted rows decide the number of ranges. They are cut by all order columns, so rows that agree in
    the first ones still part, numbered inside each range, and shifted by the sizes of the ranges before.
    """
    keys = [col(c) for c in order]
    fixed = cut_lineage(df)
    ranges = -(-fixed.count() // rows_per_task(df))
    if ranges <= 1:
        return fixed.withColumn(name, F.row_number().over(Window.orderBy(*keys)).cast("bigint"))
    # A row's id is its range and its place there. The ids are kept, so that both reads below agree.
    placed = cut_lineage(
        fixed.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    ).withColumn(BLOCK, F.shiftright("_place", 33))
    sizes = placed.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("_rows"))  # one row per range
    earlier = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(BLOCK, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    number = F.col("_offset") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(offsets), BLOCK).withColumn(name, number.cast("bigint")).drop(BLOCK, "_place", "_offset")
