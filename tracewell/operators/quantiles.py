"""Exact percentiles from a histogram of values, never from all values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.columns import col
from tracewell.operators.blocks import BLOCK, slice_points, with_block
from tracewell.operators.lookup import settled


def number(name: str) -> Column:
    """A column as a double whose missing cells, null or NaN, are null."""
    value = col(name).cast("double")
    return F.when(~F.isnan(value), value)


def number_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, times``: how often each number occurs, without missing cells; computed once.

    Equal values are counted before the shuffle, so a common value is one row.
    """
    cells = [F.struct(F.lit(c).alias("column"), number(c).alias("value")) for c in columns]
    long = df.select(F.inline(F.array(*cells))).where("value IS NOT NULL")
    return settled(long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("times")))


def percentiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """Linear-interpolated percentiles, one row per column: ``column`` and ``values`` in share order.

    Null and NaN count as missing, and a column of missing cells only has null values.
    """
    return percentiles_of(number_counts(df, columns), columns, shares)


def percentiles_of(histogram: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """Percentiles from ``number_counts``. The histogram is cut into ordered blocks, and only the blocks that hold a
    wanted rank are ordered."""
    points = settled(slice_points(histogram, "column", F.col("value")))  # one row per column
    blocked = with_block(histogram.join(F.broadcast(points), "column"), F.col("value"))
    counts = blocked.groupBy("column", BLOCK).agg(F.sum("times").alias("rows"))
    before = Window.partitionBy("column").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy("column")
    placed = counts.select(
        "column", BLOCK, "rows",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"),
        F.sum("rows").over(total).alias("total"),
    )
    wanted = F.explode(
        F.flatten(
            F.array(*[
                F.array(F.floor((F.col("total") - 1) * F.lit(s)), F.ceil((F.col("total") - 1) * F.lit(s)))
                for s in shares
            ])
        )
    )
    # At most two ranks per share and column: a handful of rows.
    targets = (
        placed.select("*", wanted.alias("rank"))
        .where("rank >= offset AND rank < offset + rows")
        .groupBy("column", BLOCK)
        .agg(F.first("offset").alias("offset"), F.first("total").alias("total"), F.collect_set("rank").alias("ranks"))
    )
    inside = Window.partitionBy("column", BLOCK).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("offset") + F.sum("times").over(inside)
    picked = (
        blocked.join(F.broadcast(targets), ["column", BLOCK])
        .withColumn("_upto", upto)
        .withColumn("rank", F.explode(F.filter("ranks", lambda r: (r >= F.col("_upto") - F.col("times")) & (r < F.col("_upto")))))
    )
    by_rank = picked.groupBy("column").agg(
        F.first("total").alias("total"), F.map_from_entries(F.collect_set(F.struct("rank", "value"))).alias("at")
    )
    values = []
    for s in shares:
        exact = (F.col("total") - 1) * F.lit(s)
        low = F.element_at("at", F.floor(exact))
        high = F.element_at("at", F.ceil(exact))
        values.append(low + (high - low) * (exact - F.floor(exact)))
    found = by_rank.select("column", F.array(*values).alias("values"))
    names = histogram.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    nothing = F.array(*[F.lit(None).cast("double") for _ in shares])
    return names.join(found, "column", "left").select("column", F.coalesce("values", nothing).alias("values"))
