"""Find hot groups, and cut ordered values into blocks, so that no task ever has to hold one whole.

A window over ``PARTITION BY case ORDER BY time`` puts a case into one task. That is right for the
millions of short cases of a log and wrong for a case (a batch user, a default id) that holds a large
share of all events. Hot groups are found by counting. Values are cut into blocks by 32 equi-depth slices
from a mergeable quantile sketch, each cut again into equal steps; the borders only place the work.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.columns import col, epoch_micros
from tracewell.operators.lookup import settled

BLOCK = "_block"
SLICES = 32
STEPS = 64

# A group beyond this many rows is cut into blocks.
ROWS_PER_TASK = 1_000_000

def rows_per_task(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("tracewell.rowsPerTask", str(ROWS_PER_TASK)))


# Counted once per table, key and limit, as several operators open the same log.
_FOUND: WeakKeyDictionary[DataFrame, dict] = WeakKeyDictionary()


def hot_keys(df: DataFrame, key: str) -> DataFrame | None:
    """The keys that hold more rows than a task should, as a table of ``key``; None where there is none.

    Every key is counted, merged ahead of the shuffle. The table has at most rows / limit rows.
    """
    limit = rows_per_task(df)
    found = _FOUND.setdefault(df, {})
    if (key, limit) not in found:
        counts = df.where(col(key).isNotNull()).groupBy(col(key)).agg(F.count(F.lit(1)).alias("_rows"))
        hot = settled(counts.where(F.col("_rows") > limit).select(col(key)))
        found[key, limit] = None if hot.isEmpty() else hot
    return found[key, limit]


def sort_number(df: DataFrame, name: str) -> Column:
    """The order column as a number: micros for a time, the value itself otherwise."""
    kind = dict(df.dtypes)[name]
    if kind.startswith("timestamp") or kind == "date":
        return epoch_micros(col(name))
    return col(name).cast("double")


def slice_points(df: DataFrame, key: str | None, number: Column) -> DataFrame:
    """Per key (or for the whole table) the SLICES + 1 quantile points of the order column."""
    points = F.array(*[F.lit(i / SLICES) for i in range(SLICES + 1)])
    slices = F.percentile_approx(number, points, F.lit(1000)).alias("_points")
    grouped = df.groupBy() if key is None else df.groupBy(col(key))
    return grouped.agg(slices)


def with_block(df: DataFrame, number: Column, points: str = "_points") -> DataFrame:
    """Add ``_block`` for a value and drop its quantile points.

    The block never decreases in the value. Nulls come first, and rows without points are in block 0.
    The slice is a column of its own, so it is searched once per row.
    """
    sliced = df.withColumn("_number", number).withColumn(
        "_slice", F.when(F.col("_number").isNotNull(), F.size(F.filter(points, lambda point: point <= F.col("_number"))))
    )
    at, value = F.col("_slice"), F.col("_number")
    low = F.try_element_at(points, F.greatest(at, F.lit(1)))
    high = F.try_element_at(points, at + 1)
    step = F.floor((value - low) * float(STEPS) / (high - low))
    inside = (at > 0) & (at <= SLICES) & (high > low)
    place = at * STEPS + F.when(inside, F.least(step, F.lit(STEPS - 1))).otherwise(F.lit(0))
    block = F.when(F.col(points).isNull(), F.lit(0)).when(value.isNull(), F.lit(-1)).otherwise(place.cast("int"))
    return sliced.withColumn(BLOCK, block).drop(points, "_number", "_slice")


def table_blocks(df: DataFrame, order: str) -> DataFrame:
    """Add ``_block`` over a table of distinct values of the order column."""
    number = sort_number(df, order)
    points = settled(slice_points(df, None, number))  # one row
    return with_block(df.join(F.broadcast(points), how="cross"), number)
