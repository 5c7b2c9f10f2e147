"""Outliers as a percentage around the mean, for numbers and times, overall or per group."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.columns import col, is_true
from tracewell.operators.blocks import sort_number
from tracewell.operators.cleaning import apply_outside
from tracewell.operators.columns import columns_of_kind, require
from tracewell.operators.lookup import one_row
from tracewell.operators.quantiles import percentiles

OUTLIER_MODES = ("delete", "nan", "default", "medium", "max", "min", "show")


def handle_outliers(
    df: DataFrame,
    column: str,
    deviation_percent: float,
    groupby: str | None = None,
    on_outside: str = "delete",
    default_value: Any = None,
) -> DataFrame:
    """Treat values further from the mean than a percentage of |mean|, or of the time span for times.

    Per group the bounds are aggregated and joined back, so a large group is never held by one task.
    Here ``medium`` fills in the median, and ``default`` without a value the mean. Rows whose group is
    null are kept. Text is read as time where it parses.
    """
    if on_outside not in OUTLIER_MODES:
        raise ValueError(f"unknown on_outside mode {on_outside!r}")
    require(df, column)
    work = df
    numeric = column in columns_of_kind(df, "numeric")
    if not numeric and column not in columns_of_kind(df, "datetime"):
        work = df.withColumn("_time", col(column).try_cast("timestamp_ntz"))
        number = sort_number(work, "_time")
    else:
        number = sort_number(df, column)
    work = work.withColumn("_number", number)
    mean = F.avg("_number")
    reach = F.abs(mean) if numeric else F.max("_number") - F.min("_number")
    width = F.lit(deviation_percent / 100.0) * reach
    bounds = [(mean - width).alias("_low"), (mean + width).alias("_high")]
    if groupby is None:
        limits = one_row(work.agg(*bounds))
        marked = work.withColumn("_low", limits["_low"]).withColumn("_high", limits["_high"])
    else:
        require(df, groupby)
        groups = work.where(col(groupby).isNotNull()).groupBy(col(groupby)).agg(*bounds)
        marked = work.join(groups, groupby, "left")
    outside = is_true((F.col("_number") < F.col("_low")) | (F.col("_number") > F.col("_high")))
    fill = None
    if on_outside == "default" and default_value is None:
        on_outside, fill = "medium", _filled(work, numeric, df, column, F.avg("_number"))
    elif on_outside == "medium":
        middle = percentiles(work, ["_number"], [0.5]).select(F.col("values")[0].alias("_number"))
        fill = _filled(middle, numeric, df, column, F.first("_number"))
    elif on_outside in ("max", "min"):
        fill = _filled(work, numeric, df, column, getattr(F, on_outside)("_number"))
    treated = apply_outside(marked, column, outside, on_outside, default_value, fill)
    return treated.select(*[col(name) for name in df.columns])


def _filled(source: DataFrame, numeric: bool, df: DataFrame, column: str, value: Column) -> Column:
    """The fill value in the column's own type."""
    found = source.agg(value.alias("fill"))
    if numeric:
        return found.scalar()
    dtype = dict(df.dtypes)[column]
    return found.select(F.timestamp_micros(F.col("fill").cast("bigint")).cast("timestamp_ntz").cast(dtype)).scalar()
