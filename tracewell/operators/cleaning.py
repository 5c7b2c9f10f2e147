"""Row filters, replacements, duplicates, anonymisation and corrections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.columns import col, is_true, letters, member, similarity
from tracewell.log import EventLog
from tracewell.operators.columns import columns_of_kind, fill_value, require
from tracewell.operators.likeness import alike
from tracewell.operators.lookup import pinned
from tracewell.operators.numbering import number_rows


def remove_by_condition(df: DataFrame, condition: str) -> DataFrame:
    """Drop the rows a Spark SQL predicate matches; a null result does not match."""
    return df.where(~is_true(F.expr(condition)))


def remove_by_membership(df: DataFrame, column: str, values: Sequence, mode: str = "in") -> DataFrame:
    """``in`` removes the listed values, ``not_in`` keeps only them."""
    require(df, column)
    listed = member(col(column), values)
    if mode == "in":
        return df.where(~listed)
    if mode == "not_in":
        return df.where(listed)
    raise ValueError(f"unknown mode {mode!r}")


def replace_values(df: DataFrame, columns: Sequence[str], to_replace: Any, new_value: Any) -> DataFrame:
    require(df, *columns)
    values = list(to_replace) if isinstance(to_replace, (list, tuple, set)) else [to_replace]
    return df.withColumns({c: F.when(member(col(c), values), F.lit(new_value)).otherwise(col(c)) for c in columns})


_COMPARE = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: ~c.eqNullSafe(v),
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)),
    "not in": lambda c, v: ~member(c, v),
}


def predicate(conditions: str | Sequence[str | tuple[str, str, Any]]) -> Column:
    """A SQL predicate, or a list of such predicates and (column, operator, value) triples that must all hold."""
    if isinstance(conditions, str):
        return is_true(F.expr(conditions))
    result = F.lit(True)
    for condition in conditions:
        if isinstance(condition, str):
            result = result & is_true(F.expr(condition))
            continue
        if len(condition) != 3:
            raise ValueError(f"neither a predicate nor a triple: {condition!r}")
        name, operator, value = condition
        if operator not in _COMPARE:
            raise ValueError(f"unknown operator {operator!r}")
        result = result & is_true(_COMPARE[operator](col(name), value))
    return result


def replace_where(df: DataFrame, columns: Sequence[str], conditions, new_value: Any) -> DataFrame:
    """Set all target columns where the condition holds on the values before the update."""
    require(df, *columns)
    holds = predicate(conditions)
    return df.withColumns({c: F.when(holds, F.lit(new_value)).otherwise(col(c)) for c in columns})


def handle_nulls(df: DataFrame, column: str, on_null: str = "delete", default_value: Any = None) -> DataFrame:
    require(df, column)
    if on_null == "delete":
        return df.where(col(column).isNotNull())
    if on_null == "default":
        return df.withColumn(column, F.coalesce(col(column), F.lit(default_value)))
    if on_null in ("medium", "max", "min"):
        if column not in columns_of_kind(df, "numeric"):
            raise ValueError(f"on_null={on_null!r} needs a numeric column")
        return df.withColumn(column, F.coalesce(col(column), fill_value(df, col(column), on_null)))
    raise ValueError(f"unknown on_null mode {on_null!r}")


def apply_outside(
    df: DataFrame, column: str, outside: Column, mode: str, default_value: Any = None, fill: Column | None = None
) -> DataFrame:
    """Treat the rows of a mask: drop, blank, overwrite, or return only them (``show``)."""
    if mode == "show":
        return df.where(outside)
    if mode == "delete":
        return df.where(~outside)
    if mode == "nan":
        return df.withColumn(column, F.when(~outside, col(column)))
    if mode == "default":
        return df.withColumn(column, F.when(outside, F.lit(default_value)).otherwise(col(column)))
    if mode in ("medium", "max", "min") and fill is not None:
        return df.withColumn(column, F.when(outside, fill).otherwise(col(column)))
    raise ValueError(f"unknown on_outside mode {mode!r}")


DATETIME_SHARE = 0.7


def filter_range(
    df: DataFrame,
    column: str,
    allowed_values: Sequence | None = None,
    range_min: Any = None,
    range_max: Any = None,
    on_outside: str = "delete",
    default_value: Any = None,
) -> DataFrame:
    """Treat values that are not allowed, below the minimum or above the maximum (bounds inclusive).

    A text column compared with a range becomes a time when at least 70 % of its values parse; the others are null.
    A null is never outside a range but is outside a set of allowed values.
    """
    require(df, column)
    value = col(column)
    numeric = column in columns_of_kind(df, "numeric")
    timed = column in columns_of_kind(df, "datetime")
    if not numeric and not timed and (range_min is not None or range_max is not None):
        parsed = value.try_cast("timestamp_ntz")
        share = df.agg((F.count(parsed) / F.count(F.lit(1))).alias("s")).collect()[0]["s"]
        if share is not None and share >= DATETIME_SHARE:
            df, timed = df.withColumn(column, parsed), True

    def bound(limit):
        return F.lit(limit).try_cast("timestamp_ntz") if timed else F.lit(limit)

    outside = F.lit(False)
    if allowed_values is not None:
        outside = outside | ~member(col(column), allowed_values)
    if range_min is not None:
        outside = outside | is_true(value < bound(range_min))
    if range_max is not None:
        outside = outside | is_true(value > bound(range_max))
    fill = None
    if on_outside in ("medium", "max", "min"):
        if not numeric:
            raise ValueError(f"on_outside={on_outside!r} needs a numeric column")
        fill = fill_value(df, value, on_outside)
    return apply_outside(df, column, outside, on_outside, default_value, fill)


def remove_duplicates(
    df: DataFrame, columns: Sequence[str] | None = None, keep: str | bool = "first", order: Sequence[str] = (),
    groupby: str | None = None,
) -> DataFrame:
    """Drop duplicate rows; nulls are equal. ``keep`` is "first", "last" (by ``order``) or False.

    ``groupby`` adds a key, and rows without it are dropped. Only one row per key and input partition
    is shuffled, so a key with very many copies does not pile up in one task.
    """
    if groupby is not None:
        require(df, groupby)
        df = df.where(col(groupby).isNotNull())
    keys = list(dict.fromkeys([*(columns or df.columns), *([groupby] if groupby else [])]))
    require(df, *keys)
    others = [name for name in df.columns if name not in keys]
    if keep is False:
        single = df.groupBy(*[col(k) for k in keys]).agg(
            F.count(F.lit(1)).alias("_copies"), *[F.first(col(name)).alias(name) for name in others]
        )
        return single.where("_copies = 1").select(*[col(name) for name in df.columns])
    if not others:
        return df.dropDuplicates()
    if not order:
        raise ValueError("keep='first' or 'last' on some columns needs an order")
    direction = [col(c).asc_nulls_first() if keep == "first" else col(c).desc_nulls_last() for c in order]
    window = Window.partitionBy(*[col(k) for k in keys]).orderBy(*direction)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def appearance_ids(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Distinct values numbered from 1 by first appearance in the given total order."""
    first = (
        df.where(col(column).isNotNull())
        .groupBy(col(column))
        .agg(F.min(F.struct(*[col(c) for c in order])).alias("_first"))
        .select(col(column), *[F.col(f"_first.`{c}`").alias(f"_o{i}") for i, c in enumerate(order)])
    )
    numbered = number_rows(first, [f"_o{i}" for i in range(len(order))], "_id")
    return numbered.select(col(column), "_id")


def anonymise(df: DataFrame, column: str, order: Sequence[str], method: str = "numeric") -> DataFrame:
    """Replace values by ids 1, 2, ... or letters A, B, ..., AA in order of first appearance; null stays."""
    require(df, column, *order)
    ids = appearance_ids(df, column, order)
    if method == "numeric":
        code = F.col("_id")
    elif method == "alphabetic":
        code = letters(F.col("_id"))
    else:
        raise ValueError(f"unknown method {method!r}")
    table = pinned(ids.select(col(column), code.alias("_code")))
    return (
        df.join(table, column, "left").withColumn(column, F.col("_code")).select(*[col(name) for name in df.columns])
    )


def suggest_corrections(
    df: DataFrame, column: str, valid_values: Sequence[str] | DataFrame, threshold: float = 85.0
) -> DataFrame:
    """Per distinct value the most similar valid value, where it differs and scores at least ``threshold``.

    Values are compared in upper case without blanks around them. Both sides may be large: only those that share a
    part are compared (see ``likeness``). The alphabetically first of equally similar values wins.
    """
    require(df, column)
    if not isinstance(valid_values, DataFrame):
        valid_values = df.sparkSession.createDataFrame([(v,) for v in valid_values], "value string")
    text = F.col("original_value")
    values = df.select(col(column).cast("string").alias("original_value")).where("original_value IS NOT NULL").distinct()
    values = values.withColumn("left", F.upper(F.trim(text)))
    valid = valid_values.toDF("value").where("value IS NOT NULL").select(F.upper(F.trim("value")).alias("right"), "value")
    firsts = valid.groupBy("right").agg(F.min("value").alias("value"))
    pairs = alike(values.select("left").distinct(), firsts.select("right"), threshold).join(firsts, "right")
    best = pairs.groupBy("left").agg(F.min_by(F.struct("score", "value"), F.struct((-F.col("score")).alias("worse"), "value")).alias("best"))
    return values.join(best, "left").where(F.col("best.value") != text).select(
        "original_value", F.col("best.value").alias("suggested_value"), F.col("best.score").alias("similarity_score")
    )


def apply_corrections(df: DataFrame, column: str, corrections: Mapping[str, str] | DataFrame) -> DataFrame:
    """Trim and upper-case the whole column, then replace the listed values once; null stays null."""
    require(df, column)
    if not isinstance(corrections, DataFrame):
        corrections = df.sparkSession.createDataFrame(list(corrections.items()), "original_value string, suggested_value string")
    table = corrections.select(
        F.upper(F.trim("original_value")).alias("_old"), F.upper(F.trim("suggested_value")).alias("_new")
    ).groupBy("_old").agg(F.min("_new").alias("_new"))
    tidy = df.withColumn(column, F.upper(F.trim(col(column).cast("string"))))
    joined = tidy.join(pinned(table), tidy[column] == F.col("_old"), "left")
    return joined.withColumn(column, F.coalesce(F.col("_new"), tidy[column])).select(*[col(n) for n in df.columns])


def clean_log(log: EventLog) -> EventLog:
    """Drop exact copies and fill empty text attributes; order is given by the log, not by a sort."""
    texts = [n for n, t in log.events.dtypes if t == "string" and n not in ("case_id", "activity")]
    return log.with_events(log.events.dropDuplicates().fillna("UNKNOWN", subset=texts or None))


def sort_by(
    df: DataFrame, columns: Sequence[str] = ("case_id", "ts"), ascending: bool | Sequence[bool] = True,
    na_position: str = "last",
) -> DataFrame:
    require(df, *columns)
    if na_position not in ("first", "last"):
        raise ValueError("na_position must be 'first' or 'last'")
    flags = [ascending] * len(columns) if isinstance(ascending, bool) else list(ascending)
    if len(flags) != len(columns):
        raise ValueError("ascending needs one value per column")
    keys = []
    for name, up in zip(columns, flags, strict=True):
        direction = ("asc" if up else "desc") + "_nulls_" + na_position
        keys.append(getattr(col(name), direction)())
    return df.orderBy(*keys)
