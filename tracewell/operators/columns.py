"""Projection and schema operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.columns import col, text_or_token
from tracewell.log import XES_NAMES

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def kind_of(dtype: str) -> str:
    if dtype.startswith(_NUMERIC):
        return "numeric"
    if dtype == "boolean":
        return "boolean"
    if dtype.startswith("timestamp") or dtype == "date":
        return "datetime"
    return "text"


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    return [name for name, dtype in df.dtypes if kind_of(dtype) == kind]


def require(df: DataFrame, *names: str) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"columns not in the log: {missing}")


def list_columns(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(name,) for name in df.columns], "column string")


def list_column_types(df: DataFrame) -> DataFrame:
    rows = [(name, dtype, kind_of(dtype)) for name, dtype in df.dtypes]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string, detected_type string")


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*[name for name in columns if name in df.columns])


def keep_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep the named columns in the caller's order; without names, the standard XES columns present."""
    wanted = list(XES_NAMES) if columns is None else columns
    return df.select(*[col(name) for name in wanted if name in df.columns])


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    require(df, old)
    return df.withColumnRenamed(old, new)


def normalise_names(df: DataFrame) -> DataFrame:
    names = [name.strip().lower().replace(" ", "_") for name in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"normalised names collide: {sorted(names)}")
    return df.toDF(*names)


def merge_columns(
    df: DataFrame, columns: Sequence[str], new_column: str, delimiter: str = "_", drop_original: bool = False,
    null_token: str = "nan",
) -> DataFrame:
    if len(columns) < 2:
        raise ValueError("merge_columns needs at least two columns")
    require(df, *columns)
    merged = df.withColumn(new_column, F.concat_ws(delimiter, *[text_or_token(col(c), null_token) for c in columns]))
    return merged.drop(*[c for c in columns if c != new_column]) if drop_original else merged


def column_facts(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, dict[str, Any]]:
    """Per column: rows, non-null values, and whether it is constant. One aggregate, one row.

    A column is constant when its smallest and largest value agree and nulls do not add a second
    value, which needs no distinct count.
    """
    names = list(columns or df.columns)
    aggregates: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(names):
        aggregates += [F.count(col(name)).alias(f"n{i}"), (F.min(col(name)) == F.max(col(name))).alias(f"same{i}")]
    row = df.agg(*aggregates).collect()[0]
    total = row["rows"]
    facts = {}
    for i, name in enumerate(names):
        filled = row[f"n{i}"]
        facts[name] = {
            "rows": total,
            "filled": filled,
            "null_ratio": (total - filled) / total if total else 0.0,
            "constant": filled == 0 or (filled == total and bool(row[f"same{i}"])),
        }
    return facts


def drop_constant_columns(df: DataFrame, null_threshold: float = 0.0, protect: Sequence[str] = ()) -> DataFrame:
    """Drop columns with at most one value (null counts as a value) and, above the threshold, sparse ones."""
    facts = column_facts(df)
    gone = [
        name
        for name, fact in facts.items()
        if name not in protect
        and (fact["constant"] or (null_threshold > 0 and fact["null_ratio"] > null_threshold))
    ]
    return df.drop(*gone)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[name for name, fact in column_facts(df).items() if fact["filled"] == 0])


# Texts read as true and as false.
TRUE_TEXTS = ("true", "1", "yes")
FALSE_TEXTS = ("false", "0", "no")


def converted(column: Column, target: str, datetime_formats: Sequence[str] = ()) -> Column:
    """The value as the target type, or null where it does not convert."""
    if target == "str":
        return column.cast("string")
    if target == "numeric":
        return column.try_cast("double")
    if target == "datetime":
        if not datetime_formats:
            return column.try_cast("timestamp_ntz")
        text = column.cast("string")
        attempts = [F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz") for fmt in datetime_formats]
        return F.coalesce(*attempts)
    if target == "bool":
        text = F.lower(F.trim(column.cast("string")))
        return F.when(text.isin(*TRUE_TEXTS), F.lit(True)).when(text.isin(*FALSE_TEXTS), F.lit(False))
    raise ValueError(f"unknown target type {target!r}")


def fill_value(df: DataFrame, value: Column, mode: str) -> Column:
    """The fill value of a column as a scalar subquery: mean ("medium"), largest or smallest."""
    aggregate = {"medium": F.avg, "max": F.max, "min": F.min}[mode]
    return df.agg(aggregate(value).alias("fill")).scalar()


def convert_column(
    df: DataFrame,
    column: str,
    target: str,
    on_fail: str = "nan",
    default_value: Any = None,
    datetime_formats: Sequence[str] = (),
) -> DataFrame:
    """Convert a column; ``on_fail`` decides about values that do not convert (nulls included).

    ``nothing`` keeps the column as it was when anything fails and converts it otherwise; it needs one
    aggregate to know. The other modes convert every row.
    """
    require(df, column)
    new = converted(col(column), target, datetime_formats)
    if on_fail == "nan":
        return df.withColumn(column, new)
    if on_fail == "delete":
        return df.withColumn(column, new).where(col(column).isNotNull())
    if on_fail == "default":
        return df.withColumn(column, F.coalesce(new, F.lit(default_value)))
    if on_fail in ("medium", "max", "min"):
        if target != "numeric":
            raise ValueError(f"on_fail={on_fail!r} needs a numeric target")
        return df.withColumn(column, F.coalesce(new, fill_value(df, new, on_fail)))
    if on_fail == "nothing":
        failed = df.agg(F.max(new.isNull())).collect()[0][0]
        return df if failed else df.withColumn(column, new)
    raise ValueError(f"unknown on_fail mode {on_fail!r}")


def infer_types(df: DataFrame, scope: str | Sequence[str] = "all", category_limit: int = 50) -> tuple[DataFrame, dict[str, str]]:
    """Re-type text columns: a name with "time" to datetime, all-numeric text to numbers.

    Returns the table and a kind per inspected column; ``category`` marks text with few values and
    changes nothing. ``scope`` is "all", "xes" or the columns to look at. One aggregate decides.
    """
    if isinstance(scope, str):
        pool = set(df.columns) if scope == "all" else {*XES_NAMES, *XES_NAMES.values()}
    else:
        pool = set(scope)
    text = [name for name, dtype in df.dtypes if name in pool and dtype == "string"]
    kinds = {name: kind_of(dtype) for name, dtype in df.dtypes if name in pool}
    timed = [name for name in text if "time" in name.lower()]
    rest = [name for name in text if name not in timed]
    if rest:
        aggregates = []
        for i, name in enumerate(rest):
            aggregates += [
                F.count(col(name)).alias(f"n{i}"),
                F.count(col(name).try_cast("double")).alias(f"numeric{i}"),
                F.approx_count_distinct(col(name), 0.02).alias(f"distinct{i}"),
            ]
        row = df.agg(*aggregates).collect()[0]
        for i, name in enumerate(rest):
            if row[f"n{i}"] and row[f"n{i}"] == row[f"numeric{i}"]:
                kinds[name] = "numeric"
            elif row[f"distinct{i}"] < category_limit:
                kinds[name] = "category"
    changes = {name: col(name).try_cast("timestamp_ntz") for name in timed}
    changes |= {name: col(name).try_cast("double") for name in rest if kinds[name] == "numeric"}
    kinds |= {name: "datetime" for name in timed}
    return (df.withColumns(changes) if changes else df), kinds


def align_features(df: DataFrame, trained: Mapping[str, str], missing: Any = None) -> DataFrame:
    """The trained feature columns in their order; an absent one is filled with ``missing``."""
    return df.select(
        *[
            col(name) if name in df.columns else F.lit(missing).cast(dtype).alias(name)
            for name, dtype in trained.items()
        ]
    )
