"""Feature rows of prefixes, splits, weights and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.columns import col, md5_test_share
from tracewell.operators.lookup import one_row

NEWEST = 5


def _repetitions(sequence: Column) -> Column:
    """Distinct activities in order of appearance, each with its count."""
    return F.transform(
        F.array_distinct(sequence),
        lambda a: F.struct(F.size(F.filter(sequence, lambda b: b == a)).alias("count"), a.alias("activity")),
    )


def most_common(sequence: Column) -> Column:
    """Most frequent activity; the one seen first wins a tie."""
    nothing = F.struct(F.lit(0).alias("count"), F.lit(None).cast("string").alias("activity"))
    best = F.aggregate(
        _repetitions(sequence), nothing, lambda best, item: F.when(item["count"] > best["count"], item).otherwise(best)
    )
    return best["activity"]


def newest_activities(sequence: Column, count: int = NEWEST) -> dict[str, Column]:
    """``activity_1`` is the newest; a shorter prefix has NONE in the slots it does not reach."""
    return {
        f"activity_{i}": F.coalesce(F.get(sequence, F.size(sequence) - i), F.lit("NONE")) for i in range(1, count + 1)
    }


def sequence_features(prefixes: DataFrame, sequence: str = "activities", carry: Sequence[str] = ()) -> DataFrame:
    """Length, elapsed time, the five newest activities, variety, the most common one, carried columns."""
    activities = col(sequence)
    return prefixes.select(
        "case_id",
        "prefix_length",
        "elapsed_seconds",
        *[value.alias(name) for name, value in newest_activities(activities).items()],
        F.size(F.array_distinct(activities)).cast("bigint").alias("unique_activities"),
        most_common(activities).alias("most_common_activity"),
        *[col(name) for name in carry],
    )


def compact_features(
    prefixes: DataFrame, sequence: str = "prefix_activities", max_length: int = 5, carry: Sequence[str] = ()
) -> DataFrame:
    """Last activity id, length, largest repetition and variety of prefixes up to ``max_length``.

    The sequences hold activity ids (prefixes of an ``encoded_log`` with ``symbol="activity_id"``).
    """
    ids = col(sequence)
    counts = F.transform(F.array_distinct(ids), lambda a: F.size(F.filter(ids, lambda b: b == a)))
    return prefixes.where(F.col("prefix_length") <= max_length).select(
        "case_id",
        F.coalesce(F.get(ids, F.size(ids) - 1), F.lit(0).cast("bigint")).alias("last_activity_id"),
        "prefix_length",
        F.coalesce(F.array_max(counts), F.lit(0)).cast("bigint").alias("max_repetition"),
        F.size(F.array_distinct(ids)).cast("bigint").alias("unique_activities"),
        *[col(name) for name in carry],
    )


def with_outcomes(prefixes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Left join of the case outcomes; prefixes of cases without one are dropped.

    Prefix rows outnumber cases, and adaptive execution splits a hot case's partition.
    """
    return prefixes.join(outcomes, "case_id", "left").where("outcome IS NOT NULL")


def case_split(df: DataFrame, key: str = "case_id") -> DataFrame:
    """Add ``is_test`` by case: all prefixes of a case fall on the same side."""
    return df.withColumn("is_test", md5_test_share(col(key)))


def row_split(df: DataFrame, keys: Sequence[str], label: str, test_share: float = 0.2) -> DataFrame:
    """Add ``is_test`` by row within each label, from a hash of the row's keys and label.

    Prefixes of one case land on both sides, so scores on this split are optimistic.
    """
    digest = F.md5(F.concat_ws("|", col(label).cast("string"), *[col(k).cast("string") for k in keys]))
    limit = format(round(test_share * 65536), "04x")
    return df.withColumn("is_test", F.substring(digest, 1, 4) < limit)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (classes * count) per label."""
    counts = df.groupBy(col(label)).agg(F.count(F.lit(1)).alias("count"))
    totals = one_row(counts.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("classes")))
    return counts.select(col(label), "count", (totals["n"] / (totals["classes"] * F.col("count"))).alias("weight"))


def scaling_figures(df: DataFrame, column: str) -> DataFrame:
    """Mean and population deviation of log1p of a duration, one row."""
    value = F.log1p(col(column))
    return df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))


def scaled(df: DataFrame, column: str, figures: DataFrame, name: str) -> DataFrame:
    fitted = one_row(figures)
    spread = F.when(fitted["deviation"] > 0, fitted["deviation"]).otherwise(F.lit(1.0))
    return df.withColumn(name, (F.log1p(col(column)) - fitted["mean"]) / spread)


def unscaled(df: DataFrame, column: str, figures: DataFrame, name: str) -> DataFrame:
    fitted = one_row(figures)
    spread = F.when(fitted["deviation"] > 0, fitted["deviation"]).otherwise(F.lit(1.0))
    return df.withColumn(name, F.expm1(col(column) * spread + fitted["mean"]))
