"""Profile report sections, each one long or wide DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.columns import col, epoch_micros
from tracewell.log import EventLog
from tracewell.operators.blocks import BLOCK, table_blocks
from tracewell.operators.columns import columns_of_kind
from tracewell.operators.lookup import one_row, settled
from tracewell.operators.quantiles import number, number_counts, percentiles, percentiles_of
from tracewell.operators.traces import case_spans
from tracewell.session import cut_lineage


def unique_summary(df: DataFrame, columns: Sequence[str], top_n: int | None = None, null_token: str = "nan") -> DataFrame:
    """Frequency of a value, or of the ``_``-joined values of several columns, most frequent first."""
    key = F.concat_ws("_", *[F.coalesce(col(c).cast("string"), F.lit(null_token)) for c in columns])
    counts = df.groupBy(key.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    ranked = counts.orderBy(F.desc("count"), "value")
    return ranked if top_n is None else ranked.limit(top_n)


def summary(df: DataFrame) -> DataFrame:
    kinds = {kind: len(columns_of_kind(df, kind)) for kind in ("numeric", "datetime", "text", "boolean")}
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        *[F.lit(n).cast("bigint").alias(f"{kind}_columns") for kind, n in kinds.items()],
    )


def _long_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), number(c).alias("value")) for c in columns]
    return df.select(F.inline(F.array(*cells)))


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: count, mean, spread, quartiles, values outside 1.5 IQR, missing cells (null or NaN).

    The table is read twice: once for all moments in one wide aggregate, once for the counts of values, from which
    quartiles and outliers follow.
    """
    names = list(columns or columns_of_kind(df, "numeric"))
    histogram = number_counts(df, names)
    bounds = percentiles_of(histogram, names, [0.25, 0.5, 0.75]).select(
        "column",
        F.col("values")[0].alias("p25"),
        F.col("values")[1].alias("p50"),
        F.col("values")[2].alias("p75"),
    ).withColumn("iqr", F.col("p75") - F.col("p25"))
    moments = []
    for name in names:
        value = number(name)
        moments.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count(value).alias("count"),
                F.avg(value).alias("mean"),
                F.stddev_samp(value).alias("std"),
                F.min(value).alias("min"),
                F.max(value).alias("max"),
                F.count_if(value.isNull()).alias("missing"),
                F.try_divide(100.0 * F.count_if(value.isNull()), F.count(F.lit(1))).alias("missing_percent"),
            )
        )
    base = df.agg(F.array(*moments).alias("moments")).select(F.inline("moments"))
    value = F.col("value")
    outside = (value < F.col("p25") - 1.5 * F.col("iqr")) | (value > F.col("p75") + 1.5 * F.col("iqr"))
    # One row per numeric column: bounded by the schema.
    figures = F.broadcast(settled(bounds))
    outliers = histogram.join(figures, "column").groupBy("column").agg(F.sum(F.when(outside, F.col("times")).otherwise(F.lit(0))).alias("outliers"))
    return (
        base.join(figures, "column", "left")
        .join(F.broadcast(outliers), "column", "left")
        .withColumn("outliers", F.coalesce("outliers", F.lit(0).cast("bigint")))
    )


def datetime_profile(df: DataFrame, column: str) -> DataFrame:
    """First, last, span, distinct values and gaps of a time column.

    Equal times are counted ahead of the shuffle. The gaps need the global time order: distinct times are
    sorted inside blocks only; the gap across a block border comes from the blocks' first and last times.
    """
    micros = epoch_micros(col(column))
    times = settled(df.where(col(column).isNotNull()).groupBy(micros.alias("t")).agg(F.count(F.lit(1)).alias("times")))
    timed = table_blocks(times, "t")
    inside = Window.partitionBy(BLOCK).orderBy("t")
    gaps = timed.withColumn("gap", F.col("t") - F.lag("t").over(inside))
    parts = gaps.groupBy(BLOCK).agg(
        F.sum("times").alias("n"),
        F.count(F.lit(1)).alias("distinct"),
        F.max("times").alias("most"),
        F.min("t").alias("first"),
        F.max("t").alias("last"),
        F.min("gap").alias("min_gap"),
        F.max("gap").alias("max_gap"),
    )
    border = F.col("first") - F.lag("last").over(Window.orderBy(BLOCK))  # a few thousand blocks at most
    stitched = parts.withColumn("border", border)
    joined = stitched.agg(
        F.sum("n").alias("n"),
        F.sum("distinct").alias("distinct_values"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.when(F.max("most") > 1, F.lit(0)).otherwise(F.min(F.least("min_gap", "border"))).alias("min_gap"),
        F.coalesce(F.max(F.greatest("max_gap", "border")), F.when(F.max("most") > 1, F.lit(0))).alias("max_gap"),
    )
    whole = df.agg(F.count_if(col(column).isNull()).alias("missing"), F.count(F.lit(1)).alias("rows"))
    span = F.col("last") - F.col("first")
    return joined.withColumn("whole", one_row(whole)).select("*", "whole.*").select(
        F.lit(column).alias("column"),
        F.col("first").alias("first_micros"),
        F.col("last").alias("last_micros"),
        (span / 1e6).alias("span_seconds"),
        "distinct_values",
        (F.col("min_gap") / 1e6).alias("min_gap_seconds"),
        (F.col("max_gap") / 1e6).alias("max_gap_seconds"),
        F.when(F.col("n") > 1, span / 1e6 / (F.col("n") - 1)).alias("mean_gap_seconds"),
        "missing",
        (100.0 * F.col("missing") / F.col("rows")).alias("missing_percent"),
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of every value of every column in one pass: ``column, value, count`` (null is a value)."""
    cells = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*cells))).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def categorical_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per text column: distinct values, the most frequent one, entropy in bits, missing cells."""
    names = list(columns or columns_of_kind(df, "text"))
    counts = value_counts(df, names)
    known = F.col("value").isNotNull()
    # The entropy needs each value's share, so the totals per column (one row each) are joined back.
    totals = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(known, F.col("count"))), F.lit(0)).alias("filled"), F.sum("count").alias("rows")
    )
    share = F.col("count") / F.col("filled")
    return (
        counts.join(F.broadcast(totals), "column")
        .groupBy("column")
        .agg(
            F.count_if(known).alias("unique_count"),
            F.max(F.when(known, F.col("count"))).alias("top_freq"),
            F.sum(F.when(known, -share * F.log2(share + 1e-12))).alias("entropy"),
            F.max("rows").alias("rows"),
            F.max("filled").alias("filled"),
        )
        .join(top_values(counts, 1).select("column", F.col("value").alias("top_value")), "column", "left")
        .select(
            "column",
            "unique_count",
            "top_value",
            F.coalesce("top_freq", F.lit(0)).alias("top_freq"),
            (100.0 * F.coalesce("top_freq", F.lit(0)) / F.col("rows")).alias("top_percent"),
            F.coalesce("entropy", F.lit(0.0)).alias("entropy"),
            (F.col("rows") - F.col("filled")).alias("missing"),
            (100.0 * (F.col("rows") - F.col("filled")) / F.col("rows")).alias("missing_percent"),
        )
    )


def top_values(counts: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent values per column; ties go to the smaller value.

    The rank filter lets Spark keep n rows per column before the shuffle.
    """
    window = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    known = counts.where("value IS NOT NULL")
    return known.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def categorical_top_values(df: DataFrame, columns: Sequence[str], n: int = 10) -> DataFrame:
    rows = df.agg(F.count(F.lit(1))).scalar()
    top = top_values(value_counts(df, columns), n)
    return top.select("column", "rank", "value", "count", (100.0 * F.col("count") / rows).alias("percent"))


def _median_of(df: DataFrame, column: str) -> Column:
    return percentiles(df, [column], [0.5]).select(F.col("values")[0]).scalar()


def events_per_case(log: EventLog) -> DataFrame:
    sizes = log.events.groupBy("case_id").agg(F.count(F.lit(1)).alias("events"))
    # Few distinct sizes exist, so the median is taken over the histogram of sizes.
    histogram = sizes.groupBy("events").agg(F.count(F.lit(1)).alias("cases"))
    return histogram.agg(
        F.sum("cases").alias("n_cases"),
        (F.sum(F.col("events") * F.col("cases")) / F.sum("cases")).alias("mean_events"),
        F.expr("percentile(events, 0.5, cases)").alias("median_events"),
        F.min("events").alias("min_events"),
        F.max("events").alias("max_events"),
    )


def throughput_time(log: EventLog) -> DataFrame:
    # The median reads the spans several times.
    spans = cut_lineage(case_spans(log.with_events(log.events.where("ts IS NOT NULL"))))
    figures = spans.agg(
        F.avg("duration_seconds").alias("mean_seconds"),
        F.min("duration_seconds").alias("min_seconds"),
        F.max("duration_seconds").alias("max_seconds"),
    )
    return figures.withColumn("median_seconds", _median_of(spans, "duration_seconds"))


def frequency_metrics(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values with their share of all rows, and the values that occur once.

    ``section`` is "top" or "rare"; a value can be in both.
    """
    rows = df.agg(F.count(F.lit(1))).scalar()
    counts = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    top = counts.orderBy(F.desc("count"), "value").limit(n).withColumn("section", F.lit("top"))
    rare = counts.where("count = 1").withColumn("section", F.lit("rare"))
    both = top.unionByName(rare)
    return both.select("section", "value", "count", (100.0 * F.col("count") / rows).alias("percent"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(col(column)).alias("distinct_values"))


def missing_cells(df: DataFrame) -> DataFrame:
    """Missing cells per column that has any, with the table's total and share on every row."""
    names = df.columns
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(names)]
    )
    total: Column = F.lit(0).cast("bigint")
    for i in range(len(names)):
        total = total + F.col(f"m{i}")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(names)])
    long = counts.select(
        F.inline(cells), total.alias("total_missing"), (100.0 * total / (F.col("rows") * len(names))).alias("total_percent")
    )
    return long.where("missing > 0")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row, and their share. Copies are counted before the shuffle."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("copies"))
    return groups.agg(
        F.sum("copies").alias("rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"),
        (100.0 * F.sum(F.col("copies") - 1) / F.sum("copies")).alias("duplicate_percent"),
    )


def column_cardinality(df: DataFrame, columns: Sequence[str] | None = None, high_share: float = 0.8) -> DataFrame:
    """Distinct values per column, with flags for constant and nearly unique columns (nulls ignored)."""
    counts = value_counts(df, list(columns or df.columns))
    known = F.col("value").isNotNull()
    return counts.groupBy("column").agg(
        F.count_if(known).alias("distinct_values"),
        (F.count_if(known) <= 1).alias("is_constant"),
        (F.count_if(known) > high_share * F.sum("count")).alias("is_high_cardinality"),
    )


def skewness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Bias-adjusted sample skewness per numeric column."""
    names = list(columns or columns_of_kind(df, "numeric"))
    n = F.count("value").cast("double")
    adjusted = F.skewness("value") * F.sqrt(n * (n - 1)) / (n - 2)
    return _long_numbers(df, names).groupBy("column").agg(F.when(n > 2, adjusted).alias("skewness"))


def process_metrics(log: EventLog) -> DataFrame:
    """Size, case length, duration and most common activity of a log in one row."""
    cases = case_spans(log).agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.sum("events").alias("total_events"),
        F.avg("events").alias("avg_case_length"),
        F.min("events").alias("min_case_length"),
        F.max("events").alias("max_case_length"),
        F.stddev_samp("events").alias("std_case_length"),
        F.avg("duration_seconds").alias("avg_duration_seconds"),
        F.min("duration_seconds").alias("min_duration_seconds"),
        F.max("duration_seconds").alias("max_duration_seconds"),
    )
    counts = log.events.where("activity IS NOT NULL").groupBy("activity").agg(F.count(F.lit(1)).alias("n"))
    common = counts.agg(
        F.count(F.lit(1)).alias("unique_activities"),
        F.max("n").alias("most_common_count"),
    )
    first = counts.orderBy(F.desc("n"), "activity").limit(1).select("activity").scalar()
    return (
        cases.withColumn("common", one_row(common))
        .select("*", "common.*")
        .drop("common")
        .withColumn("most_common_activity", first)
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and share per value of a label or bucket column."""
    counts = df.groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.select("value", "count", (100.0 * F.col("count") / total).alias("percent"))


def length_range(prefixes: DataFrame) -> DataFrame:
    return prefixes.agg(
        F.min("prefix_length").alias("min_length"),
        F.max("prefix_length").alias("max_length"),
        F.avg("prefix_length").alias("mean_length"),
    )
