"""Ordered work inside cases: positions, neighbours and bounded frames, also for hot cases."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracewell.functions.columns import col
from tracewell.log import EventLog
from tracewell.operators.blocks import hot_keys
from tracewell.operators.numbering import number_rows

CHUNK_ROWS = 100_000

# Spark's own threshold for limiting the rows of a group ahead of the shuffle.
GROUP_LIMIT_ROWS = 1_000


@dataclass(frozen=True)
class OrderedCases:
    """Events plus the expressions an ordered operator needs.

    ``window`` supports frames within the asked reach only (``before`` rows back, ``after`` rows
    ahead). Call ``close`` on the result to drop what was added to make those frames complete.
    """

    events: DataFrame
    window: WindowSpec
    position: Column
    length: Column
    values: Mapping[str, Column]
    split: bool

    def close(self, df: DataFrame) -> DataFrame:
        if not self.split:
            return df
        return df.where("_home").drop("_chunk", "_home", "_position", "_length", *[f"_value_{n}" for n in self.values])


def ordered_cases(
    log: EventLog,
    before: int = 0,
    after: int = 0,
    values: Mapping[str, Column] | None = None,
    leading: int | None = None,
) -> OrderedCases:
    """Open a log for ordered work; ``values`` are aggregates over the whole case (``min(ts)``, ...).

    ``leading`` promises that the caller filters on ``position <= leading`` at once. Spark then keeps
    that many rows per case and input partition before the shuffle, and a hot case needs no splitting.

    Without hot cases this is one window per case, one shuffle. The events of hot cases are numbered in
    ranges over all order columns, so equal times part as well, and frames run over fixed-size runs of
    positions with a halo of neighbours.
    """
    values = dict(values or {})
    few = leading is not None and leading <= GROUP_LIMIT_ROWS
    hot = None if few else hot_keys(log.events, "case_id")
    if hot is not None:
        return _split_cases(log, hot, before, after, values)
    whole = Window.partitionBy("case_id")
    window = whole.orderBy(*[col(name) for name in log.order])
    return OrderedCases(
        events=log.events,
        window=window,
        position=F.row_number().over(window),
        length=F.count(F.lit(1)).over(whole),
        values={name: value.over(whole) for name, value in values.items()},
        split=False,
    )


def _split_cases(log: EventLog, hot: DataFrame, before: int, after: int, values: dict[str, Column]) -> OrderedCases:
    events, order = log.events, [col(name) for name in log.order]
    whole = Window.partitionBy("case_id")
    cold = events.join(hot, "case_id", "left_anti").select(
        *[col(c) for c in events.columns],
        F.row_number().over(whole.orderBy(*order)).cast("bigint").alias("_position"),
        F.count(F.lit(1)).over(whole).alias("_length"),
        *[value.over(whole).alias(f"_value_{name}") for name, value in values.items()],
    )
    numbered = number_rows(events.join(hot, "case_id", "left_semi"), ["case_id", *log.order], "_number")
    # Case values are partial aggregates: a hot case reaches the shuffle as a few rows.
    totals = numbered.groupBy("case_id").agg(
        (F.min("_number") - 1).alias("_before"),
        F.count(F.lit(1)).alias("_length"),
        *[value.alias(f"_value_{name}") for name, value in values.items()],
    )
    divided = numbered.join(totals, "case_id").withColumn("_position", F.col("_number") - F.col("_before"))
    placed = cold.unionByName(divided.drop("_number", "_before"))
    index = F.col("_position") - 1
    home = F.floor(index / CHUNK_ROWS)
    copies = [home]
    if before:
        copies.append(F.when(index % CHUNK_ROWS >= CHUNK_ROWS - before, home + 1))
    if after:
        copies.append(F.when((index % CHUNK_ROWS < after) & (home > 0), home - 1))
    chunks = F.filter(F.array(*copies), lambda chunk: chunk.isNotNull())
    spread = placed.withColumn("_chunk", F.explode(chunks)).withColumn("_home", F.col("_chunk") == home)
    return OrderedCases(
        events=spread,
        window=Window.partitionBy("case_id", "_chunk").orderBy("_position"),
        position=F.col("_position"),
        length=F.col("_length"),
        values={name: F.col(f"_value_{name}") for name in values},
        split=True,
    )
