"""Small tables: broadcast only after their size has been checked, computed once when read often."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import cut_lineage

PINNED_ROWS = 50_000
PINNED_BYTES = 8 * 1024 * 1024


def one_row(table: DataFrame) -> Column:
    """A one-row table (an aggregate) as a struct value any other query can read, without a join."""
    return table.select(F.struct("*").alias("row")).scalar()


def local_copy(table: DataFrame, max_rows: int = PINNED_ROWS) -> DataFrame | None:
    """The table as literal rows of the plan, or None when it has too many rows or bytes.

    One job fetches at most ``max_rows + 1`` rows, so the check itself is bounded.
    """
    rows = table.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows or rows.nbytes > PINNED_BYTES:
        return None
    return table.sparkSession.createDataFrame(rows, schema=table.schema)


def pinned(table: DataFrame, max_rows: int = PINNED_ROWS) -> DataFrame:
    """A broadcast copy of a small table; a larger one is returned as it is.

    Beyond the limit the caller's join shuffles, and adaptive execution splits its skewed partitions.
    """
    copy = local_copy(table, max_rows)
    return table if copy is None else F.broadcast(copy)


def settled(table: DataFrame, max_rows: int = PINNED_ROWS) -> DataFrame:
    """A table computed once and then read many times: checkpointed, and read back as literal rows if small."""
    kept = cut_lineage(table)
    copy = local_copy(kept, max_rows)
    return kept if copy is None else copy
