"""The canonical event log: one row per event, grouped into cases, with a total order inside a case."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The standard XES attribute names and the short names used here.
XES_NAMES = {
    "case:concept:name": "case_id",
    "concept:name": "activity",
    "time:timestamp": "ts",
    "org:resource": "resource",
    "lifecycle:transition": "lifecycle",
}


def standardise(df: DataFrame) -> DataFrame:
    """Rename the XES columns that are present to the short names; other columns keep theirs."""
    return df.withColumnsRenamed({old: new for old, new in XES_NAMES.items() if old in df.columns})


@dataclass(frozen=True)
class EventLog:
    """Events with columns ``case_id`` and ``activity``; ``order`` lists the columns that order a case.

    The first order column is the time (or turn number). The others break ties: Spark has no input
    order to fall back on, so a log with equal times needs enough of them to make the order total.
    """

    events: DataFrame
    order: tuple[str, ...] = ("ts",)

    @classmethod
    def of(
        cls,
        df: DataFrame,
        case_id: str,
        activity: str,
        ts: str | None = None,
        tiebreak: Sequence[str] = (),
        keep: Sequence[str] = (),
    ) -> EventLog:
        """Bind any table as a log. Events without a case are dropped, as a group-by would drop them."""
        columns = [F.expr(case_id).alias("case_id"), F.expr(activity).alias("activity")]
        order: list[str] = []
        if ts is not None:
            columns.append(F.expr(ts).alias("ts"))
            order.append("ts")
        order += list(tiebreak)
        columns += [F.col(f"`{name}`") for name in dict.fromkeys([*tiebreak, *keep])]
        return cls(df.select(*columns).where("case_id IS NOT NULL"), tuple(order))

    def with_events(self, events: DataFrame) -> EventLog:
        return replace(self, events=events)

    def order_key(self):
        """The order columns as one struct, for ``min_by`` / ``max_by``."""
        return F.struct(*[F.col(f"`{name}`") for name in self.order])
