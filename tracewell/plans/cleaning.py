"""The composite cleaning job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import functions as F

from tracewell.functions.columns import col
from tracewell.log import EventLog
from tracewell.operators.cleaning import remove_duplicates
from tracewell.operators.columns import column_facts, infer_types, normalise_names
from tracewell.operators.lookup import pinned
from tracewell.operators.numbering import number_rows
from tracewell.operators.outliers import handle_outliers
from tracewell.session import cut_lineage

CRITICAL = ("case_id", "activity", "ts")


def smart_clean(
    log: EventLog,
    aggressive: bool = False,
    infer: bool = True,
    normalise: bool = True,
    scope: str | Sequence[str] = "all",
    null_threshold: float = 0.9,
    outlier_percent: float = 50.0,
) -> EventLog:
    """Clean a log and reduce it to activity, time and a numbered case.

    Steps: names, constant, sparse and empty columns (never case, activity, time or order columns),
    types, rows without case, activity or time, exact copies, outlying times when ``aggressive``, cases
    numbered 1..n in case order. Two aggregates are read on the way to decide on columns and types.
    """
    events = normalise_names(log.events) if normalise else log.events
    order = tuple(name.strip().lower().replace(" ", "_") if normalise else name for name in log.order)
    protected = {*CRITICAL, *order}
    facts = column_facts(events, [c for c in events.columns if c not in protected]) if set(events.columns) - protected else {}
    events = events.drop(
        *[
            name
            for name, fact in facts.items()
            if fact["constant"] or fact["null_ratio"] > null_threshold or fact["filled"] == 0
        ]
    )
    if infer:
        events, _ = infer_types(events, scope)
    events = events.dropna(subset=[c for c in CRITICAL if c in events.columns])
    events = remove_duplicates(events)
    if aggressive:
        events = handle_outliers(events, "ts", outlier_percent)
    events = cut_lineage(events)  # the cleaned log is read for its cases and once more for its events
    cases = number_rows(events.select("case_id").distinct(), ["case_id"], "_case_number")
    numbered = events.join(pinned(cases), "case_id")
    kept = numbered.select(
        "activity", "ts", F.col("_case_number").alias("case_id"), *[col(c) for c in order if c not in CRITICAL]
    )
    return replace(log, events=kept, order=order)
