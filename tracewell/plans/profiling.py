"""The whole profile report of a log, a DataFrame per section."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracewell.log import EventLog
from tracewell.operators import profile as ops
from tracewell.operators.columns import columns_of_kind


def profile_report(log: EventLog, summary_only: bool = False) -> dict[str, DataFrame]:
    """Sections by name; nothing runs until a section is read. Empty sections are left out."""
    events = log.events
    report = {"summary": ops.summary(events)}
    if summary_only:
        return report
    numeric, text = columns_of_kind(events, "numeric"), columns_of_kind(events, "text")
    if numeric:
        report["numeric"] = ops.numeric_profile(events, numeric)
        report["skewness"] = ops.skewness(events, numeric)
    for name in columns_of_kind(events, "datetime"):
        report[f"datetime:{name}"] = ops.datetime_profile(events, name)
    if text:
        report["categorical"] = ops.categorical_profile(events, text)
        report["top_values"] = ops.categorical_top_values(events, text)
    report["events_per_case"] = ops.events_per_case(log)
    if "ts" in events.columns:
        report["throughput_time"] = ops.throughput_time(log)
        report["process_metrics"] = ops.process_metrics(log)
    report["activities"] = ops.frequency_metrics(events, "activity")
    if "resource" in events.columns:
        report["resources"] = ops.frequency_metrics(events, "resource")
    report["missing_cells"] = ops.missing_cells(events)
    report["duplicate_rows"] = ops.duplicate_rows(events)
    report["cardinality"] = ops.column_cardinality(events)
    return report
