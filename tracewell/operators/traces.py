"""Traces, outcomes, neighbours and case-level statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.columns import col, epoch_micros, seconds_between
from tracewell.log import EventLog
from tracewell.operators.lookup import PINNED_ROWS
from tracewell.operators.ordering import ordered_cases

SEGMENT_EVENTS = 10_000


def with_neighbours(log: EventLog) -> DataFrame:
    """Each event with its position, the next two activities and the time since the event before."""
    cases = ordered_cases(log, before=1, after=2)
    columns = ["*"]
    rows = cases.events.select(
        *columns,
        cases.position.cast("bigint").alias("position"),
        F.lead("activity", 1).over(cases.window).alias("next_activity"),
        F.lead("activity", 2).over(cases.window).alias("second_next_activity"),
    )
    if "ts" in log.events.columns:
        rows = rows.withColumn("previous_ts", F.lag("ts").over(cases.window))
    return cases.close(rows)


def traces(log: EventLog, segment_events: int = SEGMENT_EVENTS) -> DataFrame:
    """Ordered activities and times per case.

    A case longer than ``segment_events`` continues in further rows (``segment`` 1, 2, ...), so no
    array grows with the data; the segments together are the whole trace.
    """
    cases = ordered_cases(log)
    timed = "ts" in log.events.columns
    fields = ["position", "activity"] + (["ts"] if timed else [])
    rows = cases.events.withColumn("position", cases.position.cast("bigint"))
    rows = cases.close(rows).withColumn("segment", F.floor((F.col("position") - 1) / segment_events))
    steps = F.array_sort(F.collect_list(F.struct(*fields))).alias("steps")
    packed = rows.groupBy("case_id", "segment").agg(steps)
    result = [
        "case_id",
        "segment",
        F.size("steps").cast("bigint").alias("events"),
        F.transform("steps", lambda s: s["activity"]).alias("activities"),
    ]
    if timed:
        result.append(F.transform("steps", lambda s: s["ts"]).alias("timestamps"))
    return packed.select(*result)


def case_lookup(log: EventLog, case_ids: list | DataFrame, first_event: list[str] = ()) -> DataFrame:
    """Traces of chosen cases with the case attributes of their first event.

    A list becomes a pushed-down filter; a DataFrame with ``case_id`` becomes a left semi join.
    """
    if isinstance(case_ids, DataFrame):
        events = log.events.join(case_ids.select("case_id").distinct(), "case_id", "left_semi")
    else:
        events = log.events.where(F.col("case_id").isin(case_ids))
    chosen = log.with_events(events)
    found = traces(chosen)
    if not first_event:
        return found
    key = chosen.order_key()
    attributes = events.groupBy("case_id").agg(*[F.min_by(col(name), key).alias(name) for name in first_event])
    return found.join(attributes, "case_id")


def last_activity(log: EventLog) -> Column:
    return F.max_by("activity", log.order_key())


def outcome_by_last_activity(log: EventLog) -> DataFrame:
    return log.events.groupBy("case_id").agg(last_activity(log).alias("outcome"))


def outcome_by_attribute(log: EventLog, attribute: str) -> DataFrame:
    """Last non-null value of the outcome attribute; the last activity where the log has no such column."""
    if attribute not in log.events.columns:
        return outcome_by_last_activity(log)
    known = F.when(col(attribute).isNotNull(), log.order_key())
    return log.events.groupBy("case_id").agg(F.max_by(col(attribute), known).alias("outcome"))


def case_analysis(log: EventLog, segment_events: int = SEGMENT_EVENTS) -> DataFrame:
    """Per case: events, path text, duration and the gaps between events (null for a single event).

    The path of a case longer than ``segment_events`` continues in further rows with the same figures.
    """
    span = {"start": F.min("ts"), "end": F.max("ts")}
    cases = ordered_cases(log, before=1, values=span)
    rows = cases.events.select(
        "*",
        cases.position.cast("bigint").alias("position"),
        cases.length.alias("event_count"),
        cases.values["start"].alias("start"),
        cases.values["end"].alias("end"),
        seconds_between(F.lag("ts").over(cases.window), F.col("ts")).alias("gap"),
    )
    rows = cases.close(rows).withColumn("segment", F.floor((F.col("position") - 1) / segment_events))
    steps = F.array_sort(F.collect_list(F.struct("position", "activity")))
    path = F.array_join(F.transform(steps, lambda s: s["activity"]), " -> ")
    parts = rows.groupBy("case_id", "segment").agg(
        path.alias("path"),
        F.first("event_count").alias("event_count"),
        seconds_between(F.first("start"), F.first("end")).alias("duration_seconds"),
        F.min("gap").alias("part_min"),
        F.max("gap").alias("part_max"),
    )
    extremes = {"min_gap_seconds": F.min("part_min"), "max_gap_seconds": F.max("part_max")}
    if cases.split:
        # A hot case has very many segments: combine their extremes before they meet.
        whole = parts.groupBy("case_id").agg(*[value.alias(name) for name, value in extremes.items()])
        parts = parts.join(whole, "case_id")
    else:
        case = Window.partitionBy("case_id")
        parts = parts.withColumns({name: value.over(case) for name, value in extremes.items()})
    duration = F.col("duration_seconds")
    return parts.select(
        "case_id",
        "segment",
        "event_count",
        "path",
        "duration_seconds",
        (duration / 3600.0).alias("duration_hours"),
        F.when(F.col("event_count") > 1, duration / (F.col("event_count") - 1)).alias("mean_gap_seconds"),
        *extremes,
    )


def case_spans(log: EventLog) -> DataFrame:
    """Events and duration per case, from partial aggregates only."""
    micros = epoch_micros(F.col("ts"))
    return log.events.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("events"),
        ((F.max(micros) - F.min(micros)) / 1e6).alias("duration_seconds"),
    )


def first_cases(log: EventLog, count: int) -> EventLog:
    """All events of the first ``count`` cases in case order (a sampling operator)."""
    chosen = log.events.select("case_id").distinct().orderBy("case_id").limit(count)
    if count <= PINNED_ROWS:
        chosen = F.broadcast(chosen)
    return log.with_events(log.events.join(chosen, "case_id", "left_semi"))
