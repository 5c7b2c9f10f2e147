"""Prefixes of cases as training rows, and the sequences models read.

Two prefix definitions exist side by side: ``prefixes_inclusive`` ends with the full trace, and
``prefixes_next`` stops one event earlier because its rows carry the next activity as label.

Whole prefixes of a long case would take quadratic space, so they share what they have in common: a case is cut into
segments, a prefix row carries the activities from its own segment's first event on, and ``offset`` says how many
events stand before them. A case of one segment has its prefixes whole (``offset`` 0); ``whole_prefixes`` puts the
others together, for those rows that are wanted.
"""

from __future__ import annotations

from collections.abc import Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracewell.functions.columns import col, hours_between, left_pad, prefix_bucket, seconds_between
from tracewell.log import EventLog
from tracewell.operators.ordering import GROUP_LIMIT_ROWS, ordered_cases
from tracewell.operators.traces import last_activity, traces

SEGMENT_EVENTS = 1_000


def _collected(name: str, window: WindowSpec) -> Column:
    """The values of a column over a window, nulls included."""
    return F.transform(F.collect_list(F.struct(col(name).alias("value"))).over(window), lambda s: s["value"])


def _up_to_here(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _placed(log: EventLog, max_length: int | None, more: int = 0) -> DataFrame:
    """Events with ``prefix_length``, their place in the case, up to ``max_length + more``.

    A limit on the place lets Spark keep only the leading events of a case before the shuffle.
    """
    leading = None if max_length is None else max_length + more
    cases = ordered_cases(log, leading=leading)
    rows = cases.close(cases.events.withColumn("prefix_length", cases.position.cast("bigint")))
    return rows if leading is None else rows.where(F.col("prefix_length") <= leading)


# Counted once per table, as a log's prefixes are read in several ways.
_LONG: WeakKeyDictionary[DataFrame, dict[int, bool]] = WeakKeyDictionary()


def _long_cases(log: EventLog) -> bool:
    """Whether some case has more than one segment; only then segments have to be joined."""
    known = _LONG.setdefault(log.events, {})
    if SEGMENT_EVENTS not in known:
        sizes = log.events.groupBy("case_id").agg(F.count(F.lit(1)).alias("_rows"))
        known[SEGMENT_EVENTS] = not sizes.where(F.col("_rows") > SEGMENT_EVENTS).isEmpty()
    return known[SEGMENT_EVENTS]


def _in_segments(rows: DataFrame) -> DataFrame:
    return rows.withColumn("offset", F.floor((F.col("prefix_length") - 1) / SEGMENT_EVENTS) * SEGMENT_EVENTS)


def _segment() -> WindowSpec:
    return Window.partitionBy("case_id", "offset").orderBy("prefix_length")


def prefixes_inclusive(
    log: EventLog,
    min_length: int = 1,
    max_length: int | None = None,
    case_attributes: Sequence[str] = (),
    text_attributes: Sequence[str] = (),
    numeric_attributes: Sequence[str] = (),
) -> DataFrame:
    """Prefixes of every length up to the whole case, with running event attributes.

    Case attributes come from the first event; a text attribute gives ``<name>_last``, a numeric one
    ``<name>_mean`` (nulls ignored). Activities are shared by segments (see above).
    """
    rows = _in_segments(_placed(log, max_length))
    here = _up_to_here(_segment())
    sums = {f"_sum{i}": F.sum(col(name)) for i, name in enumerate(numeric_attributes)}
    counts = {f"_count{i}": F.count(col(name)) for i, name in enumerate(numeric_attributes)}
    firsts = {f"_first{i}": name for i, name in enumerate(["ts", *case_attributes])}
    # What the segments of a case hold in sum: one row each. The window over them carries it to the next ones.
    totals = rows.groupBy("case_id", "offset").agg(
        *[value.alias(name) for name, value in (sums | counts).items()],
        F.min_by(F.struct(*[col(c).alias(n) for n, c in firsts.items()]), "prefix_length").alias("_opening"),
    )
    case = Window.partitionBy("case_id").orderBy("offset")
    earlier = case.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "case_id",
        "offset",
        *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in (*sums, *counts)],
        F.first("_opening").over(_up_to_here(case)).alias("_opening"),
    )
    if (max_length is not None and max_length <= SEGMENT_EVENTS) or not _long_cases(log):
        opening = F.first(F.struct(*[col(c).alias(n) for n, c in firsts.items()])).over(here)
        rows = rows.withColumns({"_opening": opening, **{name: F.lit(0) for name in (*sums, *counts)}})
    else:
        rows = rows.join(carried, ["case_id", "offset"])
    columns: list[str | Column] = [
        "case_id",
        "prefix_length",
        _collected("activity", here).alias("activities"),
        "offset",
        F.col("_opening._first0").alias("start_time"),
        F.col("ts").alias("current_time"),
        seconds_between(F.col("_opening._first0"), F.col("ts")).alias("elapsed_seconds"),
    ]
    columns += [F.col(f"_opening._first{i + 1}").alias(name) for i, name in enumerate(case_attributes)]
    columns += [col(name).alias(f"{name}_last") for name in text_attributes]
    for i, name in enumerate(numeric_attributes):
        total = F.coalesce(F.sum(col(name)).over(here), F.lit(0)) + F.col(f"_sum{i}")
        columns.append(F.try_divide(total, F.count(col(name)).over(here) + F.col(f"_count{i}")).alias(f"{name}_mean"))
    return rows.select(*columns).where(F.col("prefix_length") >= min_length)


def prefixes_next(
    log: EventLog,
    min_length: int = 1,
    max_length: int | None = None,
    keep: int | None = None,
    outcome: Column | None = None,
    symbol: str = "activity",
) -> DataFrame:
    """Prefixes that have a next event, with next activity, outcome and hours left as labels.

    ``keep`` carries only that many newest activities per prefix; without it activities are shared by segments
    (see above), with ``offset``. ``symbol`` names the column that is carried, such as the activity's code.
    """
    values = {"end": F.max("ts"), "outcome": last_activity(log) if outcome is None else outcome}
    few = max_length is not None and max_length < GROUP_LIMIT_ROWS
    if few or keep is None:
        rows = _labelled(log, max_length, values)
        if keep is None:
            shared = [_collected(symbol, _up_to_here(_segment())).alias("prefix_activities"), F.col("offset")]
        else:
            newest = Window.partitionBy("case_id").orderBy("prefix_length").rowsBetween(-(keep - 1), Window.currentRow)
            shared = [_collected(symbol, newest).alias("prefix_activities")]
    else:
        cases = ordered_cases(log, before=keep - 1, after=1, values=values)
        carried = [*_carried(cases)]
        rows = cases.close(
            cases.events.select(
                "case_id",
                _collected(symbol, cases.window.rowsBetween(-(keep - 1), Window.currentRow)).alias("prefix_activities"),
                cases.position.cast("bigint").alias("prefix_length"),
                F.lead("activity").over(cases.window).alias("_next"),
                cases.values["outcome"].alias("_outcome"),
                cases.values["end"].alias("_end"),
                "ts",
                cases.length.alias("_case_length"),
                *carried,
            )
        )
        shared = [F.col("prefix_activities")]
    found = rows.select(
        "case_id",
        *shared,
        "prefix_length",
        F.col("_next").alias("label_next_activity"),
        F.col("_outcome").alias("label_outcome"),
        hours_between(F.col("ts"), F.col("_end")).alias("remaining_time"),
        F.col("ts").alias("timestamp"),
        "_case_length",
    ).where((F.col("prefix_length") >= min_length) & (F.col("prefix_length") < F.col("_case_length")))
    if max_length is not None:
        found = found.where(F.col("prefix_length") <= max_length)
    return found.drop("_case_length")


def _labelled(log: EventLog, max_length: int | None, values: dict[str, Column]) -> DataFrame:
    """Events in their segments with the next activity and the figures of the whole case.

    The figures are partial aggregates, so a hot case reaches the shuffle as a few rows; the next activity of a
    segment's last event comes from the first event of the next one.
    """
    rows = _in_segments(_placed(log, max_length, more=1))
    totals = log.events.groupBy("case_id").agg(F.count(F.lit(1)).alias("_case_length"), *[v.alias(f"_{n}") for n, v in values.items()])
    if (max_length is not None and max_length < SEGMENT_EVENTS) or not _long_cases(log):
        return rows.withColumn("_next", F.lead("activity").over(_segment())).join(totals, "case_id")
    heads = rows.where((F.col("prefix_length") > 1) & (F.col("prefix_length") == F.col("offset") + 1))
    after = heads.select("case_id", (F.col("offset") - SEGMENT_EVENTS).alias("offset"), F.col("activity").alias("_following"))
    rows = rows.join(after, ["case_id", "offset"], "left").join(totals, "case_id")
    last = F.col("prefix_length") == F.col("offset") + SEGMENT_EVENTS
    return rows.withColumn("_next", F.when(last, F.col("_following")).otherwise(F.lead("activity").over(_segment())))


def whole_prefixes(prefixes: DataFrame, log: EventLog, sequence: str) -> DataFrame:
    """Prefix rows with ``offset`` made whole: ``sequence`` gets the activities of the segments before its own.

    Each row takes an array as long as its prefix, so choose the rows first.
    """
    if not _long_cases(log):
        return prefixes.drop("offset")
    segments = traces(log, SEGMENT_EVENTS).select("case_id", (F.col("segment") * SEGMENT_EVENTS).alias("_from"), F.col("activities").alias("_part"))
    keys = prefixes.where("offset > 0").select("case_id", "offset").distinct()
    before = keys.join(segments, "case_id").where(F.col("_from") < F.col("offset")).groupBy("case_id", "offset")
    opened = before.agg(F.array_sort(F.collect_list(F.struct("_from", "_part"))).alias("_parts"))
    whole = F.flatten(F.transform("_parts", lambda p: p["_part"]))
    joined = prefixes.join(opened, ["case_id", "offset"], "left")
    return joined.withColumn(sequence, F.concat(F.coalesce(whole, F.slice(col(sequence), 1, 0)), col(sequence))).select(
        *[col(c) for c in prefixes.columns if c != "offset"]
    )


def _carried(cases) -> list[str]:
    if not cases.split:
        return []
    return ["_home", "_chunk", "_position", "_length", *[f"_value_{name}" for name in cases.values]]


def next_activity_sequences(log: EventLog, length: int = 50, pad: str = "START") -> DataFrame:
    """For every event but the first: the activities before it, padded to ``length``, and its activity.

    ``remaining_seconds`` is measured at the event being predicted, unlike ``prefixes_next``.
    """
    cases = ordered_cases(log, before=length, values={"end": F.max("ts")})
    frame = cases.window.rowsBetween(-length, -1)
    rows = cases.events.select(
        "case_id",
        cases.position.cast("bigint").alias("position"),
        left_pad(_collected("activity", frame), length, F.lit(pad)).alias("sequence"),
        F.col("activity").alias("next_activity"),
        seconds_between(F.col("ts"), cases.values["end"]).alias("remaining_seconds"),
        *_carried(cases),
    )
    return cases.close(rows).where("position > 1")


def tail_events(log: EventLog, keep: int = 10) -> DataFrame:
    """The newest ``keep`` events of each case, with ``rank`` 1 for the last one.

    The limit on the rank is applied ahead of the shuffle, so a case of any length moves ``keep`` rows per task.
    """
    if keep > GROUP_LIMIT_ROWS:
        cases = ordered_cases(log)
        rows = cases.events.withColumn("rank", (cases.length - cases.position + 1).cast("bigint"))
        return cases.close(rows).where(F.col("rank") <= keep)
    newest = Window.partitionBy("case_id").orderBy(*[col(name).desc_nulls_last() for name in log.order])
    return log.events.withColumn("rank", F.row_number().over(newest).cast("bigint")).where(F.col("rank") <= keep)


def case_tails(log: EventLog, keep: int = 10, symbol: str = "activity") -> DataFrame:
    """Per case the newest ``keep`` activities, its length and its first and last time.

    ``symbol`` names the column that is carried, such as the activity's code.
    """
    steps = F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("at"), col(symbol).alias("value"))))
    newest = tail_events(log, keep).groupBy("case_id").agg(F.transform(steps, lambda s: s["value"]).alias("activities"))
    spans = log.events.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("prefix_length"), F.min("ts").alias("start_time"), F.max("ts").alias("last_time")
    )
    return newest.join(spans, "case_id")


def case_heads(log: EventLog, keep: int = 10, symbol: str = "activity") -> DataFrame:
    """Per case its first ``keep`` activities."""
    steps = F.array_sort(F.collect_list(F.struct("prefix_length", col(symbol).alias("value"))))
    return _placed(log, keep).groupBy("case_id").agg(F.transform(steps, lambda s: s["value"]).alias("first_activities"))


def with_bucket(prefixes: DataFrame, max_bucket: int = 10) -> DataFrame:
    return prefixes.withColumn("bucket_id", prefix_bucket(F.col("prefix_length"), max_bucket))


def bucket_activities(log: EventLog, max_bucket: int = 10, truncate: str = "first", symbol: str = "activity") -> DataFrame:
    """Labelled prefixes with the activities their bucket's model reads.

    The open bucket keeps ``max_bucket`` activities: the first ones of the case, or the newest ones
    with ``truncate='last'``.
    """
    if truncate not in ("first", "last"):
        raise ValueError("truncate must be 'first' or 'last'")
    rows = with_bucket(prefixes_next(log, keep=max_bucket, symbol=symbol), max_bucket)
    if truncate == "last":
        return rows
    heads = case_heads(log, max_bucket, symbol)
    longer = F.col("prefix_length") > max_bucket
    return (
        rows.join(heads, "case_id")
        .withColumn("prefix_activities", F.when(longer, F.col("first_activities")).otherwise(F.col("prefix_activities")))
        .drop("first_activities")
    )
