"""Predictions for running cases as events arrive, in whatever order they do.

Each case keeps a small state: how many events it has had, its newest activities with their times and tie-breaks in
order, its first and last time. A late event takes its place by time, so what a case ends with does not depend on the
order of arrival or on how events fall into triggers. Every trigger emits the cases that moved, joined with the
trained state table. The state of a case does not grow with the case and is dropped when the case has been quiet for
longer than the time-out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.functions.columns import epoch_micros
from tracewell.plans.prediction import HORIZON, TransitionModel, as_response, predict

OUTPUT = "case_id string, activities array<string>, prefix_length bigint, start_micros bigint, last_micros bigint"
STATE = (
    "micros array<bigint>, tiebreaks array<{kind}>, activities array<string>, length bigint, start_micros bigint, "
    "last_micros bigint"
)
# Events of a case in the same second may travel together; lateness is judged for them as one.
GRAIN_MICROS = 1_000_000


def _combine(horizon: int, grain: int) -> Callable:
    """Reduce each Arrow batch to one row per case and second before the shuffle, so a hot case stays small."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            batch["second"] = batch["micros"] // grain
            ordered = batch.sort_values(["case_id", "second", "micros", "tiebreak"], na_position="first")
            case, second, micros = (ordered[c].to_numpy() for c in ("case_id", "second", "micros"))
            first = np.flatnonzero(np.append(True, (case[1:] != case[:-1]) | (second[1:] != second[:-1])))
            end = np.append(first[1:], len(ordered))
            cuts = list(zip(np.maximum(first, end - horizon).tolist(), end.tolist()))
            newest = {}
            for name in ("micros", "tiebreak", "activity"):
                values = ordered[name].tolist()
                newest[name] = [values[i:j] for i, j in cuts]
            yield pd.DataFrame(
                {
                    "case_id": case[first],
                    "ts": pd.to_datetime(micros[end - 1], unit="us", utc=True),
                    "events": end - first,
                    "low": micros[first],
                    "high": micros[end - 1],
                    "micros": newest["micros"],
                    "tiebreaks": newest["tiebreak"],
                    "activities": newest["activity"],
                }
            )

    return partial


def _place(event: tuple) -> tuple:
    """Where an event stands in its case: time, then tie-break, nulls first."""
    micros, tiebreak, _ = event
    return micros, tiebreak is not None, 0 if tiebreak is None else tiebreak


def _plain(value):
    """The value as Python's own type, which the state store can read."""
    return value.item() if hasattr(value, "item") else value


def _advance(horizon: int, timeout_ms: int) -> Callable:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        *kept, length, start, last = state.get if state.exists else ([], [], [], 0, None, None)
        newest = list(zip(*kept, strict=True))
        for batch in batches:
            length += int(batch["events"].sum())
            low, high = int(batch["low"].min()), int(batch["high"].max())
            start = low if start is None else min(start, low)
            last = high if last is None else max(last, high)
            for row in batch.itertuples():
                newest += zip(row.micros, row.tiebreaks, row.activities, strict=True)
            newest = sorted(newest, key=_place)[-horizon:]
        micros, tiebreaks, activities = ([_plain(e[k]) for e in newest] for k in range(3))
        state.update((micros, tiebreaks, activities, length, start, last))
        # The time-out must lie past the watermark that has already been reached.
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + timeout_ms)
        yield pd.DataFrame(
            {
                "case_id": [key[0]],
                "activities": [activities],
                "prefix_length": [length],
                "start_micros": [start],
                "last_micros": [last],
            }
        )

    return step


def running_cases(
    events: DataFrame,
    tiebreak: str = "event_id",
    horizon: int = HORIZON,
    watermark: str = "1 day",
    quiet_days: int = 30,
) -> DataFrame:
    """Stream of ``case_id, activity, ts, <tiebreak>`` to one row per case that moved in a trigger.

    The events of a case count in the order of time and tie-break, also across triggers. An event is late, and
    dropped, when it is older than the watermark; only events of one case in the same second share that decision.
    A case that comes back after its time-out begins anew.
    """
    slim = events.select(
        F.col("case_id").cast("string").alias("case_id"),
        "activity",
        epoch_micros(F.col("ts")).alias("micros"),
        F.col(tiebreak).alias("tiebreak"),
    ).where("case_id IS NOT NULL AND micros IS NOT NULL")
    kind = dict(slim.dtypes)["tiebreak"]
    combined = slim.mapInPandas(
        _combine(horizon, GRAIN_MICROS),
        "case_id string, ts timestamp, events bigint, low bigint, high bigint, micros array<bigint>, "
        f"tiebreaks array<{kind}>, activities array<string>",
    )
    return (
        combined.withWatermark("ts", watermark)
        .groupBy("case_id")
        .applyInPandasWithState(
            _advance(horizon, quiet_days * 86_400_000),
            OUTPUT,
            STATE.format(kind=kind),
            "update",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def monitor(
    events: DataFrame,
    model: TransitionModel,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    available_now: bool = False,
    interval: str = "30 seconds",
    **settings,
) -> StreamingQuery:
    """Predict for every case that moved, at each trigger, and hand the rows to ``write(rows, batch_id)``.

    ``checkpoint`` is a folder all executors can reach. ``available_now`` drains the source and stops.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        # The batch is read twice (its states, then its rows); keep it for the length of the trigger.
        rows.persist()
        write(as_response(predict(rows, model)), batch_id)
        rows.unpersist()

    writer = (
        running_cases(events, **settings)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(batch)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
