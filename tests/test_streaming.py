import datetime as dt
import time

import pandas as pd

from tests.logs import skewed_log
from tracewell.plans import prediction
from tracewell.streaming.monitor import _combine, monitor, running_cases


def test_stream_ends_where_the_batch_ends(spark, tmp_path):
    log = skewed_log(spark, 1200)
    model = prediction.train(prediction.training_samples(log))
    source = str(tmp_path / "events")
    # Three files in time order; the stream takes one per trigger. Equal times stay in one file.
    for i, (low, high) in enumerate([(0, 80), (80, 160), (160, 10_000)]):
        start = dt.datetime(2024, 1, 1)
        part = log.events.where(
            (log.events.ts >= start + dt.timedelta(seconds=low)) & (log.events.ts < start + dt.timedelta(seconds=high))
        )
        part.coalesce(1).write.mode("append").parquet(source)
    events = spark.readStream.schema(log.events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    seen = []

    def write(rows, batch_id):
        seen.extend((batch_id, row) for row in rows.collect())

    query = monitor(events, model, write, str(tmp_path / "checkpoint"), available_now=True)
    query.awaitTermination(120)
    assert query.exception() is None
    last = {}
    for batch_id, row in seen:
        if row["case_id"] not in last or last[row["case_id"]][0] < batch_id:
            last[row["case_id"]] = (batch_id, row)
    expected = {row["case_id"]: row for row in prediction.score_cases(log, model).collect()}
    assert {case: row for case, (_, row) in last.items()} == expected
    assert len({b for b, _ in seen}) == 3


def drained(spark, folder, files, tmp_path, **settings):
    """The rows that ``running_cases`` emits for files of events, one file a trigger."""
    for k, rows in enumerate(files):
        frame = spark.createDataFrame(rows, "case_id string, activity string, t string, event_id long")
        frame.selectExpr("case_id", "activity", "CAST(t AS TIMESTAMP_NTZ) AS ts", "event_id").coalesce(1).write.parquet(f"{folder}/{k:03d}")
        time.sleep(1.1)  # the source goes by the files' times
    schema = "case_id string, activity string, ts timestamp_ntz, event_id long"
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    seen = []
    query = (
        running_cases(events, **settings)
        .writeStream.outputMode("update")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .foreachBatch(lambda rows, batch_id: seen.extend((batch_id, r) for r in rows.collect()))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    return seen


def test_files_out_of_order_end_where_the_batch_ends(spark, tmp_path):
    """Events dealt over seven files by a hash, so that every trigger brings events older than those before."""
    log = skewed_log(spark, 1500)
    model = prediction.train(prediction.training_samples(log))
    source = str(tmp_path / "events")
    log.events.repartition(7, "event_id").write.parquet(source)
    events = spark.readStream.schema(log.events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    last = {}

    def write(rows, batch_id):
        last.update({row["case_id"]: row for row in rows.collect()})

    query = monitor(events, model, write, str(tmp_path / "checkpoint"), available_now=True)
    query.awaitTermination(120)
    assert query.exception() is None and len(query.recentProgress) >= 5
    assert last == {row["case_id"]: row for row in prediction.score_cases(log, model).collect()}


def test_lateness_is_judged_by_event(spark, tmp_path):
    """The third file holds a late and a timely event of one case: only the first is dropped."""
    files = [
        [("a", "x", "2024-01-10 00:00:00", 1), ("b", "x", "2024-01-10 00:00:00", 2)],
        [("b", "y", "2024-01-10 01:00:00", 3)],
        [("a", "late", "2024-01-01 00:00:00", 4), ("a", "z", "2024-01-10 02:00:00", 5), ("a", "w", "2024-01-09 12:00:00", 6)],
    ]
    seen = drained(spark, str(tmp_path / "in"), files, tmp_path, watermark="1 day")
    newest = {r["case_id"]: r for _, r in sorted(seen, key=lambda x: x[0])}
    assert (newest["a"]["activities"], newest["a"]["prefix_length"]) == (["w", "x", "z"], 3)
    assert (newest["b"]["activities"], newest["b"]["prefix_length"]) == (["x", "y"], 2)


def test_quiet_cases_are_dropped_and_begin_anew(spark, tmp_path):
    files = [
        [("a", "x", "2024-01-01 00:00:00", 1)],
        [("b", "x", "2024-03-01 00:00:00", 2)],
        [("b", "y", "2024-03-02 00:00:00", 3)],
        [("a", "z", "2024-03-03 00:00:00", 4), ("b", None, "2024-03-03 00:00:00", None)],
    ]
    seen = drained(spark, str(tmp_path / "in"), files, tmp_path, watermark="1 day", quiet_days=10)
    newest = {r["case_id"]: r for _, r in sorted(seen, key=lambda x: x[0])}
    assert (newest["a"]["activities"], newest["a"]["prefix_length"]) == (["z"], 1)
    assert (newest["b"]["activities"], newest["b"]["prefix_length"]) == (["x", "y", None], 3)


def test_events_combine_without_a_call_for_each_second(monkeypatch):
    """Most seconds of a case hold one event, so a pandas call for each of them took most of the stream's time."""

    def refuse(*_, **__):
        raise AssertionError("a pandas group for each case and second")

    monkeypatch.setattr(pd.DataFrame, "groupby", refuse)
    batch = pd.DataFrame(
        {
            "case_id": ["b", "a", "a", "a", "a"], "activity": ["v", "z", "y", None, "x"],
            "micros": [5, 2_000_001, 7, 7, 3], "tiebreak": [1.0, 2.0, 3.0, None, 4.0],
        }
    )
    (found,) = _combine(2, 1_000_000)(iter([pd.DataFrame(), batch]))
    assert found[["case_id", "events", "low", "high"]].to_numpy().tolist() == [["a", 3, 3, 7], ["a", 1, 2_000_001, 2_000_001], ["b", 1, 5, 5]]
    assert found["activities"].tolist() == [[None, "y"], ["z"], ["v"]] and found["micros"].tolist() == [[7, 7], [2_000_001], [5]]
    assert str(found["tiebreaks"].tolist()) == "[[nan, 3.0], [2.0], [1.0]]"
