"""The hot-case paths give what the plain paths give, on a log with a third of its events in one case."""

import pytest
from pyspark.sql import functions as F

from tests.logs import skewed_log, split_settings
from tracewell.log import EventLog
from tracewell.operators import ordering, prefixes, relations, traces
from tracewell.operators.blocks import hot_keys
from tracewell.operators.numbering import number_rows
from tracewell.operators.profile import datetime_profile, numeric_profile
from tracewell.operators.quantiles import percentiles
from tracewell.plans import prediction


@pytest.fixture
def split(spark):
    def both(build, *keys):
        plain = sorted(map(str, build().collect()))
        split_settings(spark, True)
        try:
            divided = sorted(map(str, build().collect()))
        finally:
            split_settings(spark, False)
        assert plain == divided
        assert plain

    return both


def test_hot_case_is_found(spark):
    log = skewed_log(spark)
    assert hot_keys(log.events, "case_id") is None
    split_settings(spark, True)
    try:
        assert [r[0] for r in hot_keys(log.events, "case_id").collect()] == ["hot"]
        assert ordering.ordered_cases(log).split
    finally:
        split_settings(spark, False)


@pytest.mark.parametrize("chunk", [7, 64, 100_000])
def test_neighbours(spark, split, monkeypatch, chunk):
    monkeypatch.setattr(ordering, "CHUNK_ROWS", chunk)
    log = skewed_log(spark)
    split(lambda: traces.with_neighbours(log).select("event_id", "position", "next_activity", "second_next_activity", "previous_ts"))


def test_directly_follows(spark, split):
    log = skewed_log(spark)
    split(lambda: relations.directly_follows(log))
    assert relations.directly_follows(log).agg(F.sum("freq")).collect()[0][0] == 3000 - log.events.select("case_id").distinct().count()


@pytest.mark.parametrize("chunk", [13, 100_000])
def test_prefixes_next(spark, split, monkeypatch, chunk):
    monkeypatch.setattr(ordering, "CHUNK_ROWS", chunk)
    log = skewed_log(spark)
    split(lambda: prefixes.prefixes_next(log, keep=10))


def test_prefixes_inclusive(spark, split):
    log = skewed_log(spark)
    split(lambda: prefixes.prefixes_inclusive(log, 1, 10, numeric_attributes=["value"]))


def test_traces_in_segments(spark, split):
    log = skewed_log(spark)
    split(lambda: traces.traces(log, segment_events=100))
    assert traces.traces(log, 100).where("case_id = 'hot'").count() == 10


def test_case_analysis(spark, split):
    log = skewed_log(spark)
    split(lambda: traces.case_analysis(log, segment_events=100))


def test_tails_and_heads(spark, split):
    log = skewed_log(spark)
    split(lambda: prefixes.case_tails(log, 10))
    split(lambda: prefixes.case_heads(log, 10))
    split(lambda: prefixes.next_activity_sequences(log, 5))


def test_scores(spark, split):
    log = skewed_log(spark)
    split(lambda: prediction.score_cases(log, prediction.train(prediction.training_samples(log))))


def test_numbers_are_consecutive(spark, split):
    log = skewed_log(spark)
    split(lambda: number_rows(log.events, ["ts", "event_id"], "number").select("event_id", "number"))
    split(lambda: number_rows(log.events.select("case_id").distinct(), ["case_id"], "number"))


def test_percentiles(spark, split):
    log = skewed_log(spark)
    frame = log.events.withColumn("odd", F.pow("value", 2) - F.col("event_id") / 7)
    split(lambda: percentiles(frame, ["value", "odd"], [0.0, 0.25, 0.5, 0.9, 1.0]).select(
        "column", F.transform("values", lambda v: F.round(v, 9)).alias("values")).orderBy("column"))


def test_time_gaps_do_not_depend_on_partitions(spark):
    log = skewed_log(spark)
    one = datetime_profile(log.events.coalesce(1), "ts").collect()
    many = datetime_profile(log.events.repartition(11), "ts").collect()
    assert one == many
    assert one[0]["min_gap_seconds"] == 0.0


@pytest.mark.parametrize("segment", [7, 64, 1000])
def test_whole_prefixes_of_a_hot_case(spark, split, monkeypatch, segment):
    """Prefixes shared by segments and put together equal those collected whole, means and labels included."""
    monkeypatch.setattr(prefixes, "SEGMENT_EVENTS", segment)
    log = skewed_log(spark, 600)
    split(lambda: prefixes.prefixes_inclusive(log, numeric_attributes=["value"], case_attributes=["event_id"]))
    split(lambda: prefixes.prefixes_next(log))
    want = {}
    for r in sorted(log.events.collect(), key=lambda r: (r["case_id"], r["ts"], r["event_id"])):
        want.setdefault(r["case_id"], []).append(r)
    found = prefixes.whole_prefixes(prefixes.prefixes_inclusive(log, numeric_attributes=["value"], case_attributes=["event_id"]), log, "activities").collect()
    assert len(found) == 600 and "offset" not in found[0].asDict()
    for r in found:
        events = want[r["case_id"]][: r["prefix_length"]]
        assert r["activities"] == [e["activity"] for e in events] and r["event_id"] == events[0]["event_id"]
        assert r["start_time"] == events[0]["ts"] and abs(r["value_mean"] - sum(e["value"] for e in events) / len(events)) < 1e-9
    shared = prefixes.prefixes_next(log)
    assert shared.agg(F.max(F.size("prefix_activities"))).first()[0] <= segment
    for r in prefixes.whole_prefixes(shared, log, "prefix_activities").collect():
        events = want[r["case_id"]]
        assert r["prefix_activities"] == [e["activity"] for e in events[: r["prefix_length"]]]
        assert r["label_next_activity"] == events[r["prefix_length"]]["activity"] and r["label_outcome"] == events[-1]["activity"]
    assert shared.count() == 600 - len(want)


def test_a_case_of_twenty_thousand_events_stops_nothing(spark):
    log = skewed_log(spark, 60_000)
    shared = prefixes.prefixes_next(log)
    assert shared.where("case_id = 'hot'").agg(F.max("prefix_length"), F.max(F.size("prefix_activities"))).first()[:] == (19_999, 1000)
    chosen = prefixes.prefixes_inclusive(log).where("case_id = 'hot' AND prefix_length IN (1, 1000, 1001, 20000)")
    sizes = prefixes.whole_prefixes(chosen, log, "activities").select("prefix_length", F.size("activities"))
    assert sorted(map(tuple, sizes.collect())) == [(1, 1), (1000, 1000), (1001, 1001), (20000, 20000)]


def test_events_without_activity_keep_their_place(spark):
    rows = [("1", "a", 1), ("1", None, 2), ("1", "b", 3)]
    events = spark.createDataFrame(rows, "case_id string, activity string, t int")
    log = EventLog(events.selectExpr("case_id", "activity", "timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, t) AS ts"), ("ts",))
    assert [r["activities"] for r in prefixes.prefixes_inclusive(log).orderBy("prefix_length").collect()] == [["a"], ["a", None], ["a", None, "b"]]
    for keep in (None, 2):
        assert [r["prefix_activities"] for r in prefixes.prefixes_next(log, keep=keep).orderBy("prefix_length").collect()] == [["a"], ["a", None]]
    assert prefixes.case_tails(log, 2).first()["activities"] == [None, "b"]


def test_percentiles_of_odd_columns(spark, split):
    """A quarter NaN, one value in seven rows of ten, and a column without any value."""
    frame = spark.range(1000).selectExpr(
        "IF(id % 4 = 0, double('NaN'), double(id)) AS some", "IF(id % 10 < 7, 0D, double(id)) AS common", "CAST(NULL AS DOUBLE) AS nothing"
    )
    split(lambda: percentiles(frame, ["some", "common", "nothing"], [0.0, 0.5, 0.9, 1.0]))
    found = {r["column"]: r["values"] for r in percentiles(frame, ["some", "common", "nothing"], [0.0, 0.5, 1.0]).collect()}
    assert found == {"some": [1.0, 500.0, 999.0], "common": [0.0, 0.0, 999.0], "nothing": [None] * 3}
    profile = {r["column"]: r for r in numeric_profile(frame).collect()}
    assert set(profile) == {"some", "common", "nothing"}
    assert profile["nothing"]["missing"] == 1000 and profile["nothing"]["p50"] is None and profile["nothing"]["outliers"] == 0


def test_text_times_and_one_date(spark, split):
    log = skewed_log(spark)
    text = log.with_events(log.events.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    split(lambda: traces.with_neighbours(text).select("event_id", "position", "next_activity"))
    dated = log.with_events(log.events.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")))
    split(lambda: relations.directly_follows(dated))


def test_ranges_part_equal_first_columns(spark):
    split_settings(spark, True)
    try:
        log = skewed_log(spark)
        dated = log.events.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
        numbered = number_rows(dated, ["ts", "event_id"], "number").withColumn("task", F.spark_partition_id())
        assert numbered.groupBy("task").count().agg(F.max("count")).first()[0] <= 600
    finally:
        split_settings(spark, False)


def test_events_without_activity_are_no_boundary(spark):
    rows = [("1", "a", 1), ("1", None, 2), ("1", "b", 3), ("2", "a", 1), ("2", None, 2)]
    events = spark.createDataFrame(rows, "case_id string, activity string, t int")
    log = EventLog(events.selectExpr("case_id", "activity", "timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, t) AS ts"), ("ts",))
    wanted = {("start", "a", 2), ("end", "b", 1)}
    assert {tuple(r) for r in relations.boundary_activities(log).collect()} == wanted
    assert {tuple(r) for r in relations.boundaries_of(relations.relation_counts(log)).collect()} == wanted
