"""Small logs written for the tests."""

from tracewell.log import EventLog

# The six-case example log: traces and first day in February 2015.
GOLDEN = [("1", "abcd", 10), ("2", "abcd", 10), ("3", "abcd", 10), ("4", "acbd", 14), ("5", "acbd", 18), ("6", "aed", 22)]


def golden_rows():
    return [
        (case, activity, f"2015-02-{day + i:02d} 00:00:00") for case, trace, day in GOLDEN for i, activity in enumerate(trace)
    ]


def golden_log(spark) -> EventLog:
    rows = spark.createDataFrame(golden_rows(), "case_id string, activity string, t string")
    return EventLog(rows.selectExpr("case_id", "activity", "CAST(t AS TIMESTAMP_NTZ) AS ts"), ("ts",))


def skewed_log(spark, rows: int = 3000) -> EventLog:
    """A third of all events in one case, many of them at equal times; some cases with one event."""
    data = spark.range(rows).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('c', id % 97) END AS case_id",
        "element_at(array('a', 'b', 'c', 'd'), CAST(hash(id) % 4 + 4 AS INT) % 4 + 1) AS activity",
        f"TIMESTAMP_NTZ '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, CAST((id * 7919 % {rows}) DIV 5 AS INT)) AS ts",
        "id AS event_id",
        "CAST(id % 13 AS DOUBLE) AS value",
    )
    return EventLog(data, ("ts", "event_id"))


def split_settings(spark, on: bool):
    """Make the small test log large in the eyes of the library, so that hot cases are split."""
    if on:
        spark.conf.set("tracewell.rowsPerTask", "200")
    else:
        spark.conf.unset("tracewell.rowsPerTask")
