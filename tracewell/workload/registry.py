"""Registration of queries and the driver tables bound as event logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.log import EventLog
from tracewell.operators.cleaning import remove_duplicates
from tracewell.session import RUNTIME_CONF

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame and its SQL; ``$L $E $O $B $C $Y $F`` name the logs."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            for key, value in RUNTIME_CONF.items():
                spark.conf.set(key, value)
            return build(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = expand(sql)
        return build

    return register


def expand(sql: str) -> str:
    for mark, text in _SQL_LOGS.items():
        sql = sql.replace(mark, text)
    return sql


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def line_log(spark: SparkSession, folder: str) -> EventLog:
    """Order lines: a case per order, return flag and line status as activity."""
    return EventLog.of(
        table(spark, folder, "lineitem"),
        case_id="l_orderkey",
        activity="concat(l_returnflag, '-', l_linestatus)",
        ts="l_shipdate",
        tiebreak=LINE_ORDER,
        keep=["l_quantity", "l_returnflag"],
    )


def click_log(spark: SparkSession, folder: str) -> EventLog:
    """User events: a case per user, about 67 events each."""
    events = table(spark, folder, "events").withColumn(
        "resource", F.get_json_object("props", "$.k")
    )
    return EventLog.of(events, "user_id", "event_type", "ts", ["event_id"], keep=["value", "resource"])


def order_log(spark: SparkSession, folder: str) -> EventLog:
    """Customer orders: a case per customer, the priority as activity, the segment as case attribute."""
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    orders = table(spark, folder, "orders").join(customers, "o_custkey")
    return EventLog.of(
        orders, "o_custkey", "o_orderpriority", "o_orderdate", ["o_orderkey"],
        keep=["o_orderstatus", "o_totalprice", "c_mktsegment"],
    )


def talk_log(spark: SparkSession, folder: str) -> EventLog:
    """Conversations: ordered by turn, without times."""
    return EventLog.of(table(spark, folder, "conversations"), "conv_id", "role", tiebreak=["turn"])


def year_log(spark: SparkSession, folder: str) -> EventLog:
    """Shipments of an order by year; in even years one of three lanes by order number."""
    return EventLog.of(
        table(spark, folder, "lineitem"),
        case_id="l_orderkey",
        activity="concat('Y', year(l_shipdate), "
        "CASE WHEN year(l_shipdate) % 2 = 0 THEN concat('-', l_orderkey % 3) ELSE '' END)",
        ts="l_shipdate",
        tiebreak=LINE_ORDER,
    )


def stage_log(spark: SparkSession, folder: str) -> EventLog:
    """First shipment of an order in each year and lane.

    Years follow each other, and the lanes exclude each other, so the log has a process to discover.
    """
    log = year_log(spark, folder)
    return log.with_events(remove_duplicates(log.events, ["case_id", "activity"], "first", log.order))


def busy_log(spark: SparkSession, folder: str) -> EventLog:
    """User events by type and hour: up to 120 activities, which repeat and follow themselves."""
    activity = "concat(event_type, '@', hour(ts))"
    return EventLog.of(table(spark, folder, "events"), "user_id", activity, "ts", ["event_id"])


_SQL_LOGS = {
    "$LORD": "ts, l_linenumber, l_partkey, l_suppkey, l_extendedprice",
    "$EORD": "ts, event_id",
    "$OORD": "ts, o_orderkey",
    "$L": "(SELECT l_orderkey AS case_id, l_returnflag || '-' || l_linestatus AS activity, l_shipdate AS ts, "
    "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag FROM lineitem)",
    "$E": "(SELECT user_id AS case_id, event_type AS activity, ts, event_id, value, "
    "json_extract_string(props, '$.k') AS resource FROM events)",
    "$O": "(SELECT o_custkey AS case_id, o_orderpriority AS activity, o_orderdate AS ts, o_orderkey, "
    "o_orderstatus, o_totalprice, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey)",
    "$B": "(SELECT user_id AS case_id, event_type || '@' || hour(ts) AS activity, ts, event_id FROM events)",
    "$C": "(SELECT conv_id AS case_id, role AS activity, turn FROM conversations)",
    "$Y": "(SELECT l_orderkey AS case_id, 'Y' || year(l_shipdate) || CASE WHEN year(l_shipdate) % 2 = 0 "
    "THEN '-' || (l_orderkey % 3) ELSE '' END AS activity, l_shipdate AS ts, l_linenumber, l_partkey, l_suppkey, "
    "l_extendedprice FROM lineitem)",
    "$F": "(SELECT * FROM (SELECT l_orderkey AS case_id, 'Y' || year(l_shipdate) || CASE WHEN year(l_shipdate) % 2 = 0 "
    "THEN '-' || (l_orderkey % 3) ELSE '' END AS activity, l_shipdate AS ts, l_linenumber, l_partkey, l_suppkey, "
    "l_extendedprice FROM lineitem) t QUALIFY row_number() OVER (PARTITION BY t.case_id, t.activity "
    "ORDER BY t.ts, t.l_linenumber, t.l_partkey, t.l_suppkey, t.l_extendedprice) = 1)",
}
