"""Schema operators over the given tables; null variants are derived the same way on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions.columns import epoch_micros
from tracewell.operators import columns as ops
from tracewell.operators.profile import value_counts
from tracewell.workload.registry import query, rounded, table

_TYPE = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
           WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END"""
_KIND = """CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' WHEN data_type = 'VARCHAR' THEN 'text'
           WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' ELSE 'other' END"""


def _filled(spark, folder):
    """Filled cells per column, so that the listings say something about the rows as well."""
    lines = table(spark, folder, "lineitem")
    counts = value_counts(lines, lines.columns).where("value IS NOT NULL")
    return counts.groupBy("column").agg(F.sum("count").alias("filled"), F.count(F.lit(1)).alias("distinct_values"))


_FILLED = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS filled, count(DISTINCT {c}) AS distinct_values FROM lineitem"
    for c in (
        "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag "
        "l_linestatus l_shipdate"
    ).split()
)


@query("list_columns", f"SELECT \"column\", filled FROM ({_FILLED})")
def list_columns(spark, folder):
    filled = _filled(spark, folder).drop("distinct_values")
    return ops.list_columns(table(spark, folder, "lineitem")).join(filled, "column", "left")


@query(
    "list_column_types",
    f"""SELECT column_name AS "column", {_TYPE} AS dtype, {_KIND} AS detected_type, distinct_values
        FROM ({_FILLED}) JOIN (SELECT column_name, CASE WHEN column_type LIKE 'TIMESTAMP%' THEN 'TIMESTAMP' ELSE column_type END AS data_type
              FROM (DESCRIBE lineitem)) ON "column" = column_name""",
)
def list_column_types(spark, folder):
    distinct = _filled(spark, folder).drop("filled")
    return ops.list_column_types(table(spark, folder, "lineitem")).join(distinct, "column", "left")


@query("keep_columns", "SELECT event_type, event_id, value FROM events")
def keep_columns(spark, folder):
    return ops.keep_columns(table(spark, folder, "events"), ["event_type", "missing", "event_id", "value"])


@query("drop_columns", "SELECT event_id, user_id, event_type, value FROM events")
def drop_columns(spark, folder):
    return ops.drop_columns(table(spark, folder, "events"), ["ts", "props", "missing"])


_SPARSE = "CASE WHEN o_orderkey % 50 = 0 THEN o_orderpriority END"


@query("drop_constant_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def drop_constant_columns(spark, folder):
    wide = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.lit("same").alias("constant"), F.expr(_SPARSE).alias("sparse"),
        F.lit(None).cast("string").alias("empty"),
    )
    return ops.drop_constant_columns(wide, null_threshold=0.9)


@query(
    "drop_empty_columns",
    f"SELECT o_orderkey, 'same' AS constant, {_SPARSE} AS sparse FROM orders",
)
def drop_empty_columns(spark, folder):
    wide = table(spark, folder, "orders").select(
        "o_orderkey", F.lit("same").alias("constant"), F.expr(_SPARSE).alias("sparse"),
        F.expr("nullif(o_orderpriority, o_orderpriority)").alias("empty"),
    )
    return ops.drop_empty_columns(wide)


@query("rename_column", "SELECT event_id, event_type AS \"concept:name\" FROM events")
def rename_column(spark, folder):
    return ops.rename_column(table(spark, folder, "events").select("event_id", "event_type"), "event_type", "concept:name")


@query(
    "merge_columns",
    """SELECT event_id, coalesce(nullif(event_type, 'error'), 'nan') || '|' || CAST(user_id AS VARCHAR) AS merged
       FROM events""",
)
def merge_columns(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id", F.expr("nullif(event_type, 'error')").alias("event_type"), "user_id"
    )
    return ops.merge_columns(events, ["event_type", "user_id"], "merged", "|", drop_original=True)


_AMOUNT = "CASE WHEN event_id % 10 = 0 THEN 'n/a' WHEN event_id % 10 = 1 THEN NULL ELSE CAST(event_id % 1000 AS VARCHAR) END"


def _amounts(spark, folder):
    amount = _AMOUNT.replace("VARCHAR", "STRING")
    return table(spark, folder, "events").select("event_id", F.expr(amount).alias("amount"))


_READ = f"SELECT event_id, try_cast({_AMOUNT} AS DOUBLE) AS amount FROM events"


@query("convert_numeric", _READ)
def convert_numeric(spark, folder):
    return ops.convert_column(_amounts(spark, folder), "amount", "numeric")


@query("convert_numeric_delete", f"SELECT * FROM ({_READ}) WHERE amount IS NOT NULL")
def convert_numeric_delete(spark, folder):
    return ops.convert_column(_amounts(spark, folder), "amount", "numeric", on_fail="delete")


@query("convert_numeric_default", f"SELECT event_id, coalesce(amount, -1.0) AS amount FROM ({_READ})")
def convert_numeric_default(spark, folder):
    return ops.convert_column(_amounts(spark, folder), "amount", "numeric", on_fail="default", default_value=-1.0)


@query(
    "convert_numeric_mean",
    f"""SELECT event_id, round(coalesce(amount, (SELECT avg(amount) FROM ({_READ}))), 6) AS amount FROM ({_READ})""",
)
def convert_numeric_mean(spark, folder):
    return rounded(ops.convert_column(_amounts(spark, folder), "amount", "numeric", on_fail="medium"), "amount")


@query(
    "convert_datetime",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_us(date_trunc('day', ts))
                                          WHEN 1 THEN epoch_us(date_trunc('second', ts)) ELSE -1 END AS at_micros
       FROM events""",
)
def convert_datetime(spark, folder):
    text = (
        F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "dd.MM.yyyy"))
        .when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))
        .otherwise(F.lit("someday"))
    )
    events = table(spark, folder, "events").select("event_id", text.alias("at"))
    read = ops.convert_column(events, "at", "datetime", datetime_formats=["dd.MM.yyyy", "yyyy/MM/dd HH:mm:ss"])
    return read.select("event_id", F.coalesce(epoch_micros(F.col("at")), F.lit(-1)).alias("at_micros"))


_FLAG = """CASE event_id % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN 'FALSE' WHEN 2 THEN '1' WHEN 3 THEN 'no ' ELSE 'maybe' END"""


@query(
    "convert_bool",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'true' WHEN 3 THEN 'false' END AS flag FROM events",
)
def convert_bool(spark, folder):
    texts = table(spark, folder, "events").select("event_id", F.expr(_FLAG).alias("flag"))
    return ops.convert_column(texts, "flag", "bool").withColumn("flag", F.col("flag").cast("string"))


@query("normalise_names", "SELECT event_id, event_type AS event_type_name, user_id FROM events")
def normalise_names(spark, folder):
    events = table(spark, folder, "events")
    return ops.normalise_names(
        events.select("event_id", F.col("event_type").alias(" Event Type Name"), F.col("user_id").alias("USER_ID"))
    )


@query(
    "infer_types",
    """SELECT event_id, epoch_us(date_trunc('second', ts)) AS time_micros, CAST(user_id AS DOUBLE) AS user_code, event_type
       FROM events""",
)
def infer_types(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("entry_time"),
        F.col("user_id").cast("string").alias("user_code"),
        "event_type",
    )
    typed, _ = ops.infer_types(events)
    return typed.select("event_id", epoch_micros(F.col("entry_time")).alias("time_micros"), "user_code", "event_type")


@query("align_features", "SELECT value, CAST(NULL AS DOUBLE) AS elapsed, event_id FROM events")
def align_features(spark, folder):
    return ops.align_features(
        table(spark, folder, "events"), {"value": "double", "elapsed": "double", "event_id": "bigint"}
    )
