"""Scans, sinks and training records over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions.columns import epoch_micros
from tracewell.log import standardise
from tracewell.operators.traces import first_cases, outcome_by_last_activity, traces
from tracewell.plans.cleaning import smart_clean
from tracewell.plans.training import run_training
from tracewell.sources.readers import load_log
from tracewell.sources.sinks import scratch_folder, training_record, write_log
from tracewell.workload.registry import click_log, line_log, order_log, query, table

_ROWS = "SELECT user_id AS case_id, event_type AS activity, epoch_us(ts) AS ts_micros, event_id FROM events"


def _xes_named(spark, folder):
    events = table(spark, folder, "events")
    return events.select(
        F.col("user_id").alias("case:concept:name"),
        F.col("event_type").alias("concept:name"),
        F.col("ts").alias("time:timestamp"),
        "event_id",
    )


@query("csv_log_scan", _ROWS)
def csv_log_scan(spark, folder):
    target = scratch_folder(spark, "log") + ".csv"
    stamped = _xes_named(spark, folder).withColumn(
        "time:timestamp", F.date_format("`time:timestamp`", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )
    write_log(stamped, target)
    loaded = load_log(
        spark,
        target,
        schema="`case:concept:name` bigint, `concept:name` string, `time:timestamp` string, event_id bigint",
        timestamp_formats={"time:timestamp": ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss.SSSSSS"]},
    )
    log = standardise(loaded.events)
    return log.select("case_id", "activity", epoch_micros(F.col("ts")).alias("ts_micros"), "event_id")


@query("parquet_log_scan", _ROWS)
def parquet_log_scan(spark, folder):
    events = load_log(spark, f"{folder}/events.parquet").events
    return events.select(
        F.col("user_id").alias("case_id"), F.col("event_type").alias("activity"),
        epoch_micros(F.col("ts")).alias("ts_micros"), "event_id",
    )


@query("standardise_columns", _ROWS)
def standardise_columns(spark, folder):
    log = standardise(_xes_named(spark, folder))
    return log.select("case_id", "activity", epoch_micros(F.col("ts")).alias("ts_micros"), "event_id")


@query(
    "xes_log_scan",
    """SELECT CAST(case_id AS VARCHAR) AS case_id, c_mktsegment AS segment, activity, epoch_us(ts) AS ts_micros,
              row_number() OVER (PARTITION BY case_id ORDER BY $OORD) - 1 AS event_index
       FROM $O""",
)
def xes_log_scan(spark, folder):
    """Orders written as XES by the XML sink, a trace element per customer, and scanned back."""
    log = order_log(spark, folder)
    markets = log.events.groupBy("case_id").agg(F.first("c_mktsegment").alias("market"))

    def attribute(key, value):
        return F.struct(F.lit(key).alias("_key"), value.cast("string").alias("_value"))

    def stamp(ts):
        return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")

    document = traces(log).join(markets, "case_id").select(
        F.array(attribute("concept:name", F.col("case_id")), attribute("segment", F.col("market"))).alias("string"),
        F.transform(
            F.arrays_zip("activities", "timestamps"),
            lambda e: F.struct(
                F.array(attribute("concept:name", e["activities"])).alias("string"),
                F.array(attribute("time:timestamp", stamp(e["timestamps"]))).alias("date"),
            ),
        ).alias("event"),
    )
    target = scratch_folder(spark, "log") + ".xes"
    document.write.format("xml").option("rootTag", "log").option("rowTag", "trace").save(target)
    events = load_log(spark, target).events
    return events.select(
        F.col("`case:concept:name`").alias("case_id"),
        F.col("`case:segment`").alias("segment"),
        F.col("`concept:name`").alias("activity"),
        epoch_micros(F.col("`time:timestamp`")).alias("ts_micros"),
        F.col("event_index").cast("bigint").alias("event_index"),
    )


@query(
    "xes_attributes_scan",
    """SELECT CAST(case_id AS VARCHAR) AS case_id, c_mktsegment AS segment, activity, epoch_us(ts) AS ts_micros,
              CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS price, o_orderkey % 3 AS unit,
              row_number() OVER (PARTITION BY case_id ORDER BY $OORD) - 1 AS event_index,
              (SELECT count(DISTINCT case_id) FROM $O WHERE case_id % 7 = 3) AS rejected
       FROM $O WHERE case_id % 7 <> 3""",
)
def xes_attributes_scan(spark, folder):
    """Orders as XES text: attributes inside attributes, some missing, nobody names them, and one trace in seven is
    broken and set aside."""
    log = order_log(spark, folder)

    def attribute(tag, key, value, inside=None):
        body = F.lit("/>") if inside is None else F.concat(F.lit(">"), inside, F.lit(f"</{tag}>"))
        return F.concat(F.lit(f'<{tag} key="{key}" value="'), value.cast("string"), F.lit('"'), body)

    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")
    price = attribute("float", "price", F.col("o_totalprice"), attribute("int", "unit", F.col("o_orderkey") % 3))
    unit = attribute("boolean", "price", F.lit("open"), attribute("int", "unit", F.col("o_orderkey") % 3))
    event = F.concat(
        F.lit("<event>"), attribute("string", "concept:name", F.col("activity")), attribute("date", "time:timestamp", stamp),
        F.when(F.col("o_orderkey") % 2 == 0, price).otherwise(unit), F.lit("</event>"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("ts", "o_orderkey", event.alias("event"))))
    cases = log.events.groupBy("case_id").agg(ordered.alias("events"), F.first("c_mktsegment").alias("market"))
    segment = F.concat(F.lit('<string key="segment" value="'), "market", F.when(F.col("case_id") % 7 == 3, '">').otherwise('"/>'))
    trace = F.concat(
        F.lit("<trace>\n"), attribute("string", "concept:name", F.col("case_id")), segment,
        F.array_join(F.transform("events", lambda e: e["event"]), "\n"), F.lit("</trace>"),
    )
    target = scratch_folder(spark, "log") + ".xes"
    cases.select(trace).write.text(target)
    loaded = load_log(spark, target, mode="tolerant")
    return loaded.events.select(
        F.col("`case:concept:name`").alias("case_id"),
        F.col("`case:segment`").alias("segment"),
        F.col("`concept:name`").alias("activity"),
        epoch_micros(F.col("`time:timestamp`")).alias("ts_micros"),
        F.col("price").try_cast("double").alias("price"),
        F.col("`price/unit`").alias("unit"),
        F.col("event_index").cast("bigint").alias("event_index"),
        loaded.rejects.agg(F.count("_corrupt_record")).scalar().alias("rejected"),
    )


@query("csv_times_scan", _ROWS)
def csv_times_scan(spark, folder):
    """A CSV with dotted dates and no schema: which column holds times, and in which format, is found."""
    target = scratch_folder(spark, "log") + ".csv"
    write_log(_xes_named(spark, folder).withColumn("time:timestamp", F.date_format("`time:timestamp`", "yyyy.MM.dd HH:mm:ss.SSSSSS")), target)
    log = standardise(load_log(spark, target).events)
    return log.select(
        F.col("case_id").cast("bigint").alias("case_id"), "activity", epoch_micros(F.col("ts")).alias("ts_micros"),
        F.col("event_id").cast("bigint").alias("event_id"),
    )


@query(
    "tolerant_csv_scan",
    """SELECT event_type AS activity, count(*) FILTER (WHERE event_id % 97 <> 0) AS good_rows,
              (SELECT count(*) FROM events WHERE event_id % 97 = 0) AS rejected_rows
       FROM events WHERE event_id % 97 <> 0 GROUP BY event_type""",
)
def tolerant_csv_scan(spark, folder):
    """One line in 97 is written with a broken number; tolerant mode sets those aside."""
    events = table(spark, folder, "events")
    broken = F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("x"), F.col("event_id"))).otherwise(
        F.col("event_id").cast("string")
    )
    target = scratch_folder(spark, "log") + ".csv"
    write_log(events.select(broken.alias("event_id"), F.col("event_type").alias("activity")), target)
    loaded = load_log(spark, target, mode="tolerant", schema="event_id bigint, activity string")
    rejected = loaded.rejects.agg(F.count("_corrupt_record")).scalar()
    return (
        loaded.events.groupBy("activity")
        .agg(F.count("event_id").alias("good_rows"))
        .withColumn("rejected_rows", rejected)
    )


@query(
    "first_cases",
    """SELECT l_orderkey AS case_id, l_linenumber, l_partkey FROM lineitem
       WHERE l_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem ORDER BY 1 LIMIT 500)""",
)
def first_500_cases(spark, folder):
    return first_cases(line_log(spark, folder), 500).events.select("case_id", "l_linenumber", "l_partkey")


@query(
    "written_clean_log",
    """SELECT dense_rank() OVER (ORDER BY case_id) AS case_id, activity, epoch_us(ts) AS ts_micros, event_id
       FROM $E""",
)
def written_clean_log(spark, folder):
    target = scratch_folder(spark, "clean")
    write_log(smart_clean(click_log(spark, folder)).events, target, "parquet")
    return spark.read.parquet(target).select(
        "case_id", "activity", epoch_micros(F.col("ts")).alias("ts_micros"), "event_id"
    )


@query(
    "training_record",
    """SELECT count(DISTINCT case_id) AS cases, count(*) AS events, count(DISTINCT activity) AS activities,
              (SELECT count(DISTINCT o) FROM (SELECT last(activity ORDER BY $LORD) AS o FROM $L GROUP BY case_id))
                  AS outcome_classes,
              count(DISTINCT activity) + 2 AS vocabulary_size
       FROM $L""",
)
def line_training_record(spark, folder):
    log = line_log(spark, folder)
    return training_record(log, outcome_by_last_activity(log))


@query(
    "training_job",
    """SELECT count(DISTINCT case_id) AS cases, count(*) AS events, count(DISTINCT activity) AS activities,
              (SELECT count(DISTINCT o) FROM (SELECT last(activity ORDER BY $EORD) AS o FROM $E GROUP BY case_id))
                  AS outcome_classes,
              count(DISTINCT activity) + 2 AS vocabulary_size
       FROM $E""",
)
def training_job(spark, folder):
    """The training job on the click log, saved to the shared folder; its record is read back."""
    target = scratch_folder(spark, "run")
    run_training(click_log(spark, folder), target, phase="both")
    return spark.read.parquet(f"{target}/records").drop("recorded_at")
