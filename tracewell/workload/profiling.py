"""Profile sections over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import profile as ops
from tracewell.operators.traces import outcome_by_attribute
from tracewell.operators.prefixes import prefixes_next, with_bucket
from tracewell.workload.registry import click_log, line_log, order_log, query, rounded, table

_VALUE = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END"
_TYPE = "nullif(event_type, 'error')"


def _gappy(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", "user_id", F.expr(_TYPE).alias("event_type"), F.expr(_VALUE).alias("value"), "ts"
    )


_G = f"(SELECT event_id, user_id, {_TYPE} AS event_type, {_VALUE} AS value, ts FROM events)"


@query(
    "unique_summary",
    f"""SELECT coalesce(event_type, 'nan') || '_' || CAST(user_id % 10 AS VARCHAR) AS value, count(*) AS count
        FROM {_G} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
)
def unique_summary(spark, folder):
    events = _gappy(spark, folder).withColumn("cell", F.col("user_id") % 10)
    return ops.unique_summary(events, ["event_type", "cell"], top_n=20)


@query("unique_values", "SELECT CAST(l_partkey AS VARCHAR) AS value, count(*) AS count FROM lineitem GROUP BY 1")
def unique_values(spark, folder):
    return ops.unique_summary(table(spark, folder, "lineitem"), ["l_partkey"])


@query(
    "profile_summary",
    """SELECT count(*) AS rows, 11 AS columns, 8 AS numeric_columns, 1 AS datetime_columns, 2 AS text_columns,
              0 AS boolean_columns FROM lineitem""",
)
def profile_summary(spark, folder):
    return ops.summary(table(spark, folder, "lineitem"))


def _numeric(column, source=_G):
    return f"""SELECT '{column}' AS "column", count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
        min(v) AS min, max(v) AS max, count(*) - count(v) AS missing, round(any_value(p25), 6) AS p25,
        round(any_value(p50), 6) AS p50, round(any_value(p75), 6) AS p75, round(any_value(p75 - p25), 6) AS iqr,
        count(*) FILTER (WHERE v < p25 - 1.5 * (p75 - p25) OR v > p75 + 1.5 * (p75 - p25)) AS outliers,
        round(100.0 * (count(*) - count(v)) / count(*), 6) AS missing_percent
        FROM (SELECT CAST({column} AS DOUBLE) AS v FROM {source}),
             (SELECT quantile_cont({column}, 0.25) AS p25, quantile_cont({column}, 0.5) AS p50,
                     quantile_cont({column}, 0.75) AS p75 FROM {source})"""


@query("profile_numeric", _numeric("value") + " UNION ALL " + _numeric("user_id"))
def profile_numeric(spark, folder):
    found = ops.numeric_profile(_gappy(spark, folder), ["value", "user_id"])
    return rounded(found, "mean", "std", "p25", "p50", "p75", "iqr", "missing_percent")


@query("profile_numeric_nan", _numeric("value", f"(SELECT CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM {_G})"))
def profile_numeric_nan(spark, folder):
    """NaN is a missing cell like null."""
    rows = _gappy(spark, folder).select(F.expr("IF(event_id % 5 = 0, double('NaN'), value)").alias("value"))
    return rounded(ops.numeric_profile(rows), "mean", "std", "p25", "p50", "p75", "iqr", "missing_percent")


@query(
    "profile_datetime",
    """SELECT 'ts' AS "column", min(t) AS first_micros, max(t) AS last_micros, round((max(t) - min(t)) / 1e6, 6) AS span_seconds,
        count(DISTINCT t) AS distinct_values, round(min(gap) / 1e6, 6) AS min_gap_seconds,
        round(max(gap) / 1e6, 6) AS max_gap_seconds, round((max(t) - min(t)) / 1e6 / (count(t) - 1), 6) AS mean_gap_seconds,
        count(*) - count(t) AS missing, round(100.0 * (count(*) - count(t)) / count(*), 6) AS missing_percent
       FROM (SELECT t, t - lag(t) OVER (ORDER BY t NULLS LAST) AS gap
             FROM (SELECT CASE WHEN event_id % 9 <> 0 THEN epoch_us(ts) END AS t FROM events))""",
)
def profile_datetime(spark, folder):
    events = table(spark, folder, "events").select(F.expr("CASE WHEN event_id % 9 <> 0 THEN ts END").alias("ts"))
    found = ops.datetime_profile(events, "ts")
    return rounded(
        found, "span_seconds", "min_gap_seconds", "max_gap_seconds", "mean_gap_seconds", "missing_percent"
    )


def _categorical(column, source):
    return f"""SELECT '{column}' AS "column", count(*) FILTER (WHERE v IS NOT NULL) AS unique_count,
        (SELECT CAST({column} AS VARCHAR) FROM {source} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
            AS top_value,
        max(n) FILTER (WHERE v IS NOT NULL) AS top_freq,
        round(100.0 * max(n) FILTER (WHERE v IS NOT NULL) / sum(n), 6) AS top_percent,
        round(sum(CASE WHEN v IS NOT NULL THEN -(n / t) * log2(n / t + 1e-12) END), 6) AS entropy,
        CAST(sum(n) FILTER (WHERE v IS NULL) AS BIGINT) AS missing,
        round(100.0 * sum(n) FILTER (WHERE v IS NULL) / sum(n), 6) AS missing_percent
        FROM (SELECT {column} AS v, count(*) AS n FROM {source} GROUP BY 1),
             (SELECT CAST(count({column}) AS DOUBLE) AS t FROM {source})"""


_TYPED = f"(SELECT event_type, nullif(json_extract_string(props, '$.k'), '7') AS resource FROM {_G.replace('ts FROM', 'ts, props FROM')})"


@query("profile_categorical", _categorical("event_type", _TYPED) + " UNION ALL " + _categorical("resource", _TYPED))
def profile_categorical(spark, folder):
    events = table(spark, folder, "events").select(
        F.expr(_TYPE).alias("event_type"), F.expr("nullif(get_json_object(props, '$.k'), '7')").alias("resource")
    )
    return rounded(ops.categorical_profile(events), "top_percent", "entropy", "missing_percent")


def _top(column):
    return f"""SELECT '{column}' AS "column", row_number() OVER (ORDER BY count(*) DESC, CAST({column} AS VARCHAR)) AS rank,
        CAST({column} AS VARCHAR) AS value, count(*) AS count,
        round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 6) AS percent
        FROM lineitem GROUP BY {column} QUALIFY rank <= 10"""


@query("profile_top_values", _top("l_returnflag") + " UNION ALL " + _top("l_suppkey"))
def profile_top_values(spark, folder):
    found = ops.categorical_top_values(table(spark, folder, "lineitem"), ["l_returnflag", "l_suppkey"])
    return rounded(found, "percent")


@query(
    "events_per_case",
    """SELECT count(*) AS n_cases, round(avg(n), 6) AS mean_events, quantile_cont(n, 0.5) AS median_events,
              min(n) AS min_events, max(n) AS max_events FROM (SELECT count(*) AS n FROM $L GROUP BY case_id)""",
)
def events_per_case(spark, folder):
    return rounded(ops.events_per_case(line_log(spark, folder)), "mean_events")


@query(
    "throughput_time",
    """SELECT round(avg(d), 3) AS mean_seconds, min(d) AS min_seconds, max(d) AS max_seconds,
              round(quantile_cont(d, 0.5), 7) AS median_seconds
       FROM (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS d FROM $E GROUP BY case_id)""",
)
def throughput_time(spark, folder):
    found = ops.throughput_time(click_log(spark, folder))
    return rounded(rounded(found, "mean_seconds", digits=3), "median_seconds", digits=7)


def _frequency(column, source):
    shares = f"(SELECT {column} AS value, count(*) AS count FROM {source} WHERE {column} IS NOT NULL GROUP BY 1)"
    share = f"round(100.0 * count / (SELECT count(*) FROM {source}), 6) AS percent"
    return f"""SELECT * FROM (SELECT 'top' AS section, value, count, {share} FROM {shares} ORDER BY count DESC, value LIMIT 10)
               UNION ALL SELECT 'rare' AS section, value, count, {share} FROM {shares} WHERE count = 1"""


_STEP = "(SELECT event_type || '-' || CAST(floor(value / 10) AS INTEGER) AS step FROM events)"


@query("activity_metrics", _frequency("step", _STEP))
def activity_metrics(spark, folder):
    """Events by type and value band, which gives common and one-off steps."""
    events = table(spark, folder, "events").select(
        F.expr("concat(event_type, '-', CAST(floor(value / 10) AS INT))").alias("step")
    )
    return rounded(ops.frequency_metrics(events, "step"), "percent")


@query("resource_metrics", _frequency("resource", "$E"))
def resource_metrics(spark, folder):
    return rounded(ops.frequency_metrics(click_log(spark, folder).events, "resource"), "percent")


@query("distinct_activities", "SELECT count(DISTINCT activity) AS distinct_values FROM $L")
def distinct_activities(spark, folder):
    return ops.distinct_values(line_log(spark, folder).events, "activity")


@query(
    "missing_cells",
    f"""SELECT c AS "column", m AS missing, t AS total_missing, round(100.0 * t / (n * 5), 6) AS total_percent FROM
        (SELECT count(*) AS n, count(*) - count(event_type) AS a, count(*) - count(value) AS b,
                2 * count(*) - count(event_type) - count(value) AS t FROM {_G}),
        LATERAL (SELECT 'event_type' AS c, a AS m UNION ALL SELECT 'value', b)""",
)
def missing_cells(spark, folder):
    return rounded(ops.missing_cells(_gappy(spark, folder)), "total_percent")


_KEYS = "l_orderkey, l_returnflag, l_linestatus"


@query(
    "duplicate_rows",
    f"""SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {_KEYS} FROM lineitem)) AS duplicates,
        round(100.0 * (count(*) - (SELECT count(*) FROM (SELECT DISTINCT {_KEYS} FROM lineitem))) / count(*), 6)
            AS duplicate_percent FROM lineitem""",
)
def duplicate_rows(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    return rounded(ops.duplicate_rows(lines), "duplicate_percent")


def _cardinality(column, source):
    return f"""SELECT '{column}' AS "column", count(DISTINCT {column}) AS distinct_values,
        count(DISTINCT {column}) <= 1 AS is_constant, count(DISTINCT {column}) > 0.8 * count(*) AS is_high_cardinality
        FROM {source}"""


@query(
    "column_cardinality",
    " UNION ALL ".join(_cardinality(c, "(SELECT *, 'x' AS fixed FROM " + _G + ")") for c in ("event_id", "event_type", "fixed")),
)
def column_cardinality(spark, folder):
    return ops.column_cardinality(_gappy(spark, folder).withColumn("fixed", F.lit("x")), ["event_id", "event_type", "fixed"])


@query(
    "skewness",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(skewness({c}), 6) AS skewness FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    ),
)
def skewness(spark, folder):
    lines = table(spark, folder, "lineitem")
    return rounded(ops.skewness(lines, ["l_quantity", "l_extendedprice", "l_discount"]), "skewness")


@query(
    "process_metrics",
    """SELECT count(*) AS total_cases, CAST(sum(n) AS BIGINT) AS total_events, round(avg(n), 6) AS avg_case_length,
        min(n) AS min_case_length, max(n) AS max_case_length, round(stddev_samp(n), 6) AS std_case_length,
        round(avg(d), 6) AS avg_duration_seconds, min(d) AS min_duration_seconds, max(d) AS max_duration_seconds,
        (SELECT count(DISTINCT activity) FROM $L) AS unique_activities,
        (SELECT count(*) FROM $L GROUP BY activity ORDER BY 1 DESC LIMIT 1) AS most_common_count,
        (SELECT activity FROM $L GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_common_activity
       FROM (SELECT count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS d FROM $L GROUP BY case_id)""",
)
def process_metrics(spark, folder):
    found = ops.process_metrics(line_log(spark, folder))
    return rounded(found, "avg_case_length", "std_case_length", "avg_duration_seconds")


def _share(sql):
    return f"""SELECT value, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM {sql}), 6) AS percent
               FROM {sql} GROUP BY value"""


@query(
    "outcome_distribution",
    _share("""(SELECT last(s ORDER BY $OORD) FILTER (WHERE s IS NOT NULL) AS value
               FROM (SELECT case_id, ts, o_orderkey, nullif(o_orderstatus, 'P') AS s FROM $O) GROUP BY case_id)"""),
)
def outcome_distribution(spark, folder):
    log = order_log(spark, folder)
    gappy = log.with_events(log.events.withColumn("status", F.expr("nullif(o_orderstatus, 'P')")))
    return rounded(ops.distribution(outcome_by_attribute(gappy, "status"), "outcome"), "percent")


_PREFIXES = """(SELECT case_id, row_number() OVER w AS len, lead(activity) OVER w AS nxt FROM $L
                WINDOW w AS (PARTITION BY case_id ORDER BY $LORD))"""


@query("next_label_distribution", _share(f"(SELECT nxt AS value FROM {_PREFIXES} WHERE nxt IS NOT NULL)"))
def next_label_distribution(spark, folder):
    samples = prefixes_next(line_log(spark, folder), keep=1)
    return rounded(ops.distribution(samples, "label_next_activity"), "percent")


@query(
    "samples_per_bucket",
    _share(f"""(SELECT CASE WHEN len > 10 THEN '10+' ELSE CAST(len AS VARCHAR) END AS value FROM {_PREFIXES}
               WHERE nxt IS NOT NULL)"""),
)
def samples_per_bucket(spark, folder):
    samples = with_bucket(prefixes_next(line_log(spark, folder), keep=1))
    return rounded(ops.distribution(samples, "bucket_id"), "percent")


@query(
    "prefix_length_range",
    f"""SELECT min(len) AS min_length, max(len) AS max_length, round(avg(len), 6) AS mean_length FROM {_PREFIXES}
        WHERE nxt IS NOT NULL""",
)
def prefix_length_range(spark, folder):
    return rounded(ops.length_range(prefixes_next(line_log(spark, folder), keep=1)), "mean_length")
