"""Row cleaning over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions.columns import epoch_micros
from tracewell.operators import cleaning as ops
from tracewell.operators.outliers import handle_outliers
from tracewell.plans.cleaning import smart_clean
from tracewell.workload.registry import click_log, order_log, query, rounded, table

_GAPPY = "nullif(event_type, 'error')"
_VALUE = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END"


def _gappy(spark, folder):
    """Events with derived gaps in the type and in the value."""
    return table(spark, folder, "events").select(
        "event_id", "user_id", F.expr(_GAPPY).alias("event_type"), F.expr(_VALUE).alias("value"), "ts"
    )


_G = f"(SELECT event_id, user_id, {_GAPPY} AS event_type, {_VALUE} AS value, ts FROM events)"


@query("remove_by_condition", f"SELECT event_id, value FROM {_G} WHERE NOT coalesce(value > 100 AND event_type = 'view', false)")
def remove_by_condition(spark, folder):
    return ops.remove_by_condition(_gappy(spark, folder), "value > 100 AND event_type = 'view'").select("event_id", "value")


@query("remove_listed", f"SELECT event_id, event_type FROM {_G} WHERE NOT coalesce(event_type IN ('view', 'click'), false)")
def remove_listed(spark, folder):
    return ops.remove_by_membership(_gappy(spark, folder), "event_type", ["view", "click"]).select("event_id", "event_type")


@query("keep_listed", f"SELECT event_id, event_type FROM {_G} WHERE event_type IN ('view', 'click')")
def keep_listed(spark, folder):
    kept = ops.remove_by_membership(_gappy(spark, folder), "event_type", ["view", "click"], mode="not_in")
    return kept.select("event_id", "event_type")


@query(
    "replace_values",
    f"SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'browse' ELSE event_type END AS event_type FROM {_G}",
)
def replace_values(spark, folder):
    return ops.replace_values(
        _gappy(spark, folder).select("event_id", "event_type"), ["event_type"], ["view", "click"], "browse"
    )


@query(
    "replace_where",
    f"""SELECT event_id, CASE WHEN coalesce(value > 100, false) AND event_type IS DISTINCT FROM 'view' AND coalesce(user_id % 2 = 0, false) THEN 'big'
                              ELSE event_type END AS event_type FROM {_G}""",
)
def replace_where(spark, folder):
    """Triples and a predicate in one list."""
    conditions = [("value", ">", 100), ("event_type", "!=", "view"), "user_id % 2 = 0"]
    return ops.replace_where(_gappy(spark, folder), ["event_type"], conditions, "big").select("event_id", "event_type")


@query("delete_nulls", f"SELECT event_id, value FROM {_G} WHERE value IS NOT NULL")
def delete_nulls(spark, folder):
    return ops.handle_nulls(_gappy(spark, folder), "value").select("event_id", "value")


@query("fill_nulls_default", f"SELECT event_id, coalesce(event_type, 'none') AS event_type FROM {_G}")
def fill_nulls_default(spark, folder):
    return ops.handle_nulls(_gappy(spark, folder), "event_type", "default", "none").select("event_id", "event_type")


@query(
    "fill_nulls_mean",
    f"SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM {_G})), 6) AS value FROM {_G}",
)
def fill_nulls_mean(spark, folder):
    return rounded(ops.handle_nulls(_gappy(spark, folder), "value", "medium").select("event_id", "value"), "value")


@query("fill_nulls_max", f"SELECT event_id, coalesce(value, (SELECT max(value) FROM {_G})) AS value FROM {_G}")
def fill_nulls_max(spark, folder):
    return ops.handle_nulls(_gappy(spark, folder), "value", "max").select("event_id", "value")


@query(
    "range_delete",
    f"""SELECT event_id, value FROM {_G} WHERE NOT coalesce(value < 10, false) AND NOT coalesce(value > 200, false)""",
)
def range_delete(spark, folder):
    return ops.filter_range(_gappy(spark, folder), "value", range_min=10, range_max=200).select("event_id", "value")


@query(
    "range_fill_mean",
    f"""SELECT event_id, round(CASE WHEN value < 10 OR value > 200 THEN (SELECT avg(value) FROM {_G}) ELSE value END, 6)
        AS value FROM {_G}""",
)
def range_fill_mean(spark, folder):
    treated = ops.filter_range(_gappy(spark, folder), "value", range_min=10, range_max=200, on_outside="medium")
    return rounded(treated.select("event_id", "value"), "value")


@query(
    "allowed_set_show",
    f"SELECT event_id, event_type FROM {_G} WHERE event_type IS NULL OR event_type NOT IN ('view', 'click', 'signup')",
)
def allowed_set_show(spark, folder):
    shown = ops.filter_range(_gappy(spark, folder), "event_type", ["view", "click", "signup"], on_outside="show")
    return shown.select("event_id", "event_type")


@query(
    "range_on_text_time",
    """SELECT event_id, epoch_us(date_trunc('second', ts)) AS at_micros FROM events WHERE date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""",
)
def range_on_text_time(spark, folder):
    """A text column that parses as time is filtered as time and becomes one."""
    texts = table(spark, folder, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))
    found = ops.filter_range(texts, "at", range_min="2024-01-05", range_max="2024-01-20")
    return found.select("event_id", epoch_micros(F.col("at")).alias("at_micros"))


_BOUNDS = f"(SELECT avg(value) AS m FROM {_G})"


@query(
    "outliers_delete",
    f"""SELECT event_id, value FROM {_G}, {_BOUNDS}
        WHERE NOT coalesce(value < m - 0.5 * abs(m) OR value > m + 0.5 * abs(m), false)""",
)
def outliers_delete(spark, folder):
    return handle_outliers(_gappy(spark, folder), "value", 50).select("event_id", "value")


@query(
    "outliers_fill_median",
    f"""SELECT event_id, round(CASE WHEN value < m - 0.5 * abs(m) OR value > m + 0.5 * abs(m)
                               THEN (SELECT quantile_cont(value, 0.5) FROM {_G}) ELSE value END, 6) AS value
        FROM {_G}, {_BOUNDS}""",
)
def outliers_fill_median(spark, folder):
    treated = handle_outliers(_gappy(spark, folder), "value", 50, on_outside="medium")
    return rounded(treated.select("event_id", "value"), "value")


@query(
    "outliers_in_time",
    """SELECT o_orderkey FROM orders, (SELECT avg(CAST(epoch_us(o_orderdate) AS DOUBLE)) AS m,
              max(epoch_us(o_orderdate)) - min(epoch_us(o_orderdate)) AS w FROM orders)
       WHERE NOT (epoch_us(o_orderdate) < m - 0.3 * w OR epoch_us(o_orderdate) > m + 0.3 * w)""",
)
def outliers_in_time(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return handle_outliers(orders, "o_orderdate", 30).select("o_orderkey")


@query(
    "outliers_per_group",
    f"""SELECT event_id, value FROM {_G} g LEFT JOIN
        (SELECT event_type AS t, avg(value) AS m FROM {_G} WHERE event_type IS NOT NULL GROUP BY 1) ON event_type = t
        WHERE coalesce(value < m - 0.8 * abs(m) OR value > m + 0.8 * abs(m), false)""",
)
def outliers_per_group(spark, folder):
    shown = handle_outliers(_gappy(spark, folder), "value", 80, groupby="event_type", on_outside="show")
    return shown.select("event_id", "value")


_PAIR = "user_id, event_type"


@query(
    "duplicates_keep_first",
    f"""SELECT event_id, user_id, event_type FROM {_G}
        QUALIFY row_number() OVER (PARTITION BY {_PAIR} ORDER BY event_id) = 1""",
)
def duplicates_keep_first(spark, folder):
    kept = ops.remove_duplicates(_gappy(spark, folder), ["user_id", "event_type"], "first", ["event_id"])
    return kept.select("event_id", "user_id", "event_type")


@query(
    "duplicates_keep_last",
    f"""SELECT event_id, user_id, event_type FROM {_G}
        QUALIFY row_number() OVER (PARTITION BY {_PAIR} ORDER BY event_id DESC) = 1""",
)
def duplicates_keep_last(spark, folder):
    kept = ops.remove_duplicates(_gappy(spark, folder), ["user_id", "event_type"], "last", ["event_id"])
    return kept.select("event_id", "user_id", "event_type")


@query(
    "duplicates_keep_none",
    """SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
       QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderpriority) = 1""",
)
def duplicates_keep_none(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return ops.remove_duplicates(orders, ["o_custkey", "o_orderpriority"], keep=False)


@query("duplicate_rows_removed", "SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem")
def duplicate_rows_removed(spark, folder):
    return ops.remove_duplicates(table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus"))


@query(
    "duplicates_in_groups",
    f"""SELECT event_id, user_id, event_type FROM {_G} WHERE event_type IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY event_type, user_id, date_trunc('day', ts) ORDER BY event_id) = 1""",
)
def duplicates_in_groups(spark, folder):
    days = _gappy(spark, folder).withColumn("day", F.date_trunc("day", "ts"))
    kept = ops.remove_duplicates(days, ["user_id", "day"], "first", ["event_id"], groupby="event_type")
    return kept.select("event_id", "user_id", "event_type")


_FIRST = """(SELECT o_custkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id FROM
             (SELECT o_custkey, o_orderdate, o_orderkey FROM orders
              QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1))"""


@query("anonymise_numeric", f"SELECT o_orderkey, id AS o_custkey FROM orders JOIN {_FIRST} USING (o_custkey)")
def anonymise_numeric(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return ops.anonymise(orders, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey")


_LETTERS = """CASE WHEN id <= 26 THEN chr(CAST(64 + id AS INTEGER))
    WHEN id <= 702 THEN chr(CAST(65 + (id - 27) // 26 AS INTEGER)) || chr(CAST(65 + (id - 27) % 26 AS INTEGER))
    WHEN id <= 18278 THEN chr(CAST(65 + (id - 703) // 676 AS INTEGER)) || chr(CAST(65 + (id - 703) // 26 % 26 AS INTEGER))
         || chr(CAST(65 + (id - 703) % 26 AS INTEGER)) END"""


@query("anonymise_letters", f"SELECT o_orderkey, {_LETTERS} AS o_custkey FROM orders JOIN {_FIRST} USING (o_custkey)")
def anonymise_letters(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return ops.anonymise(orders, "o_custkey", ["o_orderdate", "o_orderkey"], "alphabetic").select("o_orderkey", "o_custkey")


_MISSPELT = """CASE p_partkey % 5 WHEN 0 THEN replace(p_type, 'A', 'AA') WHEN 1 THEN substr(p_type, 2)
               WHEN 2 THEN ' ' || lower(p_type) ELSE p_type END"""
_VALID = "(SELECT DISTINCT p_type AS v FROM part)"
_SCORE = """CASE WHEN greatest(length(a), length(b)) = 0 THEN 100.0
            ELSE 100.0 * (1 - levenshtein(a, b) / greatest(length(a), length(b))) END"""
_SUGGEST = f"""(SELECT original_value, v AS suggested_value, round(score, 6) AS similarity_score FROM
    (SELECT original_value, v, {_SCORE} AS score FROM
        (SELECT original_value, v, upper(trim(original_value)) AS a, upper(trim(v)) AS b FROM
            (SELECT DISTINCT {_MISSPELT} AS original_value FROM part), {_VALID}))
    QUALIFY row_number() OVER (PARTITION BY original_value ORDER BY score DESC, v) = 1)"""


def _misspelt(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.expr(_MISSPELT).alias("p_type"))


def _valid(spark, folder):
    return table(spark, folder, "part").select("p_type")


@query(
    "suggest_corrections",
    f"SELECT * FROM {_SUGGEST} WHERE similarity_score >= 70 AND original_value <> suggested_value",
)
def suggest_corrections(spark, folder):
    found = ops.suggest_corrections(_misspelt(spark, folder), "p_type", _valid(spark, folder), 70)
    return rounded(found, "similarity_score")


@query(
    "apply_corrections",
    f"""SELECT p_partkey, coalesce(new, old) AS p_type FROM
        (SELECT p_partkey, upper(trim({_MISSPELT})) AS old FROM part) LEFT JOIN
        (SELECT upper(trim(original_value)) AS key, min(upper(trim(suggested_value))) AS new FROM {_SUGGEST}
         WHERE similarity_score >= 70 AND original_value <> suggested_value GROUP BY 1) ON old = key""",
)
def apply_corrections(spark, folder):
    parts = _misspelt(spark, folder)
    found = ops.suggest_corrections(parts, "p_type", _valid(spark, folder), 70)
    return ops.apply_corrections(parts, "p_type", found)


@query(
    "log_clean",
    """SELECT DISTINCT case_id, activity, epoch_us(ts) AS ts_micros, coalesce(nullif(o_orderstatus, 'P'), 'UNKNOWN') AS status
       FROM $O""",
)
def log_clean(spark, folder):
    log = order_log(spark, folder)
    slim = log.events.select("case_id", "activity", "ts", F.expr("nullif(o_orderstatus, 'P')").alias("status"))
    cleaned = ops.clean_log(log.with_events(slim)).events
    return cleaned.select("case_id", "activity", epoch_micros(F.col("ts")).alias("ts_micros"), "status")


@query(
    "smart_clean",
    """SELECT dense_rank() OVER (ORDER BY case_id) AS case_id, activity, epoch_us(ts) AS ts_micros FROM
       (SELECT * FROM $E, (SELECT avg(CAST(epoch_us(ts) AS DOUBLE)) AS m, max(epoch_us(ts)) - min(epoch_us(ts)) AS w FROM events
                           WHERE event_type <> 'error')
        WHERE activity <> 'error' AND NOT (epoch_us(ts) < m - 0.4 * w OR epoch_us(ts) > m + 0.4 * w))""",
)
def clean_clicks(spark, folder):
    log = click_log(spark, folder)
    rows = log.events.select(
        "case_id", F.expr("nullif(activity, 'error')").alias("activity"), "ts", "event_id",
        F.lit("x").alias("Constant Column"), F.lit(None).cast("string").alias("empty"),
    )
    cleaned = smart_clean(log.with_events(rows), aggressive=True, outlier_percent=40.0).events
    return cleaned.select("case_id", "activity", epoch_micros(F.col("ts")).alias("ts_micros"))


@query("sort_by_columns", "SELECT event_id, event_type, value FROM " + _G + " ORDER BY event_type NULLS LAST, value DESC NULLS LAST")
def sort_by_columns(spark, folder):
    ordered = ops.sort_by(_gappy(spark, folder), ["event_type", "value"], [True, False])
    return ordered.select("event_id", "event_type", "value")
