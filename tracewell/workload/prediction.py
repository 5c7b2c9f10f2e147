"""State-based predictions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions.columns import outcome_by_index, outcome_label, split_activities
from tracewell.operators.features import case_split
from tracewell.plans import prediction as plans
from tracewell.plans.training import bucket_scores
from tracewell.sources.sinks import export_predictions, scratch_folder
from tracewell.streaming.monitor import monitor
from tracewell.workload.registry import click_log, line_log, query, rounded, table
from tracewell.workload.sequences import _NEXT

_MARK = "chr(31)"
_SAMPLES = f"""(SELECT case_id, prefix_length, CASE WHEN prefix_length > 10 THEN '10+' ELSE CAST(prefix_length AS VARCHAR) END AS bucket_id,
    newest, label_next_activity AS nxt, label_outcome AS outcome, remaining_time FROM {_NEXT} WHERE label_next_activity IS NOT NULL)"""


def _levels(source):
    return f"""(SELECT level, bucket_id, state, nxt, outcome, remaining_time FROM (
        SELECT 0 AS level, bucket_id, array_to_string(newest, {_MARK}) AS state, nxt, outcome, remaining_time FROM {source}
        UNION ALL SELECT 1, bucket_id, array_to_string(newest[-3:], {_MARK}), nxt, outcome, remaining_time FROM {source}
        UNION ALL SELECT 2, bucket_id, newest[-1], nxt, outcome, remaining_time FROM {source}
        UNION ALL SELECT 3, '*', '', nxt, outcome, remaining_time FROM {source}))"""


def _trained(source):
    """CTEs: ``nx`` next activities, ``hr`` hours, ``oc`` outcomes, by level, bucket and state."""
    return f"""lv AS MATERIALIZED (SELECT * FROM {_levels(source)}),
    nc AS (SELECT level, bucket_id, state, nxt, count(*) AS n FROM lv GROUP BY ALL),
    nx AS MATERIALIZED (SELECT level, bucket_id, state, sum(n) AS support, list(nxt ORDER BY n DESC, nxt)[1:5] AS names,
        list(n ORDER BY n DESC, nxt)[1:5] AS counts FROM nc GROUP BY ALL),
    hr AS MATERIALIZED (SELECT level, bucket_id, state, avg(remaining_time) AS hours FROM lv GROUP BY ALL),
    oc AS MATERIALIZED (SELECT level, bucket_id, state, first(outcome ORDER BY n DESC, outcome) AS outcome,
        max(n) / sum(n) AS confidence FROM (SELECT level, bucket_id, state, outcome, count(*) AS n FROM lv GROUP BY ALL) GROUP BY ALL)"""


def _resolved(cases):
    """Cases given as case_id, newest, prefix_length, with their most specific known state."""
    return f"""(SELECT case_id, prefix_length, newest, b AS bucket_id, level, names, counts, support, hours, outcome, confidence FROM
        (SELECT *, CASE WHEN prefix_length > 10 THEN '10+' ELSE CAST(prefix_length AS VARCHAR) END AS b FROM {cases}) c
        JOIN nx ON (nx.level = 0 AND nx.bucket_id = b AND nx.state = array_to_string(newest, {_MARK}))
             OR (nx.level = 1 AND nx.bucket_id = b AND nx.state = array_to_string(newest[-3:], {_MARK}))
             OR (nx.level = 2 AND nx.bucket_id = b AND nx.state = newest[-1]) OR nx.level = 3
        JOIN hr USING (level, bucket_id, state) JOIN oc USING (level, bucket_id, state)
        QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY level) = 1)"""


@query(
    "next_activity_states",
    f"""WITH lv AS (SELECT * FROM {_levels(_SAMPLES)})
        SELECT level, bucket_id, array_to_string(string_split(state, {_MARK}), '>') AS state, nxt AS label_next_activity, count(*) AS n,
               round(count(*) / sum(count(*)) OVER (PARTITION BY level, bucket_id, state), 6) AS probability
        FROM lv GROUP BY level, bucket_id, state, nxt""",
)
def next_activity_states(spark, folder):
    found = plans.next_activity_distribution(plans.training_samples(line_log(spark, folder)))
    return rounded(found.withColumn("state", F.replace("state", F.lit(plans.SEPARATOR), F.lit(">"))), "probability")


@query(
    "remaining_time_states",
    f"""WITH lv AS (SELECT * FROM {_levels(_SAMPLES)})
        SELECT level, bucket_id, array_to_string(string_split(state, {_MARK}), '>') AS state, round(avg(remaining_time), 4) AS hours
        FROM lv GROUP BY level, bucket_id, state""",
)
def remaining_time_states(spark, folder):
    model = plans.train(plans.training_samples(line_log(spark, folder)))
    state = F.replace("state", F.lit(plans.SEPARATOR), F.lit(">")).alias("state")
    return rounded(model.states.select("level", "bucket_id", state, "hours"), "hours", digits=4)


_LINE_TAILS = """(SELECT case_id, list(activity ORDER BY p) FILTER (WHERE p > n - 10) AS newest, any_value(n) AS prefix_length
    FROM (SELECT case_id, activity, row_number() OVER (PARTITION BY case_id ORDER BY $LORD) AS p,
          count(*) OVER (PARTITION BY case_id) AS n FROM $L) GROUP BY 1)"""
_SCORES = f"""SELECT case_id, array_to_string(newest, '>') AS current_prefix, prefix_length, bucket_id, level AS back_off_level,
    names[1] AS next_activity, array_to_string(names, '>') AS top_names,
    array_to_string([CAST(CAST(round(1000000 * c / support) AS BIGINT) AS VARCHAR) for c in counts], '>') AS top_ppm,
    round(hours, 4) AS hours, outcome, round(confidence, 6) AS confidence FROM """


def _flat(scored):
    ppm = F.transform("next_activity.top_k", lambda t: F.round(1000000 * t["prob"]).cast("bigint").cast("string"))
    return scored.select(
        "case_id",
        F.array_join("current_prefix", ">").alias("current_prefix"),
        "prefix_length",
        F.col("remaining_time.bucket_id").alias("bucket_id"),
        "back_off_level",
        F.col("next_activity.activity").alias("next_activity"),
        F.array_join(F.transform("next_activity.top_k", lambda t: t["activity"]), ">").alias("top_names"),
        F.array_join(ppm, ">").alias("top_ppm"),
        F.round("remaining_time.hours", 4).alias("hours"),
        F.col("outcome.prediction").alias("outcome"),
        F.round("outcome.confidence", 6).alias("confidence"),
    )


_ALL_SCORES = f"WITH {_trained(_SAMPLES)} {_SCORES} {_resolved(_LINE_TAILS)}"


@query("score_cases", _ALL_SCORES)
def score_cases(spark, folder):
    log = line_log(spark, folder)
    return _flat(plans.score_cases(log, plans.train(plans.training_samples(log))))


@query("saved_model_scores", _ALL_SCORES)
def saved_model_scores(spark, folder):
    """The same scores from state tables written to the shared folder and read back."""
    log = line_log(spark, folder)
    target = scratch_folder(spark, "states")
    plans.train(plans.training_samples(log)).save(target)
    return _flat(plans.score_cases(log, plans.TransitionModel.load(spark, target)))


@query(
    "exported_predictions",
    f"""WITH {_trained(_SAMPLES)} SELECT bucket_id, count(*) AS cases, CAST(sum(prefix_length) AS BIGINT) AS events
        FROM {_resolved(_LINE_TAILS)} GROUP BY 1""",
)
def exported_predictions(spark, folder):
    log = line_log(spark, folder)
    target = scratch_folder(spark, "predictions")
    export_predictions(plans.score_cases(log, plans.train(plans.training_samples(log))), target)
    back = spark.read.option("header", True).schema(
        "case_id bigint, current_prefix string, prefix_length bigint, next_activity_activity string, next_activity_top_k string, "
        "remaining_time_hours double, remaining_time_bucket_id string, outcome_prediction string, outcome_confidence double, "
        "back_off_level int"
    ).csv(target)
    return back.groupBy(F.col("remaining_time_bucket_id").alias("bucket_id")).agg(
        F.count(F.lit(1)).alias("cases"), F.sum("prefix_length").alias("events")
    )


_TEST = "substr(md5(CAST(case_id AS VARCHAR)), 1, 2) < '33'"
_TRAIN_SAMPLES = f"(SELECT * FROM {_SAMPLES} WHERE NOT {_TEST})"
_TEST_ROWS = f"(SELECT case_id || ':' || prefix_length AS case_id, newest, prefix_length, nxt, remaining_time FROM {_SAMPLES} WHERE {_TEST})"


@query(
    "bucket_scores",
    f"""WITH {_trained(_TRAIN_SAMPLES)}
        SELECT bucket_id, count(*) AS rows, round(avg(CASE WHEN names[1] = nxt THEN 1.0 ELSE 0.0 END), 6) AS top1_accuracy,
        round(avg(CASE WHEN list_contains(names[1:3], nxt) THEN 1.0 ELSE 0.0 END), 6) AS top3_accuracy,
        round(avg(CASE WHEN list_contains(names, nxt) THEN 1.0 ELSE 0.0 END), 6) AS top5_accuracy,
        round(avg(power(remaining_time - hours, 2)), 1) AS mse, round(avg(abs(remaining_time - hours)), 4) AS mae,
        round(sqrt(avg(power(remaining_time - hours, 2))), 4) AS rmse
        FROM {_resolved(_TEST_ROWS)} JOIN (SELECT case_id, nxt, remaining_time FROM {_TEST_ROWS}) USING (case_id) GROUP BY 1""",
)
def held_out_bucket_scores(spark, folder):
    samples = case_split(plans.training_samples(line_log(spark, folder)))
    model = plans.train(samples.where("NOT is_test"))
    found = bucket_scores(plans.evaluation_rows(samples.where("is_test"), model)).drop("mape")
    accurate = rounded(found, "top1_accuracy", "top3_accuracy", "top5_accuracy")
    return rounded(rounded(accurate, "mae", "rmse", digits=4), "mse", digits=1)


_REQUESTS = """(SELECT user_id AS case_id, string_agg(event_type, ' , ' ORDER BY ts, event_id) AS activities
               FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p <= 4 GROUP BY 1)"""


@query(
    "request_activities",
    """SELECT event_id, array_to_string([trim(x) for x in string_split(event_type || ' , new,' || user_id, ',') if trim(x) <> ''], '>')
              AS activities FROM events""",
)
def request_activities(spark, folder):
    text = F.concat("event_type", F.lit(" , new,"), F.col("user_id").cast("string"))
    return table(spark, folder, "events").select(
        "event_id", F.array_join(split_activities(text), ">").alias("activities")
    )


_CLICK_NEXT = """(SELECT case_id, row_number() OVER w AS prefix_length, lead(activity) OVER w AS label_next_activity,
    last(activity) OVER whole AS label_outcome, (epoch_us(last(ts) OVER whole) - epoch_us(ts)) / 3600e6 AS remaining_time,
    list(activity) OVER (PARTITION BY case_id ORDER BY $EORD ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS newest
    FROM $E WINDOW w AS (PARTITION BY case_id ORDER BY $EORD),
      whole AS (PARTITION BY case_id ORDER BY $EORD ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
_CLICK_SAMPLES = _SAMPLES.replace(_NEXT, _CLICK_NEXT)


@query(
    "score_requests",
    f"""WITH {_trained(_CLICK_SAMPLES)} {_SCORES}
        {_resolved('''(SELECT event_id AS case_id, [event_type, 'SUPER_NEW', 'view'] AS newest, 3 AS prefix_length FROM events)''')}""",
)
def score_requests(spark, folder):
    """Ad-hoc prefixes with an activity never seen: the back-off answers."""
    log = click_log(spark, folder)
    model = plans.train(plans.training_samples(log))
    text = F.concat("event_type", F.lit(", SUPER_NEW, view"))
    requests = table(spark, folder, "events").select(
        F.col("event_id").alias("case_id"), split_activities(text).alias("activities")
    )
    return _flat(plans.score_requests(requests, model))


@query(
    "outcome_display",
    """SELECT event_id, CASE WHEN upper(event_type) = 'ERROR' THEN 'Standard Processing' ELSE event_type END AS shown,
              coalesce(['A', 'B', 'C', 'E', 'H', 'O', 'UNKNOWN', 'W'][CAST(event_id % 9 AS INTEGER) + 1], '?') AS by_index FROM events""",
)
def outcome_display(spark, folder):
    renamed = F.when(F.col("event_type") == "error", "Unknown").otherwise(F.col("event_type"))
    return table(spark, folder, "events").select(
        "event_id",
        outcome_label(renamed).alias("shown"),
        F.coalesce(outcome_by_index(F.col("event_id") % 9), F.lit("?")).alias("by_index"),
    )


_CLICK_TAILS = _LINE_TAILS.replace("$LORD", "$EORD").replace("$L", "$E")


@query("running_case_monitor", f"WITH {_trained(_CLICK_SAMPLES)} {_SCORES} {_resolved(_CLICK_TAILS)}")
def running_case_monitor(spark, folder):
    """The event table as a stream of five files out of order, one for each trigger: the newest prediction of every
    case equals its batch score."""
    log = click_log(spark, folder)
    model = plans.train(plans.training_samples(log))
    target = scratch_folder(spark, "monitor")
    source = table(spark, folder, "events").selectExpr("user_id AS case_id", "event_type AS activity", "ts", "event_id")
    source.repartition(5, F.col("event_id") % 5).write.parquet(f"{target}/events")
    events = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{target}/events")

    def write(rows, batch_id):
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(f"{target}/rows")

    running = monitor(events, model, write, f"{target}/checkpoint", available_now=True, watermark="3650 days")
    running.awaitTermination()
    emitted = spark.read.parquet(f"{target}/rows")
    newest = emitted.groupBy("case_id").agg(F.max("batch_id").alias("batch_id"))
    latest = emitted.join(newest, ["case_id", "batch_id"], "left_semi")
    return _flat(latest.withColumn("case_id", F.col("case_id").cast("bigint")))
