"""Traces, prefixes and sequences over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions.columns import epoch_micros, left_pad, time_units
from tracewell.operators import features, prefixes, traces, vocabulary
from tracewell.workload.registry import click_log, line_log, order_log, query, rounded, table, talk_log


def _joined(df, *columns, separator=">"):
    return df.withColumns({c: F.array_join(c, separator) for c in columns})


@query(
    "traces",
    """SELECT case_id, (p - 1) // 10000 AS segment, count(*) AS events, string_agg(activity, '>' ORDER BY p) AS activities,
              string_agg(CAST(epoch_us(ts) AS VARCHAR), '>' ORDER BY p) AS times
       FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY $LORD) AS p FROM $L) GROUP BY 1, 2""",
)
def line_traces(spark, folder):
    found = traces.traces(line_log(spark, folder))
    times = F.array_join(F.transform("timestamps", lambda t: epoch_micros(t).cast("string")), ">")
    return _joined(found.withColumn("times", times).drop("timestamps"), "activities")


@query(
    "conversation_traces",
    """SELECT case_id, (p - 1) // 10000 AS segment, count(*) AS events, string_agg(activity, '>' ORDER BY p) AS activities
       FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY turn) AS p FROM $C) GROUP BY 1, 2""",
)
def conversation_traces(spark, folder):
    return _joined(traces.traces(talk_log(spark, folder)), "activities")


@query(
    "outcome_by_attribute",
    """SELECT case_id, last(s ORDER BY $OORD) FILTER (WHERE s IS NOT NULL) AS outcome
       FROM (SELECT case_id, ts, o_orderkey, nullif(o_orderstatus, 'P') AS s FROM $O) GROUP BY 1""",
)
def outcome_by_attribute(spark, folder):
    log = order_log(spark, folder)
    gappy = log.with_events(log.events.withColumn("status", F.expr("nullif(o_orderstatus, 'P')")))
    return traces.outcome_by_attribute(gappy, "status")


@query("outcome_by_last_activity", "SELECT case_id, last(activity ORDER BY $LORD) AS outcome FROM $L GROUP BY 1")
def outcome_by_last_activity(spark, folder):
    return traces.outcome_by_last_activity(line_log(spark, folder))


@query(
    "case_lookup",
    """SELECT case_id, (p - 1) // 10000 AS segment, count(*) AS events, string_agg(activity, '>' ORDER BY p) AS activities,
              any_value(c_mktsegment) AS c_mktsegment
       FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY $OORD) AS p FROM $O
             WHERE case_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) GROUP BY 1, 2""",
)
def case_lookup(spark, folder):
    """The batch form: traces of every customer with a pending order."""
    log = order_log(spark, folder)
    wanted = log.events.where("o_orderstatus = 'P'").select("case_id")
    found = traces.case_lookup(log, wanted, first_event=["c_mktsegment"])
    return _joined(found.drop("timestamps"), "activities")


_GAPS = """(SELECT *, row_number() OVER w AS p, count(*) OVER (PARTITION BY case_id) AS n,
            epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM $L WINDOW w AS (PARTITION BY case_id ORDER BY $LORD))"""


@query(
    "case_analysis",
    f"""SELECT case_id, (p - 1) // 10000 AS segment, any_value(n) AS event_count, string_agg(activity, ' -> ' ORDER BY p) AS path,
        round(any_value(d) / 1e6, 6) AS duration_seconds, round(any_value(d) / 1e6 / 3600, 6) AS duration_hours,
        coalesce(round(any_value(d) / 1e6 / nullif(any_value(n) - 1, 0), 6), -1) AS mean_gap_seconds,
        coalesce(round(any_value(low) / 1e6, 6), -1) AS min_gap_seconds, coalesce(round(any_value(high) / 1e6, 6), -1) AS max_gap_seconds
        FROM (SELECT *, min(gap) OVER whole AS low, max(gap) OVER whole AS high,
                     epoch_us(max(ts) OVER whole) - epoch_us(min(ts) OVER whole) AS d
              FROM {_GAPS} WINDOW whole AS (PARTITION BY case_id)) GROUP BY 1, 2""",
)
def case_analysis(spark, folder):
    found = traces.case_analysis(line_log(spark, folder))
    gaps = ["mean_gap_seconds", "min_gap_seconds", "max_gap_seconds"]
    return rounded(found, "duration_seconds", "duration_hours", *gaps).fillna(-1.0, gaps)


@query(
    "event_neighbours",
    """SELECT event_id, row_number() OVER w AS position, coalesce(lead(activity) OVER w, '-') AS next_activity,
              coalesce(lead(activity, 2) OVER w, '-') AS second_next_activity,
              coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w), -1) AS since_micros
       FROM $E WINDOW w AS (PARTITION BY case_id ORDER BY $EORD)""",
)
def event_neighbours(spark, folder):
    found = traces.with_neighbours(click_log(spark, folder))
    since = epoch_micros(F.col("ts")) - epoch_micros(F.col("previous_ts"))
    return found.select(
        "event_id",
        "position",
        F.coalesce("next_activity", F.lit("-")).alias("next_activity"),
        F.coalesce("second_next_activity", F.lit("-")).alias("second_next_activity"),
        F.coalesce(since, F.lit(-1)).alias("since_micros"),
    )


_FIRST_TEN = "QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY $OORD) <= 10"
_INCLUSIVE = f"""(SELECT case_id, row_number() OVER w AS prefix_length, string_agg(activity, '>') OVER f AS activities,
    epoch_us(first(ts) OVER f) AS start_micros, epoch_us(ts) AS current_micros,
    (epoch_us(ts) - epoch_us(first(ts) OVER f)) / 1e6 AS elapsed_seconds, first(c_mktsegment) OVER f AS c_mktsegment,
    o_orderstatus AS o_orderstatus_last, avg(price) OVER f AS price_mean
    FROM (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS price FROM $O
          {_FIRST_TEN})
    WINDOW w AS (PARTITION BY case_id ORDER BY $OORD),
           f AS (PARTITION BY case_id ORDER BY $OORD ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def order_prefixes(spark, folder, max_length=10):
    log = order_log(spark, folder)
    priced = log.with_events(log.events.withColumn("price", F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END")))
    found = prefixes.prefixes_inclusive(
        priced, 1, max_length, case_attributes=["c_mktsegment"], text_attributes=["o_orderstatus"],
        numeric_attributes=["price"],
    )
    return found.drop("offset") if max_length is not None else prefixes.whole_prefixes(found, priced, "activities")


@query(
    "prefixes_inclusive",
    f"""SELECT case_id, prefix_length, activities, start_micros, current_micros, elapsed_seconds, c_mktsegment,
        o_orderstatus_last, coalesce(round(price_mean, 6), -1) AS price_mean FROM {_INCLUSIVE.replace(_FIRST_TEN, '')}""",
)
def prefixes_inclusive(spark, folder):
    """All prefixes, each whole."""
    found = order_prefixes(spark, folder, None)
    stamped = found.select(
        "*", epoch_micros(F.col("start_time")).alias("start_micros"), epoch_micros(F.col("current_time")).alias("current_micros")
    ).drop("start_time", "current_time")
    return _joined(rounded(stamped, "price_mean").fillna(-1.0, ["price_mean"]), "activities")


_NEXT = """(SELECT case_id, row_number() OVER w AS prefix_length, activity, lead(activity) OVER w AS label_next_activity,
    last(activity) OVER whole AS label_outcome, (epoch_us(last(ts) OVER whole) - epoch_us(ts)) / 3600e6 AS remaining_time,
    epoch_us(ts) AS at_micros, list(activity) OVER w AS whole_prefix,
    list(activity) OVER (PARTITION BY case_id ORDER BY $LORD ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS newest, list(activity) FILTER (WHERE p <= 10) OVER w AS first_ten
    FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY $LORD) AS p FROM $L) WINDOW w AS (PARTITION BY case_id ORDER BY $LORD),
      whole AS (PARTITION BY case_id ORDER BY $LORD ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query(
    "prefixes_next",
    f"""SELECT case_id, array_to_string(whole_prefix, '>') AS prefix_activities, prefix_length, label_next_activity, label_outcome,
        round(remaining_time, 6) AS remaining_time, at_micros FROM {_NEXT} WHERE label_next_activity IS NOT NULL""",
)
def prefixes_next(spark, folder):
    """All prefixes with a next event, each whole."""
    log = line_log(spark, folder)
    found = prefixes.whole_prefixes(prefixes.prefixes_next(log), log, "prefix_activities")
    stamped = found.withColumn("at_micros", epoch_micros(F.col("timestamp"))).drop("timestamp")
    return _joined(rounded(stamped, "remaining_time"), "prefix_activities")


_SEQUENCE = """(SELECT event_id, case_id, row_number() OVER w AS position,
    list(activity) OVER (PARTITION BY case_id ORDER BY $EORD ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS before,
    activity AS next_activity,
    (epoch_us(max(ts) OVER (PARTITION BY case_id)) - epoch_us(ts)) / 1e6 AS remaining_seconds
    FROM $E WINDOW w AS (PARTITION BY case_id ORDER BY $EORD))"""


@query(
    "next_activity_sequences",
    f"""SELECT case_id, position, repeat('START>', 50 - len(before)) || array_to_string(before, '>') AS sequence,
        next_activity, round(remaining_seconds, 6) AS remaining_seconds FROM {_SEQUENCE} WHERE position > 1""",
)
def next_activity_sequences(spark, folder):
    found = prefixes.next_activity_sequences(click_log(spark, folder), 50)
    return _joined(rounded(found, "remaining_seconds"), "sequence")


@query(
    "padded_sequences",
    """SELECT case_id, repeat('START>', greatest(0, 8 - count(*))) || string_agg(activity, '>' ORDER BY p) AS sequence
       FROM (SELECT case_id, activity, row_number() OVER (PARTITION BY case_id ORDER BY $LORD) AS p,
                    count(*) OVER (PARTITION BY case_id) AS n FROM $L) WHERE p > n - 8 GROUP BY case_id""",
)
def padded_sequences(spark, folder):
    tails = prefixes.case_tails(line_log(spark, folder), 8)
    return tails.select("case_id", F.array_join(left_pad(F.col("activities"), 8, F.lit("START")), ">").alias("sequence"))


@query(
    "prefix_buckets",
    f"""SELECT case_id, prefix_length, CASE WHEN prefix_length > 10 THEN '10+' ELSE CAST(prefix_length AS VARCHAR) END AS bucket_id
        FROM {_NEXT} WHERE label_next_activity IS NOT NULL""",
)
def prefix_buckets(spark, folder):
    samples = prefixes.prefixes_next(line_log(spark, folder), keep=1)
    return prefixes.with_bucket(samples).select("case_id", "prefix_length", "bucket_id")


_VOCABULARY = "(SELECT activity, row_number() OVER (ORDER BY activity) AS activity_id FROM (SELECT DISTINCT activity FROM {log}))"
_LINES = _VOCABULARY.replace("{log}", "$L")


@query(
    "bucket_sequences",
    f"""SELECT case_id, prefix_length, CASE WHEN prefix_length > 10 THEN '10+' ELSE CAST(prefix_length AS VARCHAR) END AS bucket_id,
        (SELECT string_agg(CAST(activity_id AS VARCHAR), '>' ORDER BY i) FROM
            (SELECT unnest(first_ten) AS a, generate_subscripts(first_ten, 1) AS i)
            JOIN {_LINES} ON a = activity) AS ids
        FROM {_NEXT} WHERE label_next_activity IS NOT NULL""",
)
def bucket_sequences(spark, folder):
    log = line_log(spark, folder)
    coded = vocabulary.encoded_log(log, vocabulary.activity_vocabulary(log))
    rows = prefixes.bucket_activities(coded, 10, "first", "activity_id")
    ids = F.transform("prefix_activities", lambda i: i.cast("string"))
    return rows.select("case_id", "prefix_length", "bucket_id", F.array_join(ids, ">").alias("ids"))


@query(
    "bucket_sequences_newest",
    f"""SELECT case_id, prefix_length, CASE WHEN prefix_length > 10 THEN '10+' ELSE CAST(prefix_length AS VARCHAR) END AS bucket_id,
        repeat('0>', 10 - len(newest)) ||
        (SELECT string_agg(CAST(activity_id AS VARCHAR), '>' ORDER BY i) FROM
            (SELECT unnest(newest) AS a, generate_subscripts(newest, 1) AS i) JOIN {_LINES} ON a = activity) AS ids
        FROM {_NEXT} WHERE label_next_activity IS NOT NULL""",
)
def bucket_sequences_newest(spark, folder):
    log = line_log(spark, folder)
    coded = vocabulary.encoded_log(log, vocabulary.activity_vocabulary(log))
    rows = prefixes.bucket_activities(coded, 10, "last", "activity_id")
    padded = left_pad(F.col("prefix_activities"), 10, F.lit(0).cast("bigint"))
    text = F.array_join(F.transform(padded, lambda i: i.cast("string")), ">")
    return rows.select("case_id", "prefix_length", "bucket_id", text.alias("ids"))


@query("activity_vocabulary", "SELECT * FROM " + _LINES)
def activity_vocabulary(spark, folder):
    return vocabulary.activity_vocabulary(line_log(spark, folder))


@query(
    "token_vocabulary",
    """SELECT activity, row_number() OVER (ORDER BY activity) - 1 AS activity_id FROM
       (SELECT activity FROM $L UNION SELECT 'START' UNION SELECT 'END')""",
)
def token_vocabulary(spark, folder):
    return vocabulary.token_vocabulary(line_log(spark, folder))


_KNOWN = _VOCABULARY.replace("{log}", "(SELECT activity FROM $E WHERE activity <> 'error')")


@query(
    "encoded_activities",
    f"SELECT event_id, coalesce(activity_id, 0) AS activity_id FROM $E LEFT JOIN {_KNOWN} USING (activity)",
)
def encoded_activities(spark, folder):
    log = click_log(spark, folder)
    known = vocabulary.activity_vocabulary(log.with_events(log.events.where("activity <> 'error'")))
    return vocabulary.encode_events(log.events, known).select("event_id", "activity_id")


@query(
    "decoded_activities",
    f"""SELECT event_id, CASE WHEN event_id % 8 = 0 THEN '<PAD>' ELSE coalesce(activity, '<UNK>') END AS activity
        FROM events LEFT JOIN {_KNOWN} ON event_id % 8 = activity_id""",
)
def decoded_activities(spark, folder):
    log = click_log(spark, folder)
    known = vocabulary.activity_vocabulary(log.with_events(log.events.where("activity <> 'error'")))
    ids = log.events.select("event_id", (F.col("event_id") % 8).alias("activity_id"))
    return vocabulary.decode_events(ids, known).select("event_id", "activity")


_CODED = """(SELECT coalesce(s, 'nan') AS v, row_number() OVER (ORDER BY coalesce(s, 'nan')) - 1 AS code
             FROM (SELECT DISTINCT nullif(event_type, 'view') AS s FROM events))"""


@query(
    "label_codes",
    f"SELECT event_id, code AS event_type FROM events JOIN {_CODED} ON coalesce(nullif(event_type, 'view'), 'nan') = v",
)
def label_codes(spark, folder):
    events = table(spark, folder, "events").select("event_id", F.expr("nullif(event_type, 'view')").alias("event_type"))
    return vocabulary.label_encode(events, ["event_type"])


_FITTED = "(SELECT event_type AS v, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'view'))"


@query(
    "serving_codes",
    f"""SELECT event_id, coalesce(code, 0) AS event_type, coalesce(try_cast(CASE WHEN event_id % 2 = 0 THEN '12.5' ELSE 'x' END AS DOUBLE), 0)
        AS number FROM events LEFT JOIN {_FITTED} ON event_type = v""",
)
def serving_codes(spark, folder):
    """Serving fallback: an unknown category is class 0, other text a number or 0."""
    events = table(spark, folder, "events").select("event_id", "event_type")
    fitted = {"event_type": vocabulary.category_codes(events.where("event_type <> 'view'"), "event_type")}
    coded = vocabulary.label_encode(events, ["event_type"], fitted, unseen="zero")
    text = F.when(F.col("event_id") % 2 == 0, "12.5").otherwise("x")
    return coded.withColumn("number", vocabulary.number_or_zero(text))


@query(
    "serving_sequences",
    f"""SELECT case_id, repeat('0>', 50 - least(any_value(n), 50)) ||
        string_agg(CAST(coalesce(activity_id, 0) AS VARCHAR), '>' ORDER BY p) AS ids
        FROM (SELECT case_id, activity, row_number() OVER (PARTITION BY case_id ORDER BY $EORD) AS p,
                     count(*) OVER (PARTITION BY case_id) AS n FROM $E) LEFT JOIN {_KNOWN} USING (activity)
        WHERE p > n - 50 GROUP BY case_id""",
)
def serving_sequences(spark, folder):
    log = click_log(spark, folder)
    known = vocabulary.activity_vocabulary(log.with_events(log.events.where("activity <> 'error'")))
    padded = left_pad(F.col("activities"), 50, F.lit(0).cast("bigint"))
    text = F.array_join(F.transform(padded, lambda i: i.cast("string")), ">")
    tails = prefixes.case_tails(vocabulary.encoded_log(log, known), 50, "activity_id")
    return tails.select("case_id", text.alias("ids"))


_LEFT = "(SELECT case_id, position, remaining_seconds FROM " + _SEQUENCE + " WHERE position > 1)"


@query(
    "scaled_remaining_time",
    f"""SELECT case_id, position, round((ln(1 + remaining_seconds) - m) / d, 6) AS z, round(remaining_seconds, 6) AS restored
        FROM {_LEFT}, (SELECT avg(ln(1 + remaining_seconds)) AS m, stddev_pop(ln(1 + remaining_seconds)) AS d FROM {_LEFT})""",
)
def scaled_remaining_time(spark, folder):
    rows = prefixes.next_activity_sequences(click_log(spark, folder), 1).select("case_id", "position", "remaining_seconds")
    figures = features.scaling_figures(rows, "remaining_seconds")
    scaled = features.scaled(rows, "remaining_seconds", figures, "z")
    restored = features.unscaled(scaled, "z", figures, "restored").drop("remaining_seconds")
    return rounded(restored, "z", "restored")


@query(
    "remaining_time_units",
    f"""SELECT case_id, position, remaining_seconds AS seconds, remaining_seconds / 60 AS minutes,
        remaining_seconds / 3600 AS hours, remaining_seconds / 86400 AS days FROM {_LEFT}""",
)
def remaining_time_units(spark, folder):
    rows = prefixes.next_activity_sequences(click_log(spark, folder), 1)
    units = time_units(F.col("remaining_seconds"))
    return rows.select("case_id", "position", *[value.alias(name) for name, value in units.items()])
