"""Features, splits, classifiers and evaluation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import evaluation, features
from tracewell.operators.prefixes import prefixes_next
from tracewell.operators.traces import outcome_by_attribute, outcome_by_last_activity
from tracewell.operators.vocabulary import activity_vocabulary, encoded_log, label_encode
from tracewell.plans.classifiers import choose_best, classify, ensemble_vote, feature_importance, fit
from tracewell.plans.engine import ENSEMBLE, engine_rows, load_engine, predict_outcomes, train_engine
from tracewell.plans.training import COMPACT_FEATURES, outcome_rows
from tracewell.session import cut_lineage
from tracewell.sources.sinks import scratch_folder
from tracewell.workload.registry import click_log, line_log, order_log, query, rounded, table, year_log
from tracewell.workload.sequences import _INCLUSIVE, _LINES, _NEXT, order_prefixes

_LISTED = _INCLUSIVE.replace("string_agg(activity, '>') OVER f AS activities", "list(activity) OVER f AS seq")
_COMMON = """(SELECT case_id, prefix_length, first(a ORDER BY n DESC, i) AS common FROM
    (SELECT case_id, prefix_length, a, count(*) AS n, min(i) AS i FROM
        (SELECT case_id, prefix_length, unnest(seq) AS a, generate_subscripts(seq, 1) AS i FROM p) GROUP BY 1, 2, 3)
    GROUP BY 1, 2)"""
_FEATURES = f"""WITH p AS MATERIALIZED (SELECT * FROM {_LISTED} WHERE prefix_length <= 10),
    f AS MATERIALIZED (SELECT case_id, prefix_length, elapsed_seconds,
    coalesce(seq[-1], 'NONE') AS activity_1, coalesce(seq[-2], 'NONE') AS activity_2, coalesce(seq[-3], 'NONE') AS activity_3,
    coalesce(seq[-4], 'NONE') AS activity_4, coalesce(seq[-5], 'NONE') AS activity_5,
    len(list_distinct(seq)) AS unique_activities, common AS most_common_activity, c_mktsegment, o_orderstatus_last,
    coalesce(round(price_mean, 6), -1) AS price_mean
    FROM p JOIN {_COMMON} USING (case_id, prefix_length))
"""
_CARRY = ["c_mktsegment", "o_orderstatus_last", "price_mean"]


def order_features(spark, folder):
    found = features.sequence_features(order_prefixes(spark, folder), carry=_CARRY)
    return rounded(found, "price_mean").fillna(-1.0, ["price_mean"])


@query("prefix_features", _FEATURES + "SELECT * FROM f")
def prefix_features(spark, folder):
    return order_features(spark, folder)


_TEXT = [*[f"activity_{i}" for i in range(1, 6)], "most_common_activity", "c_mktsegment", "o_orderstatus_last"]


@query(
    "outcome_training_set",
    _FEATURES
    + "SELECT case_id, prefix_length, elapsed_seconds, unique_activities, price_mean, outcome, "
    + ", ".join(f"dense_rank() OVER (ORDER BY {c}) - 1 AS {c}" for c in _TEXT)
    + """ FROM f JOIN (SELECT case_id, last(s ORDER BY $OORD) FILTER (WHERE s IS NOT NULL) AS outcome
          FROM (SELECT case_id, ts, o_orderkey, nullif(o_orderstatus, 'P') AS s FROM $O) GROUP BY 1) USING (case_id)
          WHERE outcome IS NOT NULL""",
)
def outcome_training_set(spark, folder):
    log = order_log(spark, folder)
    gappy = log.with_events(log.events.withColumn("status", F.expr("nullif(o_orderstatus, 'P')")))
    joined = features.with_outcomes(order_features(spark, folder), outcome_by_attribute(gappy, "status"))
    return label_encode(joined, _TEXT)


_COMPACT = f"""SELECT case_id, prefix_length, coalesce(activity_id, 0) AS last_activity_id,
    list_max([len([y for y in first_ten if y = x]) for x in list_distinct(first_ten)]) AS max_repetition,
    len(list_distinct(first_ten)) AS unique_activities, label_outcome
    FROM {_NEXT} LEFT JOIN {_LINES} USING (activity) WHERE label_next_activity IS NOT NULL AND prefix_length <= 5"""


@query("compact_features", _COMPACT)
def compact_features(spark, folder):
    log = line_log(spark, folder)
    coded = encoded_log(log, activity_vocabulary(log))
    return features.compact_features(prefixes_next(coded, max_length=5, symbol="activity_id"), carry=["label_outcome"])


@query(
    "prefixes_with_outcome",
    """SELECT case_id, prefix_length, outcome FROM
       (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY $OORD) AS prefix_length FROM $O)
       JOIN (SELECT case_id, last(s ORDER BY $OORD) FILTER (WHERE s IS NOT NULL) AS outcome
             FROM (SELECT case_id, ts, o_orderkey, nullif(o_orderstatus, 'P') AS s FROM $O) GROUP BY 1) USING (case_id)
       WHERE prefix_length <= 10 AND outcome IS NOT NULL""",
)
def prefixes_with_outcome(spark, folder):
    log = order_log(spark, folder)
    gappy = log.with_events(log.events.withColumn("status", F.expr("nullif(o_orderstatus, 'P')")))
    rows = order_prefixes(spark, folder).select("case_id", "prefix_length")
    return features.with_outcomes(rows, outcome_by_attribute(gappy, "status"))


@query(
    "case_split",
    """SELECT event_id, substr(md5(CAST(user_id AS VARCHAR)), 1, 2) < '33' AS is_test FROM events""",
)
def case_split(spark, folder):
    return features.case_split(table(spark, folder, "events"), "user_id").select("event_id", "is_test")


@query(
    "row_split",
    """SELECT event_id, substr(md5(event_type || '|' || CAST(event_id AS VARCHAR)), 1, 4) < '3333' AS is_test FROM events""",
)
def row_split(spark, folder):
    return features.row_split(table(spark, folder, "events"), ["event_id"], "event_type").select("event_id", "is_test")


@query(
    "training_events",
    """SELECT event_id, user_id FROM events WHERE user_id IN
       (SELECT user_id FROM events GROUP BY 1 HAVING NOT substr(md5(CAST(user_id AS VARCHAR)), 1, 2) < '33')""",
)
def training_events(spark, folder):
    events = table(spark, folder, "events")
    chosen = features.case_split(events.select("user_id").distinct(), "user_id").where("NOT is_test")
    return events.join(chosen, "user_id", "left_semi").select("event_id", "user_id")


@query(
    "class_weights",
    """SELECT l_returnflag, count(*) AS count, round((SELECT count(*) FROM lineitem) /
        ((SELECT count(DISTINCT l_returnflag) FROM lineitem) * count(*)), 6) AS weight FROM lineitem GROUP BY 1""",
)
def class_weights(spark, folder):
    return rounded(features.class_weights(table(spark, folder, "lineitem"), "l_returnflag"), "weight")


_PREDICTED = "CASE l_linenumber % 4 WHEN 0 THEN 'N' WHEN 1 THEN CASE WHEN l_quantity > 40 THEN 'A' ELSE l_returnflag END ELSE l_returnflag END"


def _predicted(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("label"), F.expr(_PREDICTED).alias("prediction")
    )


_P = f"(SELECT l_returnflag AS label, {_PREDICTED} AS prediction FROM lineitem)"


@query(
    "confusion_matrix",
    f"""SELECT a.l AS label, b.l AS prediction, count(p.label) AS count
        FROM (VALUES ('A'), ('N'), ('R'), ('X')) a(l) CROSS JOIN (VALUES ('A'), ('N'), ('R'), ('X')) b(l)
        LEFT JOIN {_P} p ON p.label = a.l AND p.prediction = b.l GROUP BY 1, 2""",
)
def confusion_matrix(spark, folder):
    return evaluation.confusion_matrix(evaluation.confusion(_predicted(spark, folder)), ["A", "N", "R", "X"])


_REPORT = f"""(SELECT class, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0.0 END AS precision,
    CASE WHEN support > 0 THEN hit / support ELSE 0.0 END AS recall, support,
    CASE WHEN hit > 0 THEN 2 * hit / (predicted + support) ELSE 0.0 END AS f1 FROM
    (SELECT c AS class, count(*) FILTER (WHERE label = c AND prediction = c) AS hit,
            count(*) FILTER (WHERE label = c) AS support, count(*) FILTER (WHERE prediction = c) AS predicted
     FROM {_P}, (SELECT DISTINCT unnest([label, prediction]) AS c FROM {_P}) GROUP BY 1))"""


@query(
    "class_report",
    f"SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM {_REPORT}",
)
def class_report(spark, folder):
    return rounded(evaluation.class_report(evaluation.confusion(_predicted(spark, folder))), "precision", "recall", "f1")


@query(
    "classification_scores",
    f"""SELECT round((SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FROM {_P}), 6) AS accuracy,
        round(sum(precision * support) / sum(support), 6) AS weighted_precision,
        round(sum(recall * support) / sum(support), 6) AS weighted_recall,
        round(sum(f1 * support) / sum(support), 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS rows FROM {_REPORT}""",
)
def classification_scores(spark, folder):
    found = evaluation.classification_scores(evaluation.confusion(_predicted(spark, folder)))
    return rounded(found, "accuracy", "weighted_precision", "weighted_recall", "weighted_f1")


@query(
    "per_class_accuracy",
    f"SELECT label, count(*) AS rows, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM {_P} GROUP BY 1",
)
def per_class_accuracy(spark, folder):
    report = evaluation.class_report(evaluation.confusion(_predicted(spark, folder)))
    return rounded(
        report.where("support > 0").select(F.col("class").alias("label"), F.col("support").alias("rows"), F.col("recall").alias("accuracy")),
        "accuracy",
    )


_RANKED = """(SELECT event_type AS label, [['click', 'error', 'purchase', 'signup', 'view']
    [CAST((event_id * 3 + i) % 5 AS INTEGER) + 1] for i in [0, 1, 2, 3, 4]] AS ranking FROM events)"""


@query(
    "top_k_accuracy",
    f"""SELECT count(*) AS rows, round(avg(CASE WHEN list_contains(ranking[1:1], label) THEN 1.0 ELSE 0.0 END), 6) AS top1_accuracy,
        round(avg(CASE WHEN list_contains(ranking[1:3], label) THEN 1.0 ELSE 0.0 END), 6) AS top3_accuracy,
        round(avg(CASE WHEN list_contains(ranking[1:5], label) THEN 1.0 ELSE 0.0 END), 6) AS top5_accuracy FROM {_RANKED}""",
)
def top_k_accuracy(spark, folder):
    names = "array('click', 'error', 'purchase', 'signup', 'view')"
    ranked = table(spark, folder, "events").select(
        F.col("event_type").alias("label"),
        F.expr(f"transform(sequence(0, 4), i -> element_at({names}, CAST((event_id * 3 + i) % 5 AS INT) + 1))").alias("ranking"),
    )
    scores = evaluation.top_k_accuracy(ranked, "label", "ranking", ks=(1, 3, 5))
    return rounded(scores, "top1_accuracy", "top3_accuracy", "top5_accuracy")


@query(
    "regression_scores",
    """SELECT round(avg(e * e), 4) AS mse, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse,
              round(100 * avg(abs(e / (y + 1e-8))), 4) AS mape
       FROM (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 1500 AS e FROM lineitem)""",
)
def regression_scores(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction")
    )
    return rounded(evaluation.regression_scores(rows, "label", "prediction"), "mse", "mae", "rmse", "mape", digits=4)


@query(
    "top_activities_per_case",
    """SELECT user_id AS case_id, event_type AS activity, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS prob,
        row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rank
       FROM events GROUP BY 1, 2 QUALIFY rank <= 3""",
)
def top_activities_per_case(spark, folder):
    """Each user's own frequencies as predictions, cut to the three likeliest."""
    events = table(spark, folder, "events")
    totals = events.groupBy(F.col("user_id").alias("case_id")).agg(F.count(F.lit(1)).alias("total"))
    counts = events.groupBy(F.col("user_id").alias("case_id"), F.col("event_type").alias("activity")).count()
    shares = counts.join(totals, "case_id").select("case_id", "activity", (F.col("count") / F.col("total")).alias("prob"))
    return rounded(evaluation.top_k_per_case(shares, 3), "prob")


_MODELS = {"copy": "label", "always_n": "'N'", "mixed": "prediction"}


@query(
    "model_comparison",
    "WITH s AS ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS model, 'accuracy' AS metric, round(avg(CASE WHEN label = {value} THEN 1.0 ELSE 0.0 END), 6) AS value FROM {_P}"
        f" UNION ALL SELECT '{name}', 'labels_used', CAST(count(DISTINCT {value}) AS DOUBLE) FROM {_P}"
        for name, value in _MODELS.items()
    )
    + """) SELECT model, metric, value, row_number() OVER (PARTITION BY metric ORDER BY value DESC, model) = 1 AS is_best,
         accuracy_rank FROM s JOIN (SELECT model, row_number() OVER (ORDER BY value DESC, model) AS accuracy_rank
         FROM s WHERE metric = 'accuracy') USING (model)""",
)
def model_comparison(spark, folder):
    rows = _predicted(spark, folder)
    figures = []
    for name, value in _MODELS.items():
        hit = F.round(F.avg(F.when(F.col("label") == F.expr(value), 1.0).otherwise(0.0)), 6)
        figures += [(name, "accuracy", hit), (name, "labels_used", F.count_distinct(F.expr(value)).cast("double"))]
    cells = [
        F.struct(F.lit(m).alias("model"), F.lit(k).alias("metric"), v.alias("value")) for m, k, v in figures
    ]
    return evaluation.compare_models(rows.agg(F.array(*cells).alias("cells")).select(F.inline("cells")))


_VOTES = ["l_returnflag", _PREDICTED, "CASE WHEN l_quantity > 25 THEN 'R' ELSE 'A' END"]


@query(
    "majority_vote",
    f"""SELECT CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE least(a, b, c) END AS vote, count(*) AS count
        FROM (SELECT {_VOTES[0]} AS a, {_VOTES[1]} AS b, {_VOTES[2]} AS c FROM lineitem) GROUP BY 1""",
)
def majority_vote(spark, folder):
    vote = evaluation.majority_vote([F.expr(v) for v in _VOTES])
    return table(spark, folder, "lineitem").groupBy(vote.alias("vote")).agg(F.count(F.lit(1)).alias("count"))


# The era in which an order's first line was shipped: a prefix tells much about it, though not all.
_ERA = "CASE WHEN {year} < 'Y1996' THEN 'early' WHEN {year} < 'Y1998' THEN 'middle' ELSE 'late' END"
_SIDES = f"""(SELECT {_ERA.format(year="opening")} AS label, substr(md5(CAST(case_id AS VARCHAR)), 1, 2) < '33' AS is_test FROM
    (SELECT case_id, row_number() OVER w AS prefix_length, lead(activity) OVER w AS following, first(activity) OVER w AS opening
     FROM $Y WINDOW w AS (PARTITION BY case_id ORDER BY $LORD)) WHERE following IS NOT NULL AND prefix_length <= 5)"""
# What SQL can state of a fitted model: the rows it learned from and was tested on, and what must hold for any fit.
_FITTED_MODEL = f"""SELECT label, count(*) FILTER (is_test) AS support, count(*) FILTER (NOT is_test) AS trained, true AS accurate,
    true AS labels_known FROM {_SIDES} GROUP BY label"""


def _outcome_rows(spark, folder):
    """Feature rows, written once: fitting reads them many times."""
    log = year_log(spark, folder)
    first = F.min_by("activity", log.order_key())
    era = F.when(first < "Y1996", "early").when(first < "Y1998", "middle").otherwise("late")
    return cut_lineage(outcome_rows(log, activity_vocabulary(log), outcome=era))


def _stated(rows, scored, *columns):
    """Rows per label and side; whether the held-out rows are hit more often than their commonest label would be, and
    all predictions are labels."""
    hit = F.avg((F.col("label_outcome") == F.col("predicted_label")).cast("double")).alias("hit")
    share = F.max("n") / F.sum("n")
    common = scored.groupBy("label_outcome").agg(F.count(F.lit(1)).alias("n")).agg(share.alias("share")).scalar()
    known = rows.agg(F.collect_set("label_outcome")).scalar()
    judged = scored.agg(hit, F.bool_and(F.array_contains(known, F.col("predicted_label"))).alias("labels_known"))
    counts = rows.groupBy(F.col("label_outcome").alias("label")).agg(
        F.count_if("is_test").alias("support"), F.count_if(~F.col("is_test")).alias("trained")
    )
    return counts.withColumns(
        {"accurate": judged.select(F.col("hit") > common).scalar(), "labels_known": judged.select("labels_known").scalar()}
    ).select("*", *columns)


def _model_of(rows, kind, **settings):
    return fit(rows.where("NOT is_test"), COMPACT_FEATURES, "label_outcome", kind, **settings)


def _fitted(spark, folder, kind):
    """Fit on the training cases with the algorithm's own settings and classify the held-out ones."""
    rows = _outcome_rows(spark, folder)
    return _stated(rows, cut_lineage(classify(_model_of(rows, kind), rows.where("is_test"), COMPACT_FEATURES)))


@query("decision_tree_outcomes", _FITTED_MODEL)
def decision_tree_outcomes(spark, folder):
    return _fitted(spark, folder, "decision_tree")


@query("logistic_regression_outcomes", _FITTED_MODEL)
def logistic_regression_outcomes(spark, folder):
    return _fitted(spark, folder, "logistic_regression")


@query("random_forest_outcomes", _FITTED_MODEL)
def random_forest_outcomes(spark, folder):
    return _fitted(spark, folder, "random_forest")


@query("gradient_boosting_outcomes", _FITTED_MODEL)
def gradient_boosting_outcomes(spark, folder):
    return _fitted(spark, folder, "gradient_boosting")


def _three(rows):
    return {kind: _model_of(rows, kind) for kind in ("decision_tree", "logistic_regression", "random_forest")}


@query("ensemble_outcomes", _FITTED_MODEL.replace("true AS labels_known", "true AS labels_known, true AS vote_agrees"))
def ensemble_outcomes(spark, folder):
    """The vote against the models' own columns: at least as many agree with it as with any other label."""
    rows = _outcome_rows(spark, folder)
    models = _three(rows)
    voted = cut_lineage(ensemble_vote(models, rows.where("is_test"), COMPACT_FEATURES))
    labels = F.array(*[F.col(f"{name}_label") for name in models])

    def votes(label):
        return F.size(F.filter(labels, lambda x: x == label))

    agrees = votes(F.col("predicted_label")) == F.array_max(F.transform(labels, votes))
    return _stated(rows, voted, voted.agg(F.bool_and(agrees)).scalar().alias("vote_agrees"))


@query("best_outcome_model", _FITTED_MODEL.replace("true AS labels_known", "true AS labels_known, true AS is_best"))
def best_outcome_model(spark, folder):
    rows = _outcome_rows(spark, folder)
    held_out = rows.where("is_test")
    chosen = choose_best(_three(rows), held_out, COMPACT_FEATURES, "label_outcome")
    scored = cut_lineage(classify(chosen.model, held_out, COMPACT_FEATURES))
    hit = F.avg((F.col("label_outcome") == F.col("predicted_label")).cast("double"))
    best = scored.agg(F.abs(hit - F.lit(max(chosen.accuracies.values()))) < 1e-9).scalar()
    return _stated(rows, scored, best.alias("is_best"))


@query(
    "feature_importance",
    "SELECT unnest(['last_activity_id', 'max_repetition', 'prefix_length', 'unique_activities']) AS feature, true AS valid, 1.0 AS total, 'last_activity_id' AS first",
)
def outcome_feature_importance(spark, folder):
    """The importances of a forest, which add up to 1; the last activity says most about the era."""
    model = _model_of(_outcome_rows(spark, folder), "random_forest")
    pairs = feature_importance(model, COMPACT_FEATURES)
    found = spark.createDataFrame(pairs, "feature string, importance double")
    total, first = found.agg(F.round(F.sum("importance"), 6)).scalar(), F.lit(pairs[0][0])
    return found.select("feature", F.col("importance").between(0, 1).alias("valid"), total.alias("total"), first.alias("first"))


@query(
    "outcome_engine",
    """SELECT outcome AS label, count(*) AS support, count(*) FILTER (price_mean IS NULL) AS missing, true AS same_when_loaded, true AS vote_agrees,
        (SELECT count(*) FROM (SELECT activity FROM $O UNION SELECT 'START' UNION SELECT 'END')) AS vocabulary
       FROM (SELECT case_id, row_number() OVER w AS prefix_length,
                avg(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price_mean
             FROM $O WINDOW w AS (PARTITION BY case_id ORDER BY $OORD))
       JOIN (SELECT case_id, last(s ORDER BY $OORD) FILTER (WHERE s IS NOT NULL) AS outcome
             FROM (SELECT case_id, ts, o_orderkey, nullif(o_orderstatus, 'P') AS s FROM $O) GROUP BY 1) USING (case_id)
       WHERE prefix_length <= 10 AND outcome IS NOT NULL AND substr(md5(outcome || '|' || case_id || '|' || prefix_length), 1, 4) < '3333'
       GROUP BY outcome""",
)
def outcome_engine(spark, folder):
    """The first engine's job, both phases: trained, saved, loaded again, and held against itself in memory.

    Prices are missing at the beginning of many cases, so the imputer has work.
    """
    log = order_log(spark, folder)
    gappy = log.events.withColumns(
        {"status": F.expr("nullif(o_orderstatus, 'P')"), "price": F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END")}
    )
    log = log.with_events(gappy)
    target = scratch_folder(spark, "engine")
    columns = (["c_mktsegment"], ["o_orderstatus"], ["price"])
    made = train_engine(log, target, "both", "status", *columns)
    held_out = cut_lineage(engine_rows(log, "status", *columns).where("is_test"))
    keys = ["case_id", "prefix_length"]
    labels = [f"{name}_label" for name in ENSEMBLE]
    scored = cut_lineage(predict_outcomes(made.outcome, held_out).drop("activities"))
    del made  # the driver holds one ensemble at a time
    loaded = load_engine(spark, target)
    again = predict_outcomes(loaded.outcome, held_out).select(*keys, F.struct(*labels, "predicted_label").alias("again"))
    both = scored.join(again, keys)
    same = F.bool_and(F.struct(*labels, "predicted_label") == F.col("again")).alias("same_when_loaded")
    vote = F.bool_and(F.col("predicted_label") == evaluation.majority_vote([F.col(c) for c in labels])).alias("vote_agrees")
    missing = F.count_if(F.col("price_mean").isNull()).alias("missing")
    found = both.groupBy(F.col("outcome").alias("label")).agg(F.count(F.lit(1)).alias("support"), missing, same, vote)
    return found.withColumn("vocabulary", loaded.vocabulary.agg(F.count(F.lit(1))).scalar())


@query(
    "outcome_by_case",
    "SELECT case_id, last(activity ORDER BY $EORD) AS outcome FROM $E GROUP BY 1",
)
def outcome_by_case(spark, folder):
    return outcome_by_last_activity(click_log(spark, folder))
