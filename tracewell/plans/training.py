"""Training jobs: outcome models, bucket models, or both."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.log import EventLog, standardise
from tracewell.operators.evaluation import regression_columns, top_k_columns
from tracewell.operators.features import case_split, compact_features
from tracewell.operators.prefixes import prefixes_next
from tracewell.operators.traces import outcome_by_last_activity
from tracewell.operators.vocabulary import activity_vocabulary, encoded_log
from tracewell.plans.classifiers import Chosen, choose_best, fit
from tracewell.plans.prediction import HORIZON, TransitionModel, evaluation_rows, train, training_samples
from tracewell.session import build_session, cut_lineage
from tracewell.sources.readers import load_log
from tracewell.sources.sinks import append_training_record, save_model, save_tables, training_record

COMPACT_FEATURES = ("last_activity_id", "prefix_length", "max_repetition", "unique_activities")


@dataclass(frozen=True)
class TrainingRun:
    vocabulary: DataFrame
    outcome: Chosen | None = None
    buckets: TransitionModel | None = None
    bucket_scores: DataFrame | None = None


def outcome_rows(log: EventLog, vocabulary: DataFrame, max_length: int = 5, outcome: Column | None = None) -> DataFrame:
    """Compact features of short prefixes, the case outcome as label, and the side of the case split.

    The outcome is an aggregate over the events of a case, by default the last activity.
    """
    samples = prefixes_next(encoded_log(log, vocabulary), max_length=max_length, outcome=outcome, symbol="activity_id")
    return case_split(compact_features(samples, max_length=max_length, carry=["label_outcome"]))


def bucket_scores(evaluated: DataFrame) -> DataFrame:
    """Top-k accuracy and hour errors per bucket on held-out cases."""
    return evaluated.groupBy("bucket_id").agg(
        F.count(F.lit(1)).alias("rows"),
        *top_k_columns("label_next_activity", "ranking", (1, 3, 5)),
        *regression_columns("remaining_time", "predicted_hours"),
    )


def run_training(
    log: EventLog,
    folder: str | None = None,
    phase: str = "both",
    max_bucket: int = HORIZON,
    max_outcome_length: int = 5,
    trees: int = 200,
) -> TrainingRun:
    """Phase "outcome", "buckets" or "both"; results are saved when a folder is given."""
    if phase not in ("outcome", "buckets", "both"):
        raise ValueError("phase must be 'outcome', 'buckets' or 'both'")
    vocabulary = activity_vocabulary(log)
    chosen = model = scores = None
    if phase != "buckets":
        rows = cut_lineage(outcome_rows(log, vocabulary, max_outcome_length))  # read by every fit
        training = rows.where(~F.col("is_test"))
        models = {
            "decision_tree": fit(training, COMPACT_FEATURES, "label_outcome", "decision_tree"),
            "logistic_regression": fit(training, COMPACT_FEATURES, "label_outcome", "logistic_regression"),
            "random_forest": fit(training, COMPACT_FEATURES, "label_outcome", "random_forest", numTrees=trees),
        }
        chosen = choose_best(models, rows.where("is_test"), COMPACT_FEATURES, "label_outcome")
        if folder:
            save_model(chosen.model, f"{folder}/outcome")
    if phase != "outcome":
        samples = case_split(training_samples(log, max_bucket))
        model = train(samples.where(~F.col("is_test")), max_bucket)
        scores = bucket_scores(evaluation_rows(samples.where("is_test"), model))
        if folder:
            model.save(f"{folder}/buckets")
    if folder:
        save_tables(folder, vocabulary=vocabulary)
        append_training_record(training_record(log, outcome_by_last_activity(log)), f"{folder}/records")
    return TrainingRun(vocabulary, chosen, model, scores)


def main(arguments: list[str] | None = None) -> None:
    """Job entry for spark-submit: train on a log file and save the models below a folder."""
    parser = argparse.ArgumentParser(description=run_training.__doc__)
    parser.add_argument("log", help="CSV, XES or Parquet log with the standard XES columns")
    parser.add_argument("folder", help="shared folder for the results")
    parser.add_argument("--phase", choices=("outcome", "buckets", "both"), default="both")
    parser.add_argument("--max-bucket", type=int, default=HORIZON)
    parser.add_argument("--tiebreak", nargs="*", default=[], help="columns that order events of equal time")
    options = parser.parse_args(arguments)
    spark = build_session("tracewell-training")
    events = standardise(load_log(spark, options.log).events)
    order = [c for c in (*options.tiebreak, "event_index") if c in events.columns]
    events = events.withColumn("ts", F.col("ts").cast("timestamp")).where("case_id IS NOT NULL")
    run_training(EventLog(events, ("ts", *order)), options.folder, options.phase, options.max_bucket)


if __name__ == "__main__":
    main()
