"""Writers for cleaned logs, predictions, fitted tables and models, and training records."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.columns import col
from tracewell.log import EventLog
from tracewell.session import shared_folder


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; it goes when the application's JVM ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def write_log(df: DataFrame, path: str, file_format: str = "csv", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if file_format == "csv":
        writer.option("header", True).csv(path)
    elif file_format == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown file format {file_format!r}")


def flatten(df: DataFrame) -> DataFrame:
    """Structs to columns named ``outer_inner`` and arrays to JSON text, as CSV needs."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        columns = []
        for field in df.schema.fields:
            if isinstance(field.dataType, T.StructType):
                columns += [
                    col(field.name).getField(inner.name).alias(f"{field.name}_{inner.name}")
                    for inner in field.dataType.fields
                ]
            else:
                columns.append(col(field.name))
        df = df.select(*columns)
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType))]
    return df.withColumns({name: F.to_json(col(name)) for name in nested}) if nested else df


def export_predictions(predictions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_log(flatten(predictions), path, "csv", mode)


def save_tables(folder: str, **tables: DataFrame) -> None:
    """Fitted tables (vocabulary, state tables, scaling figures), one Parquet folder each."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def training_record(log: EventLog, outcomes: DataFrame) -> DataFrame:
    """One row: cases, events, distinct activities, outcome classes, vocabulary with START and END."""
    sizes = log.events.agg(
        F.count_distinct("case_id").alias("cases"),
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("activity").alias("activities"),
    )
    classes = outcomes.agg(F.count_distinct("outcome")).scalar()
    return sizes.withColumn("outcome_classes", classes).withColumn("vocabulary_size", F.col("activities") + 2)


def append_training_record(record: DataFrame, path: str) -> None:
    record.withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(path)
