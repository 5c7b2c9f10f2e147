"""Activity and category codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.columns import col, text_or_token
from tracewell.log import EventLog
from tracewell.operators.lookup import pinned, settled
from tracewell.operators.numbering import number_rows


def activity_vocabulary(log: EventLog) -> DataFrame:
    """Activities in alphabetical order with ids from 1; 0 stays free for padding and unknowns."""
    distinct = log.events.select("activity").where("activity IS NOT NULL").distinct()
    return number_rows(distinct, ["activity"], "activity_id")


def token_vocabulary(log: EventLog, tokens: Sequence[str] = ("START", "END")) -> DataFrame:
    """Zero-based alphabetical ids over the activities and the boundary tokens."""
    spark = log.events.sparkSession
    extra = spark.createDataFrame([(t,) for t in tokens], "activity string")
    distinct = log.events.select("activity").where("activity IS NOT NULL").union(extra).distinct()
    return number_rows(distinct, ["activity"], "activity_id").withColumn("activity_id", F.col("activity_id") - 1)


def encode_events(df: DataFrame, vocabulary: DataFrame, column: str = "activity") -> DataFrame:
    codes = pinned(vocabulary.select(col("activity").alias(column), F.col("activity_id").alias(f"{column}_id")))
    return df.join(codes, column, "left").withColumn(
        f"{column}_id", F.coalesce(F.col(f"{column}_id"), F.lit(0).cast("bigint"))
    )


def encoded_log(log: EventLog, vocabulary: DataFrame) -> EventLog:
    """The log with ``activity_id`` beside the activity; a vocabulary of any size is joined before anything is
    collected."""
    return log.with_events(encode_events(log.events, vocabulary))


def decode_events(df: DataFrame, vocabulary: DataFrame, column: str = "activity_id") -> DataFrame:
    """Ids to names: 0 is the padding token, an id outside the vocabulary is ``<UNK>``."""
    names = pinned(vocabulary.select(F.col("activity_id").alias(column), F.col("activity").alias("_name")))
    name = F.when(col(column) == 0, F.lit("<PAD>")).otherwise(F.coalesce(F.col("_name"), F.lit("<UNK>")))
    return df.join(names, column, "left").withColumn("activity", name).drop("_name")


def category_codes(df: DataFrame, column: str, null_token: str = "nan") -> DataFrame:
    """Zero-based alphabetical code per distinct value of a text column; null is the token."""
    return fit_categories(df, [column], null_token)[column]


def fit_categories(df: DataFrame, columns: Sequence[str], null_token: str = "nan") -> dict[str, DataFrame]:
    """The codes (``value, code``) of several text columns from one pass over the table and one numbering."""
    cells = [F.struct(F.lit(c).alias("column"), text_or_token(col(c), null_token).alias("value")) for c in columns]
    distinct = df.select(F.inline(F.array(*cells))).distinct()
    numbered = number_rows(distinct, ["column", "value"], "_number")
    firsts = numbered.groupBy("column").agg(F.min("_number").alias("_first"))  # one row per column
    coded = settled(numbered.join(F.broadcast(firsts), "column").select("column", "value", (F.col("_number") - F.col("_first")).alias("code")))
    return {column: coded.where(F.col("column") == column).select("value", "code") for column in columns}


def label_encode(df: DataFrame, columns: Sequence[str], fitted: dict[str, DataFrame] | None = None,
                 unseen: str = "keep", null_token: str = "nan") -> DataFrame:
    """Replace text columns by their codes.

    A value not seen when the codes were fitted gets the code after the last one (``unseen='keep'``,
    training) or class 0 (``unseen='zero'``, serving).
    """
    fitted = dict(fitted or {})
    missing = [column for column in columns if column not in fitted]
    if missing:
        fitted |= fit_categories(df, missing, null_token)
    for column in columns:
        codes = fitted[column]
        if unseen == "zero":
            fallback = F.lit(0).cast("bigint")
        else:
            fallback = codes.agg(F.max("code") + 1).scalar()
        table = pinned(codes.select(F.col("value").alias("_value"), F.col("code").alias("_code")))
        joined = df.join(table, text_or_token(col(column), null_token) == F.col("_value"), "left")
        df = joined.withColumn(column, F.coalesce(F.col("_code"), fallback)).drop("_value", "_code")
    return df


def number_or_zero(text: Column) -> Column:
    """Serving fallback for text without an encoder."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))
