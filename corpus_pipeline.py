"""The corpus pipeline: from documents to packed token sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table, which is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of documents; what a stage decides takes effect there.
SQL can't express the stages, so tests hold them against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import stored
from tracewell.llm.jaccard import similar_components
from tracewell.llm.lines import dedup_lines
from tracewell.llm.packing import packed_documents
from tracewell.llm.queries import tokenizer_file
from tracewell.llm.surrogates import with_surrogates
from tracewell.llm.toxicity import score_texts, train_toxicity
from tracewell.session import RUNTIME_CONF

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_texts(docs, model, score_col="__score").where(F.col("__score") < TOXIC).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with words that resemble an earlier line go, short ones too; ``n_chars`` follows the text."""
    return _measured(docs, dedup_lines(docs, least_words=1))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays (null last); equal rows of an id are one."""
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        first = similar_components(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("__id")).distinct()
        return docs.join(first, docs["doc_id"].eqNullSafe(F.col("__id")), "left_semi")
    # Where ids repeat, a row is known by its id and text together.
    part = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("doc_id", "text")]
    rows = docs.withColumn("__key", F.md5(F.concat(part[0], F.lit("|"), part[1]).cast("binary")))
    groups = similar_components(rows, id_col="__key").select(F.col("doc_id").alias("__key"), "component_id").distinct()
    named = rows.select("__key", "doc_id").distinct().join(groups, "__key")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key"))["__key"].alias("__key"))
    return rows.join(first.select("__key"), "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)


def replace_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get surrogates; ``n_chars`` follows the text."""
    return _measured(docs, with_surrogates(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as sequences of at most 2048 tokens."""
    return packed_documents(docs, tokenizer_file("word_bpe_49k.json"))


def _measured(docs: DataFrame, changed: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return changed
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("private_data", replace_private_data),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage's result being written to the shared folder."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
