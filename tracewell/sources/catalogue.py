"""Inventory of a folder of log files: validation, derived facts, totals, search and order."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_UPLOAD_BYTES = 50 * 1024 * 1024
ACCEPTED_EXTENSIONS = ("csv", "xes")


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """One row per file below a folder; file contents are not read.

    Spark's file source lists empty files and reads none of them; their times come from the file system.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kept = files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("uploaded_at"))
    # The listing has names as URIs, the rows have them as paths.
    names = [unquote(name).replace("file:///", "file:/", 1) for name in files.inputFiles()]
    listed = spark.createDataFrame([(name,) for name in names], "path string")
    empty = [row["path"] for row in listed.join(kept.select("path"), "path", "left_anti").collect()]
    if empty:
        hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        paths = [hadoop.Path(name) for name in empty]
        times = [p.getFileSystem(conf).getFileStatus(p).getModificationTime() / 1000 for p in paths]
        rows = spark.createDataFrame(list(zip(empty, times)), "path string, seconds double")
        kept = kept.unionByName(rows.select("path", F.lit(0).cast("long").alias("size_bytes"), F.timestamp_seconds("seconds").alias("uploaded_at")))
    return kept.select("path", F.element_at(F.split("path", "/"), -1).alias("original_name"), "size_bytes", "uploaded_at")


def extension(name: Column) -> Column:
    """Text after the last dot in lower case, '' without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def size_mb(size: Column) -> Column:
    return F.round(F.coalesce(size, F.lit(0)) / 1048576.0, 2)


def size_kb(size: Column) -> Column:
    return F.round(F.coalesce(size, F.lit(0)) / 1024.0, 2)


def validate(files: DataFrame) -> DataFrame:
    """Add ``accepted`` and the ``reason`` of a reject."""
    known = extension(F.col("original_name")).isin(*ACCEPTED_EXTENSIONS)
    reason = F.when(~known, "unsupported extension").when(F.col("size_bytes") > MAX_UPLOAD_BYTES, "file too large")
    return files.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def with_file_facts(files: DataFrame) -> DataFrame:
    name, size = F.col("original_name"), F.col("size_bytes")
    return files.withColumns({"extension": extension(name), "size_mb": size_mb(size), "size_kb": size_kb(size)})


def totals(files: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("size_bytes"), F.lit(0))
    return files.agg(F.count(F.lit(1)).alias("files"), total.alias("total_bytes")).withColumn(
        "total_mb", size_mb(F.col("total_bytes"))
    )


def most_recent(files: DataFrame, n: int = 5, tiebreak: str = "path") -> DataFrame:
    return files.orderBy(F.desc("uploaded_at"), tiebreak).limit(n)


def search(files: DataFrame, users: DataFrame, text: str) -> DataFrame:
    """Files whose name, description or uploader's name contains the text, in any case.

    ``users`` has ``user_id`` and ``username``; the join is left to adaptive execution, which
    broadcasts the users when they turn out small.
    """
    joined = files.join(users, files["uploader"] == users["user_id"]).drop("user_id")
    needle = F.lit(text.lower())
    found = F.lit(False)
    for name in ("original_name", "description", "username"):
        found = found | F.coalesce(F.contains(F.lower(F.col(name)), needle), F.lit(False))
    return joined.where(found)


_SORT_KEYS = {"date": "uploaded_at", "name": "original_name", "size": "size_bytes", "user": "username"}


def sort_files(files: DataFrame, key: str = "date", order: str = "desc", tiebreak: str = "path") -> DataFrame:
    """Sort by date, name, size or user; an unknown key means date, an unknown order descending."""
    column = F.col(_SORT_KEYS.get(key, "uploaded_at"))
    return files.orderBy(column.asc() if order == "asc" else column.desc(), tiebreak)
