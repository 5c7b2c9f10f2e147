"""Small helpers that the operators share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.session import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The table written once to the shared folder and read back: its lineage ends there.

    The files go when the application's JVM ends. Spark removes the shuffle files of a finished query when the
    driver's JVM collects its handle; asking for that here keeps a chain of steps from holding all of theirs.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/tracewell-{label}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(folder)


def discarded(df: DataFrame) -> None:
    """Remove the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(lengths: np.ndarray, budget: int):
    """Ranges of rows whose lengths add up to about ``budget``; a longer row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > budget:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def crc_text(column: str) -> Column:
    """crc32 of an id written as decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
