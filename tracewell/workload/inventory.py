"""The file catalogue, built from the page table with customers as uploaders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions.columns import epoch_micros
from tracewell.sources import catalogue
from tracewell.workload.registry import query, table

_NAME = """'log_' || page_id || CASE page_id % 6 WHEN 0 THEN '.csv' WHEN 1 THEN '.XES' WHEN 2 THEN '.xes.gz'
           WHEN 3 THEN '' WHEN 4 THEN '.pdf' ELSE '.v2.csv' END"""
_SIZE = """CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 13 = 0 THEN 52428800 WHEN page_id % 17 = 0 THEN 52428801
           ELSE page_id * 7919 % 70000000 END"""
_FILES = f"""(SELECT url || '#' || page_id AS path, {_NAME} AS original_name, CAST({_SIZE} AS BIGINT) AS size_bytes,
                     page_id % 100 AS uploader, url AS description,
                     TIMESTAMP '2024-01-01 00:00:00' + (page_id % 1000) * INTERVAL 1 MINUTE AS uploaded_at FROM pages)"""


def files(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.select(
        F.expr("concat(url, '#', page_id)").alias("path"),
        F.expr(_NAME).alias("original_name"),
        F.expr(f"CAST({_SIZE} AS BIGINT)").alias("size_bytes"),
        F.expr("page_id % 100").alias("uploader"),
        F.col("url").alias("description"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, page_id % 1000)").alias("uploaded_at"),
    )


def users(spark, folder):
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))


@query(
    "upload_validation",
    f"""SELECT path, coalesce(size_bytes, -1) AS size_bytes,
               CASE WHEN regexp_extract(lower(original_name), '\\.([^.]*)$', 1) NOT IN ('csv', 'xes')
                    THEN 'unsupported extension'
                    WHEN size_bytes > 52428800 THEN 'file too large' END AS reason,
               regexp_extract(lower(original_name), '\\.([^.]*)$', 1) IN ('csv', 'xes')
                   AND coalesce(size_bytes, 0) <= 52428800 AS accepted
        FROM {_FILES}""",
)
def upload_validation(spark, folder):
    checked = catalogue.validate(files(spark, folder))
    return checked.select("path", F.coalesce("size_bytes", F.lit(-1)).alias("size_bytes"), "reason", "accepted")


@query(
    "file_facts",
    f"""SELECT path, regexp_extract(lower(original_name), '\\.([^.]*)$', 1) AS extension,
               round(coalesce(size_bytes, 0) / 1048576.0, 2) AS size_mb, round(coalesce(size_bytes, 0) / 1024.0, 2) AS size_kb
        FROM {_FILES}""",
)
def file_facts(spark, folder):
    return catalogue.with_file_facts(files(spark, folder)).select(
        "path", "extension", F.col("size_mb").cast("double").alias("size_mb"), F.col("size_kb").cast("double").alias("size_kb")
    )


@query(
    "catalogue_totals",
    f"""SELECT count(*) AS files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes,
               round(CAST(coalesce(sum(size_bytes), 0) AS BIGINT) / 1048576.0, 2) AS total_mb FROM {_FILES}""",
)
def catalogue_totals(spark, folder):
    return catalogue.totals(files(spark, folder)).withColumn("total_mb", F.col("total_mb").cast("double"))


@query(
    "recent_files",
    f"SELECT path, epoch_us(uploaded_at) AS uploaded_micros FROM {_FILES} ORDER BY uploaded_at DESC, path LIMIT 5",
)
def recent_files(spark, folder):
    recent = catalogue.most_recent(files(spark, folder))
    return recent.select("path", epoch_micros(F.col("uploaded_at")).alias("uploaded_micros"))


@query(
    "search_files",
    f"""SELECT path, original_name, c_name AS username FROM {_FILES} JOIN customer ON uploader = c_custkey
        WHERE contains(lower(original_name), 'er#00000001') OR contains(lower(description), 'er#00000001')
           OR contains(lower(c_name), 'er#00000001')""",
)
def search_files(spark, folder):
    found = catalogue.search(files(spark, folder), users(spark, folder), "ER#00000001")
    return found.select("path", "original_name", "username")


@query(
    "sorted_files",
    f"""SELECT path, coalesce(size_bytes, -1) AS size_bytes, c_name AS username FROM {_FILES}
        JOIN customer ON uploader = c_custkey""",
)
def sorted_files(spark, folder):
    listed = files(spark, folder).join(users(spark, folder), F.col("uploader") == F.col("user_id"))
    ordered = catalogue.sort_files(listed, "size", "asc")
    return ordered.select("path", F.coalesce("size_bytes", F.lit(-1)).alias("size_bytes"), "username")
