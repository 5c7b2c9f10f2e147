"""WARC archives: written with revisit records, read back by verified boundary chains.

A record names its length, so its header gives the offset of its successor. Readers emit such a pair for every
place where a header seems to begin, also inside payloads. Then, for each file, pointer jumping from the file's
start keeps the records that the chain of successors reaches; whatever only looks like a record is left out.
Archives are rolled at a size that a task can hold, and written by Spark's own writer.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import stored
from tracewell.session import shared_folder

ROLL_BYTES = 32 << 20  # archives are rolled at about this size
REVISIT_BYTES = 1000  # equal payloads from this size on are stored once
BROADCAST_ROWS = 100_000  # repeated payloads up to this many are broadcast; beyond, they are joined
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"(?:^|\r\n)content-length:[ \t]*(\d+)[ \t]*(?:\r\n|$)", re.I)
_FIELD = re.compile(rb"(?:^|\r\n)([^:\r\n]+):[ \t]*([^\r\n]*)")
_LONG = 1 << 63
RECORD = "path string, start long, next long, size long, record_type string, record_id string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string"


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null. Control characters can't end the line."""
    clean = F.regexp_replace(value.cast("string"), "[\\x00-\\x1F\\x7F]", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def write_warc(pages: DataFrame, folder: str | None = None, revisit_bytes: int = REVISIT_BYTES, roll_bytes: int = ROLL_BYTES) -> str:
    """Write a record for each row (``page_id, url, html``) and return the folder of the archives.

    Payload is the html in UTF-8, nothing where it is null. Of equal payloads of ``revisit_bytes`` or more the one
    with the largest id is a response and the others revisit it (rows that repeat that id are responses as well).
    """
    spark = pages.sparkSession
    if folder is None:
        folder = f"{shared_folder(spark)}/tracewell-warc-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"bytes": F.octet_length("html"), "name": F.sha2(F.col("html").cast("binary"), 256)})
    # One row for each payload, merged before the shuffle; then those that occur again.
    repeated = rows.where(F.col("bytes") >= revisit_bytes).groupBy("name").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1")
    repeated = stored(repeated.select("name", "kept"), "repeated")
    figures = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    side = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    rows = rows.join(side, "name", "left").withColumn("revisit", F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("page_id")))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    mark = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest").cast("binary"))
    urn = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(mark, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, "html"))
    profile = F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", urn),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _header("WARC-Profile", profile),
        _header("X-Page-Id", F.col("page_id")),
        _header("X-Refers-To-Page-Id", F.when(F.col("revisit"), F.col("kept"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block,
        F.lit("\r\n\r"),  # the writer's line end closes the record
    )
    mean = max(1, figures["bytes"] // max(1, figures["rows"]) + 500)
    writer = rows.select(record.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", max(1, roll_bytes // mean))
    writer.text(folder)
    return folder


def _whole(text: bytes) -> int | None:
    """The number that a text holds, if it is one of 64 bits."""
    value = int(text) if re.fullmatch(rb"-?\d{1,19}", text) else _LONG
    return value if -_LONG <= value < _LONG else None


def candidates(content: bytes, with_payload: bool = False) -> Iterator[tuple]:
    """Every place where a record seems to begin, with its successor; digests only where the successor can be one."""
    size = len(content)
    for found in _MAGIC.finditer(content):
        start = found.start()
        # A record follows the end of another, so no header reaches beyond the next candidate.
        if start and content[max(0, start - 4) : start] != b"\r\n\r\n":
            continue
        end = content.find(b"\r\n\r\n", found.end() - 2)
        if end < 0:
            continue
        head = content[found.end() : end]
        length = _LENGTH.search(head)
        if not length:
            continue
        begin = end + 4
        stop = begin + int(length[1])
        after = stop + 4
        if after > size or content[stop:after] != b"\r\n\r\n":
            continue
        if after < size and not _MAGIC.match(content, after):
            continue
        fields = {k.strip().lower(): v.strip() for k, v in _FIELD.findall(head)}
        text = lambda name: fields[name].decode("utf-8", "replace") if name in fields else None
        number = lambda name: _whole(fields.get(name, b""))
        payload, count, digest = content[begin:stop], None, None
        kind = text(b"warc-type")
        if b"http" in fields.get(b"content-type", b"") and payload.startswith(b"HTTP/"):
            split = payload.find(b"\r\n\r\n")
            inner = payload[:split]
            payload = payload[split + 4 :] if split >= 0 else b""
            if kind == "revisit":
                told = _LENGTH.search(inner)
                count = int(told[1]) if told else None
        if kind == "revisit":
            named = text(b"warc-payload-digest") or ""
            digest = named.partition(":")[2].lower() or None
        else:
            count, digest = len(payload), hashlib.sha1(payload).hexdigest()
        row = (start, after, size, kind, text(b"warc-record-id"), text(b"warc-target-uri"), number(b"x-page-id"), number(b"x-refers-to-page-id"), count, digest)
        yield (*row, payload) if with_payload else row


def reachable(start: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches, by doubling pointers and the reached set alike."""
    order = np.argsort(start, kind="stable")
    sorted_start = start[order]
    end = len(start)
    at = np.searchsorted(sorted_start, after[order])
    at = np.where((at < end) & (sorted_start[np.minimum(at, end - 1)] == after[order]), at, end)
    jump = np.append(at, end)
    reached = np.zeros(end + 1, dtype=bool)
    if end and sorted_start[0] == 0:
        reached[0] = True
    count = 0
    while reached[:end].sum() != count:
        count = int(reached[:end].sum())
        reached[jump[reached]] = True
        jump = jump[jump]
    out = np.zeros(end, dtype=bool)
    out[order] = reached[:end]
    return out


def read_warc(spark, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of all archives in a folder: offsets, header fields, payload size and digest, and the payload if asked.

    Payload means what follows the HTTP header. A file whose chain breaks yields the records before the break.
    Empty files and folders without files yield none.
    """
    schema = RECORD + ", payload binary" * with_payload
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = list(candidates(content.as_buffer().to_pybytes(), with_payload))
                if rows:
                    columns = [[path] * len(rows), *map(list, zip(*rows))]
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(dict(zip(names, columns)), dtype=object), schema=_arrow(schema), preserve_index=False)

    def chain(rows: pa.Table) -> pa.Table:  # in Arrow, as pandas would round long ids beside nulls
        return rows.filter(pa.array(reachable(rows["start"].to_numpy(), rows["next"].to_numpy())))

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    found = files.mapInArrow(run, schema)
    edges = found.select("path", "start", "next")
    kept = edges.groupBy("path").applyInArrow(chain, "path string, start long, next long") if with_payload else None
    if with_payload:  # payloads stay where they are read; only the offsets go through the chain
        return found.join(kept.select("path", "start"), ["path", "start"], "left_semi")
    return found.groupBy("path").applyInArrow(chain, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (part.split() for part in schema.split(", "))])


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write the pages as archives and read them back.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``, one row for each page. Null html is an
    empty payload, null ids stay null, repeated rows are records of their own, further columns are ignored, and
    an empty table gives an empty one.
    """
    folder = write_warc(pages)
    return read_warc(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
