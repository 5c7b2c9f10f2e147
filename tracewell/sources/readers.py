"""Event-log scans: CSV, XES (plain or gzipped) and Parquet."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.columns import col
from tracewell.sources.sinks import scratch_folder
from tracewell.sources.times import chosen_formats, format_counts, parsed_time

CORRUPT = "_corrupt_record"


class LogNotFoundError(FileNotFoundError):
    """No file at the path."""


class LogFormatError(ValueError):
    """The file extension names no supported format."""


class LogParseError(ValueError):
    """The content does not parse in strict mode; the message names a file and how many of its rows are bad."""


@dataclass(frozen=True)
class LoadedLog:
    """The rows that parsed, and in tolerant mode the raw text of those that did not."""

    events: DataFrame
    rejects: DataFrame | None = None


def log_format(path: str) -> str:
    """Format by the last suffix, looking past ``.gz``; other dots in the name do not matter."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    base = name.removesuffix(".gz")
    suffix = base.rsplit(".", 1)[-1] if "." in base else ""
    if suffix in ("csv", "xes", "parquet") and not (suffix == "parquet" and name.endswith(".gz")):
        return suffix
    raise LogFormatError(f"unsupported log format: {path}")


def load_log(
    spark: SparkSession,
    path: str,
    mode: str = "strict",
    schema: T.StructType | str | None = None,
    timestamp_formats: Mapping[str, Sequence[str]] | None = None,
    trace_attributes: Mapping[str, str] | None = None,
    event_attributes: Mapping[str, str] | None = None,
) -> LoadedLog:
    """Load a log by its extension. Strict mode fails on bad rows; tolerant mode sets them aside.

    Strict mode reads a text log once to check every row, and raises ``LogParseError`` here, not when the events are
    used. Without ``schema`` and ``timestamp_formats`` a CSV's time columns are found in that pass; without attribute
    maps an XES log's attributes are.
    """
    if mode not in ("strict", "tolerant"):
        raise ValueError("mode must be 'strict' or 'tolerant'")
    kind = log_format(path)
    tolerant = mode == "tolerant"
    try:
        if kind == "parquet":
            return LoadedLog(spark.read.parquet(path))
        if kind == "csv":
            return read_csv(spark, path, schema, timestamp_formats, tolerant)
        return read_xes(spark, path, trace_attributes, event_attributes, tolerant)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise LogNotFoundError(path) from error
        raise LogParseError(str(error)) from error


def checked(rows: DataFrame, *figures: Column, tolerant: bool = False) -> dict:
    """Figures of all rows from one pass; strict mode raises if the text of some did not parse.

    One aggregate, so each task hands on a single row. (Observed metrics would do as well, but a session that has
    observed something can't ship a binary logistic model to its tasks any more.)
    """
    bad = col(CORRUPT).isNotNull()
    named = rows if "file" in rows.columns else rows.withColumn("file", F.input_file_name())
    found = named.agg(F.count_if(bad).alias("_bad"), F.min(F.when(bad, F.col("file"))).alias("_file"), *figures).first().asDict()
    if found["_bad"] and not tolerant:
        raise LogParseError(f"{found['_file']}: rows do not parse; in the whole log {found['_bad']}")
    return found


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    timestamp_formats: Mapping[str, Sequence[str]] | None = None,
    tolerant: bool = False,
) -> LoadedLog:
    """CSV with a header row. Named columns parse as times by the first of their formats that fits.

    Without a schema all columns are text; if no formats are given either, a column is a time where one of
    ``times.TIME_FORMATS`` fits all its values. The check and all formats of all columns take one pass.
    """
    detect = schema is None and timestamp_formats is None
    if schema is None:
        schema = spark.read.option("header", True).csv(path).schema
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.option("header", True).option("multiLine", False).schema(full)
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    good, bad = _sides(rows)
    formats = dict(timestamp_formats or {})
    if detect or not tolerant:
        texts = [f.name for f in schema.fields if detect and isinstance(f.dataType, T.StringType)]
        every = rows.where(_all_parsed(rows))
        seen = checked(every, *format_counts(texts, col(CORRUPT).isNull()), tolerant=tolerant)
        formats |= chosen_formats(texts, seen)
    times = {name: parsed_time(col(name), each) for name, each in formats.items()}
    return LoadedLog(good.withColumns(times) if times else good, bad if tolerant else None)


def _all_parsed(rows: DataFrame) -> Column:
    """A test that always holds and names every column.

    Spark parses only the columns a query names, and a row that is bad in another column would pass as good.
    """
    return F.hash(*[col(name) for name in rows.columns if name != CORRUPT]) >= F.lit(-(2**31))


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that parsed and the text of those that did not."""
    every = _all_parsed(rows)
    good = rows.where(col(CORRUPT).isNull() & every).drop(CORRUPT)
    return good, rows.where(col(CORRUPT).isNotNull() & every).select(CORRUPT)


# The typed attribute elements of XES.
XES_TAGS = ("string", "date", "int", "float", "boolean", "id")
XES_TAG_TYPES = {"string": "string", "date": "timestamp", "int": "bigint", "float": "double", "boolean": "boolean",
                 "id": "string"}

STANDARD_TRACE = {"concept:name": "string"}
STANDARD_EVENT = {
    "concept:name": "string",
    "time:timestamp": "date",
    "org:resource": "string",
    "lifecycle:transition": "string",
}

# An attribute inside another one is named by both keys.
INSIDE = "/"
LIST = "list"
_CLOSED = "closed"


# Tags from the trace or event down to an element whose inner attributes are read; the empty path is always open.
TagPath = tuple[str, ...]


def _elements(opened: frozenset[TagPath], at: TagPath = ()) -> list[T.StructField]:
    """The attribute elements at a path; of an element that is not opened only whether it holds others."""
    key, value = T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())

    def array(*fields: T.StructField) -> T.ArrayType:
        return T.ArrayType(T.StructType([*fields]))

    def inner(tag: str) -> list[T.StructField]:
        return _elements(opened, (*at, tag)) if (*at, tag) in opened else [T.StructField(t, array(key)) for t in XES_TAGS]

    flat = [T.StructField(tag, array(key, value)) for tag in XES_TAGS]
    several = array(key, T.StructField("values", T.StructType(flat)), *flat)
    return [*[T.StructField(tag, array(key, value, *inner(tag))) for tag in XES_TAGS], T.StructField(LIST, several)]


def _trace_schema(opened: frozenset[TagPath]) -> T.StructType:
    own = _elements(opened)
    return T.StructType([*own, T.StructField("event", T.ArrayType(T.StructType(own))), T.StructField(CORRUPT, T.StringType())])


def xes_traces(spark: SparkSession, path: str) -> DataFrame:
    """``file, whole, trace``: the text of every trace element, one row each; ``whole`` tells whether its end was found.

    The files are read as text that is parted ahead of each ``<trace``, so Spark splits a plain file of any size into
    tasks like other text. What stands before the first trace of a file is no trace. A packed file is one task, and
    its traces are dealt out before they are parsed. Texts are UTF-8.
    """
    parts = spark.read.option("lineSep", "<trace").text(path).withColumn("file", F.input_file_name())
    parts = parts.where(F.col("value").rlike(r"^[\s/>]"))
    if path.rstrip("/").endswith(".gz"):
        parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    ended = F.regexp_extract("value", r"(?s)^(.*</trace\s*>|[^<>]*/>)", 1)
    return parts.select("file", (ended != "").alias("whole"), F.concat(F.lit("<trace"), F.when(ended != "", ended).otherwise(F.col("value"))).alias("trace"))


def _flat(held, opened: frozenset[TagPath], at: TagPath = (), above: Column | None = None) -> Column:
    """The attributes of one element and those inside them, as an array of ``keys, tag, value``.

    ``held`` gives the array of the elements of a tag. An element that holds others and is not opened adds an entry
    with its path.
    """
    none = F.lit(None).cast("string")

    def keys(a: Column) -> Column:
        return a["_key"] if above is None else F.concat(above, F.lit(INSIDE), a["_key"])

    def entry(key: Column, tag: str, value: Column) -> Column:
        return F.struct(key.alias("keys"), F.lit(tag).alias("tag"), value.alias("value"))

    def several(a: Column) -> Column:
        members = [F.coalesce(group[tag], F.array()) for group in (a["values"], a) for tag in XES_TAGS]
        return F.to_json(F.transform(F.concat(*members), lambda m: m["_value"]))

    def elements(tag: str) -> Column:
        return F.coalesce(held(tag), F.array())

    def typed(tag: str) -> Column:
        return F.transform(elements(tag), lambda a: entry(keys(a), tag, a["_value"]))

    def inside(tag: str) -> Column:
        path = (*at, tag)
        if path in opened:
            return F.flatten(F.transform(elements(tag), lambda a: _flat(lambda t: a[t], opened, path, keys(a))))
        full = F.filter(elements(tag), lambda a: F.coalesce(*[a[t] for t in XES_TAGS]).isNotNull())
        return F.transform(full, lambda a: entry(F.lit(INSIDE.join(path)), _CLOSED, none))

    lists = F.transform(elements(LIST), lambda a: entry(keys(a), LIST, several(a)))
    out = [lists, *[part for tag in XES_TAGS for part in (typed(tag), inside(tag))]]
    return F.filter(F.concat(*out), lambda x: x["keys"].isNotNull())


def _parsed_traces(traces: DataFrame, opened: frozenset[TagPath] = frozenset()) -> DataFrame:
    """``file, attributes, events`` and the corrupt column: flat attributes of each trace and of its events.

    A trace without an end, or one that is not well-formed, keeps its text in the corrupt column.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    rows = traces.withColumn("t", F.from_xml("trace", _trace_schema(opened), options))
    bad = ~F.col("whole") | F.col("t").isNull() | F.col(f"t.{CORRUPT}").isNotNull()
    return rows.select(
        "file",
        F.when(~bad, _flat(lambda tag: F.col(f"t.{tag}"), opened)).alias("attributes"),
        F.when(~bad, F.transform("t.event", lambda e: _flat(lambda tag: e[tag], opened))).alias("events"),
        F.when(bad, F.col("trace")).alias(CORRUPT),
    )


def _kept(rows: DataFrame) -> DataFrame:
    """Parsed rows written once to the shared folder: each further use of a parsed column would parse its trace again."""
    folder = scratch_folder(rows.sparkSession, "traces")
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


@dataclass(frozen=True)
class XesAttributes:
    """The attributes of a log: by keys the tags under which they occur, and the elements that hold others."""

    trace: Mapping[str, frozenset[str]]
    event: Mapping[str, frozenset[str]]
    opened: frozenset[TagPath] = frozenset()


def _holding(traces: DataFrame) -> frozenset[TagPath]:
    """Tags whose elements seem to hold others, by the text alone; a wrong guess costs a pass, no attribute."""
    seen = traces.agg(*[F.max(F.col("trace").rlike(rf"<{tag}\b[^>]*[^/>]>")).alias(tag) for tag in XES_TAGS]).first()
    return frozenset((tag,) for tag in XES_TAGS if seen[tag])


def xes_attributes(traces: DataFrame, tolerant: bool = False) -> tuple[XesAttributes, DataFrame]:
    """Find every attribute of a log in one pass, and in one more for each level of attributes inside others.

    Returns the parsed rows of the last pass as well.

    The pass groups keys and tags, so what reaches the driver is a row per attribute. It counts the traces that do
    not parse as well, and strict reading ends here if there are any.
    """
    opened = _holding(traces)
    while True:
        rows = _kept(_parsed_traces(traces, opened))

        def of(scope: str, entry: Column) -> Column:
            return F.struct(F.lit(scope).alias("scope"), entry["keys"].alias("keys"), entry["tag"].alias("tag"))

        broken = F.array(F.struct(F.lit("bad").alias("scope"), F.lit("").alias("keys"), F.lit("").alias("tag")))
        own = F.transform("attributes", lambda a: of("trace", a))
        inner = F.flatten(F.transform(F.coalesce("events", F.array()), lambda e: F.transform(e, lambda a: of("event", a))))
        each = F.when(col(CORRUPT).isNotNull(), broken).otherwise(F.concat(own, inner))
        found = rows.select("file", F.explode(each).alias("a")).groupBy("a.scope", "a.keys", "a.tag")
        found = found.agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file")).collect()
        bad = [r for r in found if r["scope"] == "bad"]
        if bad and not tolerant:
            raise LogParseError(f"{bad[0]['file']}: rows do not parse; in the whole log {bad[0]['n']}")
        closed = {tuple(r["keys"].split(INSIDE)) for r in found if r["tag"] == _CLOSED}
        if closed:
            opened |= closed
            continue

        def tags(scope: str) -> dict[str, frozenset[str]]:
            own = [r for r in found if r["scope"] == scope]
            return {k: frozenset(r["tag"] for r in own if r["keys"] == k) for k in sorted({r["keys"] for r in own})}

        return XesAttributes(tags("trace"), tags("event"), opened), rows


def attribute_type(tags: frozenset[str]) -> str:
    """The type that holds an attribute's values: its own, double for whole and broken numbers, else text."""
    if tags == {LIST}:
        return "array<string>"
    types = {XES_TAG_TYPES.get(tag, "string") for tag in tags}
    return types.pop() if len(types) == 1 else "double" if types == {"bigint", "double"} else "string"


def _value(entries: Column, keys: str, tags: frozenset[str]) -> Column:
    """The first value of an attribute; one that does not read as its type is null."""
    kind = attribute_type(tags)
    text = F.get(F.filter(entries, lambda a: (a["keys"] == keys) & a["tag"].isin(*tags)), F.lit(0))["value"]
    return F.from_json(text, kind) if tags == {LIST} else text.try_cast(kind)


def _distinct_names(wanted: Sequence[str]) -> list[str]:
    """Column names that differ in more than case; a repeated one gets a number."""
    seen: dict[str, int] = {}
    out = []
    for name in wanted:
        plain, again = name, 1
        while name.lower() in seen:
            again += 1
            name = f"{plain}_{again}"
        seen[name.lower()] = 1
        out.append(name)
    return out


def read_xes(
    spark: SparkSession,
    path: str,
    trace_attributes: Mapping[str, str] | None = None,
    event_attributes: Mapping[str, str] | None = None,
    tolerant: bool = False,
) -> LoadedLog:
    """XES traces to event rows with all their attributes; those of the trace get the prefix ``case:``.

    The attributes are found in a first pass, with their types (see ``attribute_type``). Attributes inside others
    are named by both keys (``outer/inner``), lists arrive as arrays of text. The standard keys are always there.
    Where the attribute maps are given (keys to "string", "date", "int", "float", "boolean"), only those and the
    standard ones are read, without that pass. Names that differ in case only get a number.

    Each trace is a row of its own text: one that is not well-formed, or that the file cuts off, is one reject in
    tolerant mode and a ``LogParseError`` in strict mode. A trace must fit a row.
    """
    traces = xes_traces(spark, path)
    if trace_attributes is None and event_attributes is None:
        found, rows = xes_attributes(traces, tolerant)
    else:

        def named(wanted: Mapping[str, str] | None) -> dict[str, frozenset[str]]:
            return {key: frozenset([tag]) for key, tag in (wanted or {}).items()}

        opened: frozenset[TagPath] = frozenset()
        if any(INSIDE in key for key in (*(trace_attributes or {}), *(event_attributes or {}))):
            every, rows = xes_attributes(traces, tolerant)
            opened = every.opened
        else:
            rows = _kept(_parsed_traces(traces))
            checked(rows, tolerant=tolerant)
        found = XesAttributes(named(trace_attributes), named(event_attributes), opened)

    def all_of(standard: Mapping[str, str], more: Mapping[str, frozenset[str]]) -> dict[str, frozenset[str]]:
        return {**{key: frozenset([tag]) for key, tag in standard.items()}, **more}

    of_trace, of_event = all_of(STANDARD_TRACE, found.trace), all_of(STANDARD_EVENT, found.event)
    names = _distinct_names([*[f"case:{key}" for key in of_trace], "event_index", *of_event])
    case = [_value(F.col("attributes"), key, tags).alias(f"_{i}") for i, (key, tags) in enumerate(of_trace.items())]
    events = rows.where(col(CORRUPT).isNull()).select(*case, F.posexplode("events").alias("_index", "_event"))
    columns = [*[F.col(f"_{i}") for i in range(len(of_trace))], F.col("_index")]
    columns += [_value(F.col("_event"), key, tags) for key, tags in of_event.items()]
    rejects = rows.where(col(CORRUPT).isNotNull()).select(CORRUPT) if tolerant else None
    return LoadedLog(events.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)]), rejects)
