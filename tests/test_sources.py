import gzip

import pytest
from pyspark.sql import functions as F

from tests.logs import golden_log, golden_rows
from tracewell.log import EventLog, standardise
from tracewell.operators.relations import directly_follows
from tracewell.plans.prediction import TransitionModel, score_cases, train, training_samples
from tracewell.plans.training import run_training
from tracewell.sources import catalogue, readers, sinks

XES = """<?xml version="1.0" encoding="UTF-8"?>
<log xes.version="1.0">
  <string key="concept:name" value="a log"/>
  <trace>
    <string key="concept:name" value="1"/>
    <int key="amount" value="7"/>
    <event><string key="concept:name" value="a"/><date key="time:timestamp" value="2015-02-10T00:00:00.000+01:00"/>
      <float key="cost" value="1.5"/><boolean key="ok" value="true"/></event>
    <event><string key="concept:name" value="b"/><date key="time:timestamp" value="2015-02-11T00:00:00.000+01:00"/></event>
  </trace>
  <trace>
    <string key="concept:name" value="2"/>
    <event><string key="concept:name" value="a"/><date key="time:timestamp" value="2015-02-12T00:00:00.000+01:00"/></event>
  </trace>
</log>
"""


def test_csv_with_dotted_dates(spark, tmp_path):
    lines = ["case:concept:name,concept:name,time:timestamp"]
    lines += [f"{c},{a},{t[:10].replace('-', '.')}" for c, a, t in golden_rows()]
    path = tmp_path / "a.b.csv"
    path.write_text("\n".join(lines) + "\n")
    loaded = readers.load_log(spark, str(path), timestamp_formats={"time:timestamp": ["yyyy.MM.dd"]})
    log = EventLog(standardise(loaded.events))
    assert sorted(directly_follows(log).collect()) == sorted(directly_follows(golden_log(spark)).collect())


def test_xes(spark, tmp_path):
    plain, packed = tmp_path / "log.xes", tmp_path / "log2.xes.gz"
    plain.write_text(XES)
    packed.write_bytes(gzip.compress(XES.encode()))
    for path in (plain, packed):
        loaded = readers.load_log(
            spark, str(path), trace_attributes={"amount": "int"}, event_attributes={"cost": "float", "ok": "boolean"}
        )
        rows = standardise(loaded.events).orderBy("case_id", "event_index").collect()
        assert [(r["case_id"], r["case:amount"], r["activity"], r["cost"], r["ok"]) for r in rows] == [
            ("1", 7, "a", 1.5, True), ("1", 7, "b", None, None), ("2", None, "a", None, None),
        ]
        stamps = standardise(loaded.events).select(F.unix_micros("ts").alias("t")).orderBy("t").collect()
        assert stamps[0]["t"] == 1423522800 * 10**6


def test_format_errors(spark, tmp_path):
    with pytest.raises(readers.LogFormatError):
        readers.load_log(spark, str(tmp_path / "log.txt"))
    with pytest.raises(readers.LogNotFoundError):
        readers.load_log(spark, str(tmp_path / "none.parquet"))
    with pytest.raises(ValueError):
        readers.load_log(spark, "x.csv", mode="hopeful")


def test_strict_and_tolerant(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("id,name\n1,a\nx,b\n3,c\n")
    schema = "id int, name string"
    with pytest.raises(readers.LogParseError, match="rows do not parse"):
        readers.load_log(spark, str(path), schema=schema).events.collect()
    loaded = readers.load_log(spark, str(path), mode="tolerant", schema=schema)
    assert sorted(r["id"] for r in loaded.events.collect()) == [1, 3]
    assert sorted(r["name"] for r in loaded.events.select("name").collect()) == ["a", "c"]
    assert [r[0] for r in loaded.rejects.collect()] == ["x,b"]


def test_malformed_xes_is_set_aside(spark, tmp_path):
    """A trace that is not well-formed is one reject; all other traces of the file and of the folder are read."""
    folder = tmp_path / "logs.xes"
    folder.mkdir()
    (folder / "good.xes").write_text(XES)
    (folder / "bad.xes").write_text(XES.replace('<int key="amount" value="7"/>', '<int key="amount" value="7">'))
    (folder / "cut.xes").write_text(XES[: XES.index("<event>", XES.index('value="2"'))])
    loaded = readers.load_log(spark, str(folder), mode="tolerant")
    assert loaded.events.count() == 3 + 1 + 2
    rejects = sorted(r[0] for r in loaded.rejects.collect())
    assert len(rejects) == 2 and all(r.startswith("<trace>") for r in rejects)
    for named in (None, {"amount": "int"}):
        with pytest.raises(readers.LogParseError, match="rows do not parse; in the whole log 2"):
            readers.load_log(spark, str(folder), trace_attributes=named)


NESTED = """<?xml version='1.0'?>
<log><global scope="trace"><string key="concept:name" value="x"/></global>
<trace ><string key="concept:name" value="1"><date key="since" value="2020-01-01T00:00:00Z"/></string>
  <float key="Cost" value="2"/><list key="tags"><values><string key="t" value="u&amp;v"/><int key="t" value="3"/></values></list>
  <event><string value="a" key="concept:name"/><int key="cost" value="1"/><boolean key="mixed" value="true"/>
    <string key="outer" value="o"><int key="in" value="5"><id key="deep" value="d"/></int></string></event>
  <event><string key="concept:name" value="b"/><float key="cost" value="1.5"/><int key="mixed" value="7"/></event></trace >
<trace/><trace><string key="concept:name" value="2"/></trace>
<trace><event><string key="concept:name" value="c &lt;/trace&gt;"/><int key="cost" value="many"/></event></trace></log>
"""


def test_every_xes_attribute_arrives_with_its_type(spark, tmp_path):
    (tmp_path / "n.xes").write_text(NESTED)
    events = readers.load_log(spark, str(tmp_path / "n.xes")).events
    assert dict(events.dtypes) == {
        "case:concept:name": "string", "case:concept:name/since": "timestamp", "case:Cost": "double", "case:tags": "array<string>", "event_index": "int",
        "concept:name": "string", "time:timestamp": "timestamp", "org:resource": "string", "lifecycle:transition": "string",
        "cost": "double", "mixed": "string", "outer": "string", "outer/in": "bigint", "outer/in/deep": "string",
    }
    rows = [r.asDict() for r in events.orderBy("concept:name").collect()]
    assert [(r["case:concept:name"], r["event_index"], r["concept:name"], r["cost"], r["mixed"]) for r in rows] == [
        ("1", 0, "a", 1.0, "true"), ("1", 1, "b", 1.5, "7"), (None, 0, "c </trace>", None, None)]
    assert (rows[0]["outer"], rows[0]["outer/in"], rows[0]["outer/in/deep"], rows[1]["outer/in"]) == ("o", 5, "d", None)
    assert rows[0]["case:tags"] == ["u&v", "3"] and rows[0]["case:Cost"] == 2.0 and rows[0]["case:concept:name/since"].year == 2020


def test_names_that_differ_in_case_only(spark, tmp_path):
    text = XES.replace('<float key="cost" value="1.5"/>', '<float key="cost" value="1.5"/><int key="Cost" value="9"/><int key="Event_Index" value="4"/>')
    (tmp_path / "c.xes").write_text(text)
    events = readers.load_log(spark, str(tmp_path / "c.xes")).events
    assert [c for c in events.columns if c.lower().startswith(("cost", "event_i"))] == ["event_index", "Cost", "Event_Index_2", "cost_2"]
    assert events.where("cost = 9 AND cost_2 = 1.5 AND Event_Index_2 = 4").count() == 1


def test_a_trace_is_not_parsed_again_for_each_use(spark, tmp_path):
    (tmp_path / "n.xes").write_text(NESTED)
    for named in (None, {"cost": "float"}):
        loaded = readers.load_log(spark, str(tmp_path / "n.xes"), mode="tolerant", event_attributes=named)
        for rows in (loaded.events, loaded.rejects):
            assert "from_xml" not in rows._jdf.queryExecution().toString()


def test_a_plain_xes_file_is_read_in_several_tasks(spark, tmp_path):
    trace = XES[XES.index("<trace>") : XES.index("</trace>") + 8]
    (tmp_path / "big.xes").write_text("<log>\n" + "\n".join(trace.replace('value="1"', f'value="{k}"') for k in range(3000)) + "\n</log>")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        traces = readers.xes_traces(spark, str(tmp_path / "big.xes"))
        assert traces.rdd.getNumPartitions() > 5
        events = readers.load_log(spark, str(tmp_path / "big.xes")).events
        assert (events.count(), events.select("case:concept:name").distinct().count()) == (6000, 3000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_times_of_a_csv_are_found(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        "a,b,c,d,e,f,g\n2015.02.10,2015-02-10T08:00:00.5+01:00,10/02/2015,1.2.3,2015-01-01,,31/12/2015 10:00\n"
        "2015.02.11,2015-02-10 09:00:00Z,02/10/2015,x,2015-01-01 10:00:00,,1/2/2015 7:00\n"
        "2015.02.12,,13/13/2015,y,no,,30/12/2015 11:30\n"
    )
    loaded = readers.load_log(spark, str(path)).events
    kinds = dict(loaded.dtypes)
    assert {k for k, v in kinds.items() if v == "timestamp_ntz"} == {"a", "b"}
    rows = loaded.orderBy("a").collect()
    assert str(rows[0]["a"]) == "2015-02-10 00:00:00" and str(rows[0]["b"]) == "2015-02-10 07:00:00.500000" and rows[2]["b"] is None
    assert dict(readers.load_log(spark, str(path), timestamp_formats={}).events.dtypes)["a"] == "string"
    assert dict(readers.load_log(spark, str(path), mode="tolerant").events.dtypes)["a"] == "timestamp_ntz"


def test_training_reads_the_golden_csv(spark, tmp_path):
    """The command line trains on a log with dotted dates; nothing says which column holds times."""
    from tracewell.plans import training

    lines = ["case:concept:name,concept:name,time:timestamp"] + [f"{c},{a},{t[:10].replace('-', '.')}" for c, a, t in golden_rows()]
    (tmp_path / "log.csv").write_text("\n".join(lines) + "\n")
    training.main([str(tmp_path / "log.csv"), str(tmp_path / "run"), "--phase", "buckets"])
    (record,) = spark.read.parquet(str(tmp_path / "run" / "records")).collect()
    assert (record["cases"], record["events"], record["activities"]) == (6, 23, 5)
    hours = {r["hours"] for r in TransitionModel.load(spark, str(tmp_path / "run" / "buckets")).states.select("hours").collect()}
    assert max(hours) <= 96


def test_folder_inventory(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "A.CSV").write_bytes(b"12345")
    (tmp_path / "notes").write_bytes(b"1")
    (tmp_path / "nothing %20here.csv").write_bytes(b"")
    files = catalogue.with_file_facts(catalogue.validate(catalogue.scan_folder(spark, str(tmp_path))))
    rows = {r["original_name"]: r for r in files.collect()}
    assert (rows["A.CSV"]["extension"], rows["A.CSV"]["accepted"], rows["A.CSV"]["size_bytes"]) == ("csv", True, 5)
    empty = rows["nothing %20here.csv"]
    assert (empty["size_bytes"], empty["extension"]) == (0, "csv") and empty["uploaded_at"].year >= 2020 and len(rows) == 3
    assert (rows["notes"]["extension"], rows["notes"]["reason"]) == ("", "unsupported extension")
    scan = catalogue.scan_folder(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in scan


def test_upload_limits(spark):
    rows = spark.createDataFrame(
        [("a.csv", 50 * 1024 * 1024), ("b.csv", 50 * 1024 * 1024 + 1), ("c.xes.gz", 1), ("d.xes", None)],
        "original_name string, size_bytes bigint",
    )
    found = {r["original_name"]: r["reason"] for r in catalogue.validate(rows).collect()}
    assert found == {"a.csv": None, "b.csv": "file too large", "c.xes.gz": "unsupported extension", "d.xes": None}


def test_unknown_sort_key_means_newest_first(spark):
    rows = spark.createDataFrame(
        [("a", 1, "2024-01-01"), ("b", 2, "2024-01-03"), ("c", 3, "2024-01-02")], "path string, size_bytes int, uploaded_at string"
    )
    assert [r["path"] for r in catalogue.sort_files(rows, "colour", "sideways").collect()] == ["b", "c", "a"]


def test_model_tables_survive_saving(spark, tmp_path):
    log = golden_log(spark)
    model = train(training_samples(log))
    model.save(str(tmp_path / "m"))
    again = TransitionModel.load(spark, str(tmp_path / "m"))
    assert sorted(map(str, score_cases(log, model).collect())) == sorted(map(str, score_cases(log, again).collect()))


def test_predictions_export(spark, tmp_path):
    log = golden_log(spark)
    target = str(tmp_path / "out")
    sinks.export_predictions(score_cases(log, train(training_samples(log))), target)
    back = spark.read.option("header", True).csv(target)
    assert back.count() == 6
    assert {"next_activity_activity", "remaining_time_hours", "outcome_prediction"} <= set(back.columns)


def test_training_job(spark, tmp_path):
    from tests.logs import skewed_log

    log = skewed_log(spark, 1500)
    run = run_training(log, str(tmp_path / "run"), "both", trees=3)
    assert set(run.outcome.accuracies) == {"decision_tree", "logistic_regression", "random_forest"}
    assert run.bucket_scores.count() > 3
    record = spark.read.parquet(str(tmp_path / "run" / "records")).collect()[0]
    assert (record["events"], record["activities"], record["vocabulary_size"]) == (1500, 4, 6)
    sinks.load_model(str(tmp_path / "run" / "outcome"))
    assert run_training(log, phase="buckets").outcome is None
