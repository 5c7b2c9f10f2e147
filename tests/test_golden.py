from pyspark.sql import functions as F

from tests.logs import golden_log
from tracewell.operators import relations, traces
from tracewell.operators.prefixes import prefixes_inclusive, prefixes_next
from tracewell.plans import discovery


def pairs(df, *columns):
    return {tuple(row) for row in df.select(*columns).collect()}


def test_directly_follows_and_boundaries(spark):
    log = golden_log(spark)
    assert pairs(relations.directly_follows(log), "src", "dst", "freq") == {
        ("a", "b", 3), ("a", "c", 2), ("a", "e", 1), ("b", "c", 3), ("b", "d", 2), ("c", "b", 2), ("c", "d", 3), ("e", "d", 1),
    }
    assert pairs(relations.boundary_activities(log), "boundary", "activity", "cases") == {("start", "a", 6), ("end", "d", 6)}


def test_footprint(spark):
    log = golden_log(spark)
    found = relations.footprint(relations.directly_follows(log), log.events)
    by_kind = {k: pairs(found.where(F.col("relation") == k), "src", "dst") for k in ("causal", "parallel", "unrelated")}
    assert by_kind["causal"] == {("a", "b"), ("a", "c"), ("a", "e"), ("b", "d"), ("c", "d"), ("e", "d")}
    assert by_kind["parallel"] == {("b", "c"), ("c", "b")}
    assert len(by_kind["unrelated"]) == 25 - 6 - 6 - 2


def test_alpha_net(spark):
    net = discovery.alpha_net(golden_log(spark))
    places = {row["place"]: row["marking"] for row in net.places.collect()}
    assert places == {
        "start": "initial", "end": "final", "{a}->{b,e}": None, "{a}->{c,e}": None, "{b,e}->{d}": None, "{c,e}->{d}": None,
    }
    assert pairs(net.transitions, "transition") == {(x,) for x in "abcde"}
    arcs = pairs(net.arcs, "source", "target")
    assert len(arcs) == 14
    assert {("start", "a"), ("d", "end"), ("a", "{a}->{b,e}"), ("{b,e}->{d}", "d"), ("e", "{c,e}->{d}")} <= arcs


def test_dependencies_and_branches(spark):
    log = golden_log(spark)
    graph = relations.directly_follows(log)
    edges = relations.dependencies(graph, relations.loops_of_two(log))
    values = {(r["src"], r["dst"]): round(r["dependency"], 4) for r in edges.collect()}
    assert values == {
        ("a", "b"): 0.75, ("a", "c"): 0.6667, ("a", "e"): 0.5, ("b", "c"): 0.1667, ("c", "b"): -0.1667,
        ("b", "d"): 0.6667, ("c", "d"): 0.75, ("e", "d"): 0.5,
    }
    found = relations.branch_relations(edges, graph)
    assert pairs(found, "side", "activity", "left", "right", "relation") == {
        ("split", "a", "b", "c", "AND"), ("split", "a", "b", "e", "XOR"), ("split", "a", "c", "e", "XOR"),
        ("join", "d", "b", "c", "AND"), ("join", "d", "b", "e", "XOR"), ("join", "d", "c", "e", "XOR"),
    }


def test_heuristics_net_structure(spark):
    net = discovery.heuristics_net(golden_log(spark))
    assert net.places.count() == 8
    assert net.transitions.count() == 7
    assert net.transitions.where("label IS NULL").count() == 2
    arcs = pairs(net.arcs, "source", "target")
    assert len(arcs) == 16
    assert {("source", "a"), ("a", "out:a"), ("out:a", "e"), ("out:a", "fork:a:b"), ("e", "in:d"), ("merge:d:b", "in:d"),
            ("in:d", "d"), ("d", "sink")} <= arcs


def test_prefixes_of_case_6(spark):
    log = golden_log(spark)
    rows = prefixes_next(log).where("case_id = '6'").orderBy("prefix_length").collect()
    assert [(r["prefix_activities"], r["label_next_activity"], r["remaining_time"]) for r in rows] == [
        (["a"], "e", 48.0), (["a", "e"], "d", 24.0),
    ]
    rows = prefixes_inclusive(log).where("case_id = '6'").orderBy("prefix_length").collect()
    assert [(r["prefix_length"], r["elapsed_seconds"]) for r in rows] == [(1, 0.0), (2, 86400.0), (3, 172800.0)]


def test_case_lookup_by_list_and_by_table(spark):
    log = golden_log(spark)
    listed = traces.case_lookup(log, ["6", "9"]).collect()
    assert [(r["case_id"], r["activities"]) for r in listed] == [("6", ["a", "e", "d"])]
    wanted = spark.createDataFrame([("4",), ("4",)], "case_id string")
    assert [r["activities"] for r in traces.case_lookup(log, wanted).collect()] == [["a", "c", "b", "d"]]
