import itertools
import random

import pytest

from tests.logs import GOLDEN, golden_log
from tracewell.log import EventLog
from tracewell.operators.components import component_labels
from tracewell.operators.pairs import maximal_pairs
from tracewell.plans import discovery


def graph_frame(spark, edges):
    return spark.createDataFrame(sorted(edges), "src string, dst string")


def brute_pairs(edges):
    """All pairs of sets, the maximal ones kept."""
    names = sorted({x for e in edges for x in e if (x, x) not in edges})
    subsets = [frozenset(c) for k in range(1, len(names) + 1) for c in itertools.combinations(names, k)]

    def apart(group):
        return all((x, y) not in edges and (y, x) not in edges for x in group for y in group)

    def causes(a, b):
        return all((x, y) in edges and (y, x) not in edges for x in a for y in b)

    free = [s for s in subsets if apart(s)]
    found = [(a, b) for a in free for b in free if causes(a, b)]
    return {(tuple(sorted(a)), tuple(sorted(b))) for a, b in found if not any((a <= c and b <= d) and (a, b) != (c, d) for c, d in found)}


@pytest.mark.parametrize("seed", range(6))
def test_maximal_pairs_equal_all_pairs_of_sets(spark, seed):
    rng = random.Random(seed)
    names = "abcdefg"
    edges = {(x, y) for x in names for y in names if rng.random() < (0.04 if x == y else 0.3)} | {("a", "b")}
    found = {(tuple(r["a_set"]), tuple(r["b_set"])) for r in maximal_pairs(graph_frame(spark, edges)).collect()}
    assert found == brute_pairs(edges)


def test_large_sets_in_a_large_alphabet(spark):
    """Forty causes of forty effects are one pair; listing its subsets would never end."""
    edges = {(f"a{i:02d}", f"b{j:02d}") for i in range(40) for j in range(40)} | {(f"x{k:03d}", f"x{k + 1:03d}") for k in range(300)}
    found = {(len(r["a_set"]), len(r["b_set"])) for r in maximal_pairs(graph_frame(spark, edges)).collect()}
    assert found == {(40, 40), (1, 1)}


def test_too_many_pairs_are_an_error(spark):
    # Twelve couples of causes that exclude each other: 2 ** 12 pairs.
    edges = {(f"a{k}{s}", "z") for k in range(12) for s in "pq"} | {(f"a{k}p", f"a{k}q") for k in range(12)} | {(f"a{k}q", f"a{k}p") for k in range(12)}
    assert maximal_pairs(graph_frame(spark, edges)).count() == 2**12
    with pytest.raises(Exception, match="more than 1000 pairs"):
        maximal_pairs(graph_frame(spark, edges), max_pairs=1000).collect()


def test_empty_log(spark):
    log = golden_log(spark)
    net = discovery.alpha_net(log.with_events(log.events.where("false")))
    assert sorted(r["place"] for r in net.places.collect()) == ["end", "start"] and net.arcs.count() == 0
    net = discovery.heuristics_net(log.with_events(log.events.where("false")))
    assert net.places.count() == net.arcs.count() == 0


ODD = {"a": "START", "b": "a,b", "c": "fork:x", "d": "END", "e": "start"}


def renamed_log(spark, names):
    rows = [(case, names[x], k) for case, trace, _ in GOLDEN for k, x in enumerate(trace)]
    return EventLog(spark.createDataFrame(rows, "case_id string, activity string, ts long"), ("ts",))


def shape(net, names):
    """A net with activities under neutral names: how its labelled transitions hang together through places."""
    labels = {r["transition"]: r["label"] for r in net.transitions.collect()}
    back = {v: k for k, v in names.items()}
    into, out = {}, {}
    for source, target, kind in ((r["source"], r["target"], r["source_kind"]) for r in net.arcs.collect()):
        place, transition = (source, target) if kind == "place" else (target, source)
        label = back.get(labels[transition], "hidden")
        (out if kind == "place" else into).setdefault(place, []).append(label)
    places = {r["place"]: r["marking"] for r in net.places.collect()}
    return sorted((str(m), sorted(into.get(p, [])), sorted(out.get(p, []))) for p, m in places.items()), len(labels)


@pytest.mark.parametrize("build", [discovery.alpha_net, discovery.heuristics_net])
def test_activities_may_be_called_anything(spark, build):
    """Names that the nets use themselves give the same structure as neutral ones."""
    neutral = {x: x for x in "abcde"}
    want = shape(build(renamed_log(spark, neutral)), neutral)
    for odd in (ODD, {"a": "source", "b": "{x}->{y}", "c": "step:a->b", "d": "activity:z", "e": "a\\:b"}):
        net = build(renamed_log(spark, odd))
        assert shape(net, odd) == want
        for table, key in ((net.places, "place"), (net.transitions, "transition")):
            names = [r[key] for r in table.collect()]
            assert len(names) == len(set(names))


def test_start_and_end_as_activities_keep_their_parallel_branches(spark):
    rows = [(c, x, k) for c in range(6) for k, x in enumerate(["B", "x", "y", "F"] if c % 2 else ["B", "y", "x", "F"])]
    log = spark.createDataFrame(rows, "case_id int, activity string, ts int")
    sizes = []
    for first, last in (("BEGIN", "FIN"), ("START", "END"), ("start", "end")):
        events = log.replace({"B": first, "F": last}, subset=["activity"])
        net = discovery.heuristics_net(EventLog(events, ("ts",)))
        sizes.append((net.places.count(), net.transitions.count(), net.arcs.count()))
    assert sizes[0] == sizes[1] == sizes[2] and sizes[0][0] >= 4


def test_self_loops_and_loops_of_two(spark):
    traces = ["abbbc", "abc", "adedec", "adec"] * 5
    rows = [(str(k), x, i) for k, t in enumerate(traces) for i, x in enumerate(t)]
    net = discovery.heuristics_net(EventLog(spark.createDataFrame(rows, "case_id string, activity string, ts int"), ("ts",)))
    arcs = {(r["source"], r["target"]) for r in net.arcs.collect()}
    assert {r["label"] for r in net.transitions.collect() if r["label"]} == set("abcde")
    reach = {x: {t2 for s, p in arcs if s == x for p2, t2 in arcs if p2 == p} for x in "bde"}
    hidden = {t for t in reach["b"] if ":" in t}
    assert "b" in reach["b"] or any("b" in {t2 for s, p in arcs if s == h for p2, t2 in arcs if p2 == p} for h in hidden)


def test_components_of_a_long_chain(spark):
    rng = random.Random(2)
    edges = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(60)] + [("z1", "z2"), ("z2", "z0")]
    rng.shuffle(edges)
    found = {r["node"]: r["label"] for r in component_labels(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert len(found) == 64 and {v for k, v in found.items() if k[0] == "n"} == {"n000"} and found["z1"] == "z0"
