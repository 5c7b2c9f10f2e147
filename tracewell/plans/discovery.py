"""Process models from the activity relations: the alpha net and the heuristics net, as tables.

Both start from the directly-follows graph, which is small; everything here has at most a row per pair
of activities, per candidate place or per arc. Nodes are keyed by their kind and name while a net is built, and names
are escaped where they become part of a longer one, so activities may be called anything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.log import EventLog
from tracewell.operators.components import component_labels
from tracewell.operators.lookup import settled
from tracewell.operators.pairs import MAX_PAIRS, maximal_pairs
from tracewell.operators.relations import (
    boundaries_of,
    branch_relations,
    dependencies,
    graph_of,
    loops_of,
    relation_counts,
)


@dataclass(frozen=True)
class PetriNet:
    """``places`` (place, marking), ``transitions`` (transition, label) and ``arcs`` (source, target, source_kind).

    ``marking`` is "initial", "final" or null; a null label marks an invisible transition. Places and transitions
    have names of their own: ``source_kind`` ("place" or "transition") tells which of the two an arc begins at.
    """

    places: DataFrame
    transitions: DataFrame
    arcs: DataFrame


def escaped(name: Column) -> Column:
    """A name as part of a longer one: what has a meaning there gets a backslash."""
    return F.regexp_replace(name, r"([\\,{}:]|->)", r"\\$1")


def alpha_net(log: EventLog, max_pairs: int = MAX_PAIRS) -> PetriNet:
    counts = settled(relation_counts(log))
    return alpha_net_of(settled(graph_of(counts)), boundaries_of(counts), max_pairs)


def activities_of(graph: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Every activity of the log starts a case, ends one or stands on an edge."""
    named = boundaries.select("activity")
    return named.union(graph.select("src")).union(graph.select("dst")).distinct()


def alpha_net_of(graph: DataFrame, boundaries: DataFrame, max_pairs: int = MAX_PAIRS) -> PetriNet:
    """A place for each maximal pair, named ``{a,b}->{c}``, and the places ``start`` and ``end``."""

    def names(members: str) -> Column:
        return F.concat(F.lit("{"), F.array_join(F.transform(members, escaped), ","), F.lit("}"))

    def arcs(frame: DataFrame, source: Column, target: Column, kind: str) -> DataFrame:
        return frame.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("source_kind"))

    pairs = maximal_pairs(graph, max_pairs).withColumn("place", F.concat_ws("->", names("a_set"), names("b_set")))
    spark = graph.sparkSession
    marked = spark.createDataFrame([("start", "initial"), ("end", "final")], "place string, marking string")
    places = marked.unionByName(pairs.select("place", F.lit(None).cast("string").alias("marking")))
    transitions = activities_of(graph, boundaries).select(F.col("activity").alias("transition"), F.col("activity").alias("label"))
    place, activity = F.col("place"), F.col("activity")
    inside = arcs(pairs, F.explode("a_set"), place, "transition").unionByName(arcs(pairs, place, F.explode("b_set"), "place"))
    starts = arcs(boundaries.where("boundary = 'start'"), F.lit("start"), activity, "place")
    ends = arcs(boundaries.where("boundary = 'end'"), activity, F.lit("end"), "transition")
    return PetriNet(places, transitions, inside.unionByName(starts).unionByName(ends))


# The process start and end stand beside the activities as nodes of their own kind.
START, END, ACTIVITY = "start", "end", "activity"


def _node(kind: str, name: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit("") if name is None else name).alias("name"))


def _bindings(edges: DataFrame, branches: DataFrame, side: str) -> DataFrame:
    """Per edge the binding its branch belongs to at one end, and how that end is wired.

    Branches joined by AND form one binding (connected by any chain of AND pairs); bindings exclude
    each other. ``wiring`` is "direct" when the activity has one binding, else "one" for a binding of
    one branch and "many" for a larger one. ``binding`` names a binding by its first branch.
    """
    here, there = ("src", "dst") if side == "split" else ("dst", "src")
    both = branches.where((F.col("side") == side) & (F.col("relation") == "AND"))
    pairs = both.select(
        F.struct(F.col("activity").alias("at"), F.col("left").alias("branch")).alias("a"),
        F.struct(F.col("activity").alias("at"), F.col("right").alias("branch")).alias("b"),
    )
    labels = component_labels(pairs).select(
        _node(ACTIVITY, F.col("node.at")).alias(here), _node(ACTIVITY, F.col("node.branch")).alias(there), F.col("label.branch").alias("label")
    )
    found = edges.join(labels, [here, there], "left").withColumn("binding", F.coalesce("label", F.col(f"{there}.name")))
    sizes = found.groupBy(here, "binding").agg(F.count(F.lit(1)).alias("size"))
    groups = sizes.groupBy(here).agg(F.count(F.lit(1)).alias("groups"))
    wiring = F.when(F.col("groups") == 1, "direct").when(F.col("size") == 1, "one").otherwise("many")
    end = "out" if side == "split" else "in"
    return found.join(sizes, [here, "binding"]).join(groups, here).select(
        "src", "dst", F.col("binding").alias(f"{end}_binding"), wiring.alias(f"{end}_wiring")
    )


def heuristics_net(
    log: EventLog, threshold: float = 0.5, loop_threshold: float = 0.5, and_threshold: float = 0.65
) -> PetriNet:
    counts = settled(relation_counts(log))
    graph = graph_of(counts)
    edges = settled(dependencies(graph, loops_of(counts), threshold, loop_threshold))
    branches = branch_relations(edges, graph, and_threshold)
    return heuristics_net_of(edges, branches, boundaries_of(counts))


# Beginnings of the names of invisible transitions; an activity called so gets a beginning of its own.
_HIDDEN = "fork|merge|step"


def _transition(name: Column) -> Column:
    return F.when(name.rlike(f"^({_HIDDEN}|{ACTIVITY}):"), F.concat(F.lit(f"{ACTIVITY}:"), name)).otherwise(name)


def heuristics_net_of(edges: DataFrame, branches: DataFrame, boundaries: DataFrame) -> PetriNet:
    """Wire kept edges into a net.

    An activity with one output binding marks the edge places itself. With several it marks a choice
    place, from which a binding of one branch is read directly and a larger one through an invisible
    fork; inputs mirror this. The process start and end are one more branch of the activities they touch.
    """
    activity = _node(ACTIVITY, F.col("activity"))
    kept = edges.where("kept").select(_node(ACTIVITY, F.col("src")).alias("src"), _node(ACTIVITY, F.col("dst")).alias("dst"))
    starts = boundaries.where("boundary = 'start'").select(_node(START).alias("src"), activity.alias("dst"))
    ends = boundaries.where("boundary = 'end'").select(activity.alias("src"), _node(END).alias("dst"))
    every = settled(kept.unionByName(starts).unionByName(ends))
    branches = settled(branches)
    wired = every.join(_bindings(every, branches, "split"), ["src", "dst"]).join(
        _bindings(every, branches, "join"), ["src", "dst"]
    )
    # The start is a choice among the start activities and the end a merge, even with one of them.
    is_start, is_end = F.col("src.kind") == START, F.col("dst.kind") == END
    src, dst = F.col("src.name"), F.col("dst.name")
    out_wiring = F.when(is_start, "one").otherwise(F.col("out_wiring"))
    in_wiring = F.when(is_end, "one").otherwise(F.col("in_wiring"))

    def named(kind: str, *parts: Column) -> Column:
        return F.concat(F.lit(f"{kind}:"), *parts)

    out_place = F.when(is_start, F.lit("source")).otherwise(named("out", escaped(src)))
    in_place = F.when(is_end, F.lit("sink")).otherwise(named("in", escaped(dst)))
    first = F.when(is_start, F.lit("{start}")).otherwise(escaped(src))
    between = (first, F.lit("->"), F.when(is_end, F.lit("{end}")).otherwise(escaped(dst)))
    edge_place, step = named("edge", *between), named("step", *between)
    fork = named("fork", escaped(src), F.lit(":"), escaped(F.col("out_binding")))
    merge = named("merge", escaped(dst), F.lit(":"), escaped(F.col("in_binding")))
    none = F.lit(None).cast("string")

    def arc(condition: Column, place: Column, transition: Column, label: Column, source_kind: str) -> Column:
        return F.when(
            condition, F.struct(place.alias("place"), transition.alias("transition"), label.alias("label"), F.lit(source_kind).alias("source_kind"))
        )

    def into(condition: Column, transition: Column, label: Column, place: Column) -> Column:
        return arc(condition, place, transition, label, "transition")

    def out_of(condition: Column, place: Column, transition: Column, label: Column) -> Column:
        return arc(condition, place, transition, label, "place")

    out_one, out_many, out_direct = out_wiring == "one", out_wiring == "many", out_wiring == "direct"
    in_one, in_many, in_direct = in_wiring == "one", in_wiring == "many", in_wiring == "direct"
    consumer = (F.when(in_direct, _transition(dst)).otherwise(merge), F.when(in_direct, dst))
    producer = (F.when(out_direct, _transition(src)).otherwise(fork), F.when(out_direct, src))
    through = ~out_one & ~in_one
    arcs = F.array(
        # the activity's own choice and merge places
        into((out_one | out_many) & ~is_start, _transition(src), src, out_place),
        out_of((in_one | in_many) & ~is_end, in_place, _transition(dst), dst),
        # invisible fork and merge
        out_of(out_many, out_place, fork, none),
        into(in_many, merge, none, in_place),
        # one branch on both ends: an invisible step between the two places
        out_of(out_one & in_one, out_place, step, none),
        into(out_one & in_one, step, none, in_place),
        # one branch on one end
        out_of(out_one & ~in_one, out_place, *consumer),
        into(~out_one & in_one, *producer, in_place),
        # an edge place of its own
        into(through, *producer, edge_place),
        out_of(through, edge_place, *consumer),
    )
    flat = settled(wired.select(F.explode(arcs).alias("arc")).where("arc IS NOT NULL").select("arc.*").distinct())
    marking = F.when(F.col("place") == "source", "initial").when(F.col("place") == "sink", "final")
    from_place = F.col("source_kind") == "place"
    return PetriNet(
        places=flat.select("place", marking.alias("marking")).distinct(),
        transitions=flat.select("transition", "label").distinct(),
        arcs=flat.select(
            F.when(from_place, F.col("place")).otherwise(F.col("transition")).alias("source"),
            F.when(from_place, F.col("transition")).otherwise(F.col("place")).alias("target"),
            "source_kind",
        ),
    )
