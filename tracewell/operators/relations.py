"""Relations between activities: the one shuffle that turns a log into a small graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.log import EventLog
from tracewell.operators.ordering import ordered_cases


def _followers(log: EventLog, reach: int) -> DataFrame:
    cases = ordered_cases(log, after=reach)
    carried = ["_home", "_chunk", "_position", "_length"] if cases.split else []
    ahead = [F.lead("activity", i).over(cases.window).alias(f"next{i}") for i in range(1, reach + 1)]
    return cases.close(cases.events.select(F.col("activity").alias("src"), *ahead, *carried))


def directly_follows(log: EventLog) -> DataFrame:
    """``src, dst, freq``: how often one activity is directly followed by another in a case."""
    pairs = _followers(log, 1).withColumnRenamed("next1", "dst").where("dst IS NOT NULL")
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("freq"))


def loops_of_two(log: EventLog) -> DataFrame:
    """``src, dst, freq``: how often src dst src occurs in a row, src and dst different."""
    triples = _followers(log, 2).where("src = next2 AND src <> next1")
    return triples.groupBy("src", F.col("next1").alias("dst")).agg(F.count(F.lit(1)).alias("freq"))


def boundary_activities(log: EventLog) -> DataFrame:
    """``boundary`` (start or end), ``activity`` and the number of cases that start or end with it."""
    key = log.order_key()
    cases = log.events.groupBy("case_id").agg(
        F.min_by("activity", key).alias("start"), F.max_by("activity", key).alias("end")
    )
    sides = F.array(
        F.struct(F.lit("start").alias("boundary"), F.col("start").alias("activity")),
        F.struct(F.lit("end").alias("boundary"), F.col("end").alias("activity")),
    )
    named = cases.select(F.inline(sides)).where("activity IS NOT NULL")
    return named.groupBy("boundary", "activity").agg(F.count(F.lit(1)).alias("cases"))


def relation_counts(log: EventLog) -> DataFrame:
    """All that discovery needs from a log in one pass: counts per step and its circumstances.

    ``src, dst`` is a step, ``again`` says that ``src`` comes back after ``dst``, ``first`` and ``last`` that
    ``src`` opens or closes its case. An event without activity is a place in its case, but no step or
    boundary. At most eight rows per pair of activities.
    """
    cases = ordered_cases(log, after=2)
    carried = ["_home", "_chunk", "_position", "_length"] if cases.split else []
    src = F.col("activity")
    steps = cases.events.select(
        src.alias("src"),
        F.lead("activity", 1).over(cases.window).alias("dst"),
        F.coalesce(F.lead("activity", 2).over(cases.window) == src, F.lit(False)).alias("again"),
        (cases.position == 1).alias("first"),
        (cases.position == cases.length).alias("last"),
        *carried,
    )
    return cases.close(steps).groupBy("src", "dst", "again", "first", "last").agg(F.count(F.lit(1)).alias("n"))


def graph_of(counts: DataFrame) -> DataFrame:
    """The directly-follows graph from ``relation_counts``."""
    return counts.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.sum("n").alias("freq"))


def loops_of(counts: DataFrame) -> DataFrame:
    return counts.where("again AND src <> dst AND dst IS NOT NULL").groupBy("src", "dst").agg(F.sum("n").alias("freq"))


def boundaries_of(counts: DataFrame) -> DataFrame:
    sides = F.array(
        F.when(F.col("first"), F.lit("start")), F.when(F.col("last"), F.lit("end"))
    )
    marked = counts.select(F.col("src").alias("activity"), "n", F.explode(sides).alias("boundary"))
    return marked.where("boundary IS NOT NULL AND activity IS NOT NULL").groupBy("boundary", "activity").agg(F.sum("n").alias("cases"))


def footprint(graph: DataFrame, activities: DataFrame) -> DataFrame:
    """``src, dst, relation`` for every ordered pair of the (small) alphabet.

    The alphabet travels as one array, and the pairs meet the graph in two equi-joins of its edges.
    """
    alphabet = activities.select("activity").where("activity IS NOT NULL").distinct()
    everyone = alphabet.agg(F.array_sort(F.collect_set("activity"))).scalar()
    pairs = alphabet.select(F.col("activity").alias("src"), F.explode(everyone).alias("dst"))
    forward = graph.select("src", "dst", F.lit(True).alias("forward"))
    backward = graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("backward"))
    joined = pairs.join(forward, ["src", "dst"], "left").join(backward, ["src", "dst"], "left")
    relation = (
        F.when(F.col("forward") & F.col("backward"), "parallel")
        .when(F.col("forward"), "causal")
        .when(F.col("backward"), "reverse")
        .otherwise("unrelated")
    )
    return joined.select("src", "dst", relation.alias("relation"))


def dependencies(
    graph: DataFrame,
    loops: DataFrame,
    threshold: float = 0.5,
    loop_threshold: float = 0.5,
) -> DataFrame:
    """Dependency measures per edge: ``src, dst, freq, dependency, loop_dependency, kept``.

    An edge is kept when its dependency reaches the threshold (inclusive), or when its two activities
    form a loop of length two that does. A self loop uses f / (f + 1).
    """
    back = graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("freq").alias("back"))
    two = loops.select("src", "dst", F.col("freq").alias("two"))
    two_back = loops.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("freq").alias("two_back"))
    joined = (
        graph.join(back, ["src", "dst"], "left")
        .join(two, ["src", "dst"], "left")
        .join(two_back, ["src", "dst"], "left")
        .fillna(0, ["back", "two", "two_back"])
    )
    own = F.col("src") == F.col("dst")
    measure = F.when(own, F.col("freq") / (F.col("freq") + 1)).otherwise(
        (F.col("freq") - F.col("back")) / (F.col("freq") + F.col("back") + 1)
    )
    twice = F.col("two") + F.col("two_back")
    loop_measure = F.when(own, F.lit(0.0)).otherwise(twice / (twice + 1))
    limit = F.when(own, F.lit(loop_threshold)).otherwise(F.lit(threshold))
    return joined.select(
        "src",
        "dst",
        "freq",
        measure.alias("dependency"),
        loop_measure.alias("loop_dependency"),
        ((measure >= limit) | (loop_measure >= loop_threshold)).alias("kept"),
    )


def branch_relations(edges: DataFrame, graph: DataFrame, and_threshold: float = 0.65) -> DataFrame:
    """AND / XOR per pair of branches at a split (``side = 'split'``) or a join (``side = 'join'``).

    ``edges`` are the kept dependency edges. Pairs are formed around one activity of the process graph,
    so their number is bounded by the alphabet, not by the events.
    """
    plain = edges.where("kept AND src <> dst").select("src", "dst", "freq")
    split = plain.select(F.col("src").alias("activity"), F.col("dst").alias("branch"), "freq", F.lit("split").alias("side"))
    join = plain.select(F.col("dst").alias("activity"), F.col("src").alias("branch"), "freq", F.lit("join").alias("side"))
    branches = split.unionByName(join)
    left = branches.select("side", "activity", F.col("branch").alias("left"), F.col("freq").alias("left_freq"))
    right = branches.select("side", "activity", F.col("branch").alias("right"), F.col("freq").alias("right_freq"))
    pairs = left.join(right, ["side", "activity"]).where(F.col("left") < F.col("right"))
    there = graph.select(F.col("src").alias("left"), F.col("dst").alias("right"), F.col("freq").alias("there"))
    back = graph.select(F.col("dst").alias("left"), F.col("src").alias("right"), F.col("freq").alias("back"))
    joined = pairs.join(there, ["left", "right"], "left").join(back, ["left", "right"], "left").fillna(0, ["there", "back"])
    measure = (F.col("there") + F.col("back")) / (F.col("left_freq") + F.col("right_freq") + 1)
    return joined.select(
        "side",
        "activity",
        "left",
        "right",
        measure.alias("and_measure"),
        F.when(measure >= and_threshold, "AND").otherwise("XOR").alias("relation"),
    )
