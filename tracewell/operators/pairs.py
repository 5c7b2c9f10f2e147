"""Maximal pairs of activity sets, as the alpha algorithm needs them, over the sparse directly-follows graph.

A pair (A, B) holds activities such that every a causes every b and the members of A, and of B, are unrelated. With a
node for "x in A" and one for "x in B", joined where they may stand in one pair, maximal pairs are the maximal cliques
that hold both kinds. Each causal edge (a, b) is one problem: the pairs whose first members are a and b. Its
candidates are the other causes of b and the other effects of a, so a problem is as large as the neighbourhood of one
edge, whatever the alphabet. Joins gather the problems; a clique search on bit sets solves each, streaming its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.lookup import settled

# More pairs than this are no model anyone reads; a search that finds them ends with an error.
MAX_PAIRS = 1_000_000
_ROWS_OUT = 10_000
_PROBLEM = "a string, b string, facts array<struct<kind: string, x: string, y: string>>"


def _bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def maximal_cliques(near: list[int], allowed: int, barred: int) -> Iterator[int]:
    """All cliques of allowed nodes that no allowed or barred node could join, as bit sets.

    Branch on the nodes that a pivot does not reach; the pivot reaches as many as possible.
    """
    stack = [(0, allowed, barred)]
    while stack:
        chosen, free, done = stack.pop()
        if not free:
            if not done:
                yield chosen
            continue
        pivot = max(_bits(free | done), key=lambda u: (free & near[u]).bit_count())
        for v in _bits(free & ~near[pivot]):
            stack.append((chosen | 1 << v, free & near[v], done & near[v]))
            free, done = free & ~(1 << v), done | 1 << v


def _solved(a: str, b: str, facts) -> Iterator[tuple[list[str], list[str]]]:
    """The maximal pairs whose first members are ``a`` and ``b``."""
    sides = [("a", f["x"]) for f in facts if f["kind"] == "a"] + [("b", f["x"]) for f in facts if f["kind"] == "b"]
    place = {node: k for k, node in enumerate(sides)}
    of_a = sum(1 << k for k, (side, _) in enumerate(sides) if side == "a")
    of_b = ((1 << len(sides)) - 1) ^ of_a
    near = [(of_a if side == "a" else of_b) & ~(1 << k) for k, (side, _) in enumerate(sides)]
    for f in facts:
        if f["kind"] in ("aa", "bb"):  # related, so never in one set
            i, j = place[f["kind"][0], f["x"]], place[f["kind"][0], f["y"]]
            near[i] &= ~(1 << j)
            near[j] &= ~(1 << i)
        elif f["kind"] == "ab":  # a causes b
            i, j = place["a", f["x"]], place["b", f["y"]]
            near[i] |= 1 << j
            near[j] |= 1 << i
    allowed = sum(1 << k for k, (side, name) in enumerate(sides) if name > (a if side == "a" else b))
    for clique in maximal_cliques(near, allowed, ((1 << len(sides)) - 1) ^ allowed):
        members = [sides[k] for k in _bits(clique)]
        yield sorted([a, *[n for side, n in members if side == "a"]]), sorted([b, *[n for side, n in members if side == "b"]])


def _search(max_pairs: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, total = [], 0
        for batch in batches:
            for a, b, facts in zip(batch["a"], batch["b"], batch["facts"], strict=True):
                for pair in _solved(a, b, facts):
                    found.append(pair)
                    total += 1
                    if total > max_pairs:
                        raise ValueError(f"more than {max_pairs} pairs of activity sets")
                    if len(found) == _ROWS_OUT:
                        yield pd.DataFrame(found, columns=["a_set", "b_set"])
                        found = []
        if found:
            yield pd.DataFrame(found, columns=["a_set", "b_set"])

    return run


def maximal_pairs(graph: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """``a_set, b_set`` (sorted) of every maximal pair of a directly-follows graph ``src, dst``.

    There is no limit on the alphabet; more than ``max_pairs`` pairs are an error. An activity that follows itself is
    in no pair.
    """
    edges = graph.select("src", "dst").distinct()
    own = edges.where("src = dst").select("src")
    plain = settled(
        edges.where("src <> dst").join(own, "src", "left_anti").join(own.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst")
    )
    back = plain.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    related = plain.unionByName(back).distinct()
    causal = settled(plain.join(back, ["src", "dst"], "left_anti"))
    seeds = causal.select(F.col("src").alias("a"), F.col("dst").alias("b"))

    def facts(frame: DataFrame, kind: str, x: str, y: str | None = None) -> DataFrame:
        other = F.lit(None).cast("string") if y is None else F.col(y)
        return frame.select("a", "b", F.struct(F.lit(kind).alias("kind"), F.col(x).alias("x"), other.alias("y")).alias("fact"))

    causes = seeds.join(causal.select(F.col("src").alias("x"), F.col("dst").alias("b")), "b").where("x <> a")
    causes = settled(causes.join(related.select(F.col("src").alias("x"), F.col("dst").alias("a")), ["x", "a"], "left_anti").select("a", "b", "x"))
    effects = seeds.join(causal.select(F.col("src").alias("a"), F.col("dst").alias("x")), "a").where("x <> b")
    effects = settled(effects.join(related.select(F.col("src").alias("x"), F.col("dst").alias("b")), ["x", "b"], "left_anti").select("a", "b", "x"))

    def crossing(left: DataFrame, links: DataFrame, right: DataFrame) -> DataFrame:
        """Linked candidates of one problem, from the links of the first and a look at the second."""
        linked = left.join(links.select(F.col("src").alias("x"), F.col("dst").alias("y")), "x")
        return linked.join(right.withColumnRenamed("x", "y"), ["a", "b", "y"], "left_semi")

    parts = [
        facts(seeds.withColumn("x", F.col("a")), "seed", "x"),
        facts(causes, "a", "x"),
        facts(effects, "b", "x"),
        facts(crossing(causes, related, causes).where("x < y"), "aa", "x", "y"),
        facts(crossing(effects, related, effects).where("x < y"), "bb", "x", "y"),
        facts(crossing(causes, causal, effects), "ab", "x", "y"),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    problems = every.groupBy("a", "b").agg(F.collect_list("fact").alias("facts"))
    pairs = settled(problems.mapInPandas(_search(max_pairs), "a_set array<string>, b_set array<string>"))
    if pairs.count() > max_pairs:
        raise ValueError(f"more than {max_pairs} pairs of activity sets")
    return pairs
