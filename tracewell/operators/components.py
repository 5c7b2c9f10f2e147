"""Connected components of an edge table, by passing the least label on and halving the way to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.lookup import settled


def component_labels(pairs: DataFrame) -> DataFrame:
    """``node, label``: for every node of the edges ``a, b`` the least node that can be reached.

    Each round a node takes the least label around it and then that label's own label, so the rounds grow with the
    logarithm of a component's diameter in most graphs. Nodes may be of any type that has an order.
    """
    both = settled(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = settled(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")))
    while True:
        around = both.join(state.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("node"))
        lower = state.join(around.agg(F.min("near").alias("near")), "node").select("node", "label", F.least("label", "near").alias("low"))
        jumped = lower.join(state.select(F.col("node").alias("low"), F.col("label").alias("far")), "low")
        following = settled(jumped.select("node", "label", F.least("low", "far").alias("next")))
        changed = not following.where("next < label").isEmpty()
        state = following.select("node", F.col("next").alias("label"))
        if not changed:
            return state
