"""Pairs of texts that are alike, without comparing all with all.

Edit similarity of at least ``t`` per cent allows k = (1 - t) * longest edits. Of k + 1 consecutive parts of one text at
least one stays untouched by k edits, so it stands in the other text, shifted by no more than the edits before it and
after it allow. Parts are joined for each pair of lengths that can be alike; what meets is compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.columns import similarity

# Below this threshold texts can't be cut into enough parts, and all pairs are compared.
LEAST_THRESHOLD = 50.0
_TINY = 1e-9


def _edits(longest: Column, threshold: float) -> Column:
    return F.floor(longest * (1 - threshold / 100) + _TINY).cast("int")


def _lengths(length: Column, threshold: float) -> Column:
    """The lengths of texts that can be alike."""
    return F.sequence(F.ceil(length * (threshold / 100) - _TINY).cast("int"), F.floor(length * (100 / threshold) + _TINY).cast("int"))


def _start(length: Column, parts: Column, i: Column) -> Column:
    """Where part ``i`` of a text begins: the parts are as even as can be, the longer ones last."""
    return i * F.floor(length / parts).cast("int") + F.greatest(F.lit(0), i - (parts - length % parts)).cast("int")


def _indexed(right: DataFrame, threshold: float) -> DataFrame:
    """For each length that can be alike the parts of a text: ``lengths`` (right, left), ``part``, ``piece``."""
    own = F.length("right")
    rows = right.select("right", own.alias("_own"), F.explode(_lengths(own, threshold)).alias("_other"))
    rows = rows.withColumn("_parts", _edits(F.greatest("_own", "_other"), threshold) + 1)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    begin, end = _start(F.col("_own"), F.col("_parts"), F.col("_part")), _start(F.col("_own"), F.col("_parts"), F.col("_part") + 1)
    return rows.select("right", "_own", "_other", "_part", F.substring("right", begin + 1, end - begin).alias("_piece"))


def _probed(left: DataFrame, threshold: float) -> DataFrame:
    """The pieces of a text where a part of a text of each length could stand."""
    own = F.length("left")
    rows = left.select("left", own.alias("_other"), F.explode(_lengths(own, threshold)).alias("_own"))
    rows = rows.withColumn("_edits", _edits(F.greatest("_own", "_other"), threshold))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_edits"))).alias("_part"))
    parts, i, longer = F.col("_edits") + 1, F.col("_part"), F.col("_other") - F.col("_own")
    rows = rows.withColumns({"_begin": _start(F.col("_own"), parts, i), "_end": _start(F.col("_own"), parts, i + 1)})
    begin, width, rest = F.col("_begin"), F.col("_end") - F.col("_begin"), F.col("_edits") - i
    low = F.greatest(F.lit(0), begin - i, begin + longer - rest)
    high = F.least(F.col("_other") - width, begin + i, begin + longer + rest)
    places = F.when(low <= high, F.sequence(low, high))
    rows = rows.select("left", "_own", "_other", "_part", width.alias("_width"), F.explode(places).alias("_at"))
    return rows.select("left", "_own", "_other", "_part", F.substring("left", F.col("_at") + 1, F.col("_width")).alias("_piece"))


def alike(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``left, right, score``: every pair of the distinct texts ``left`` and ``right`` with a similarity of at least
    ``threshold``, some of them repeatedly."""
    score = similarity(F.col("left"), F.col("right"))
    if threshold < LEAST_THRESHOLD:
        return left.crossJoin(right).withColumn("score", score).where(F.col("score") >= threshold)
    met = _probed(left, threshold).join(_indexed(right, threshold), ["_own", "_other", "_part", "_piece"])
    return met.select("left", "right", score.alias("score")).where(F.col("score") >= threshold)
