"""A Merkle manifest of a dataset: leaves, subroots by group, one root, proofs and their verification.

Leaves stand in order inside their group (the language); every eight consecutive nodes become their digest until one
is left, the group's subroot. The subroots, in order of their groups, form a tree of the same kind up to the root.

Leaves are numbered by a range sort, so a group of any size is dealt over all tasks. Superblocks of 4,096 consecutive
leaves are subtrees of four levels. First each superblock is reduced to one node, tier by tier, which leaves a 4,096th
of the rows each time. Then the nodes that a superblock needs from outside (its siblings on the way to the root) go
down the tiers again, and leaves and outer nodes are cogrouped by superblock: one call finishes the local reduction,
joins local and outer proof, and folds every leaf up to the root.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import crc_text, stored
from tracewell.operators.lookup import pinned

FANOUT = 8
LEVELS = 4  # of a superblock
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

NODES = "tree string, pos long, node binary, n long"
OUTER = "tree string, pos long, step int, place int, others binary, above boolean"
PROVED = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def record_digest(columns: Sequence[Column]) -> Column:
    """Digest of values, each as its length in bytes, a colon and the value, or a dash for null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def ladder(nodes: list[str], whole: bool, size: int = FANOUT, levels: int = LEVELS) -> list[list[str]]:
    """The levels above some nodes: of a whole tree up to one node, of a superblock so many as it has."""
    out = [nodes]
    while len(out[-1]) > 1 if whole else len(out) <= levels:
        below = out[-1]
        out.append([digest(below[i : i + size]) for i in range(0, len(below), size)])
    return out


def local_steps(levels: list[list[str]], at: int, size: int = FANOUT) -> Iterator[tuple[int, list[str]]]:
    """For each level the place of a node in its run and the others of the run."""
    for nodes in levels[:-1]:
        start = at // size * size
        run = nodes[start : start + size]
        yield at - start, run[: at - start] + run[at - start + 1 :]
        at //= size


def fold(node: str, steps: Sequence[tuple[int, list[str]]]) -> str:
    """The root above a node, from its siblings alone."""
    for place, others in steps:
        node = digest([*others[:place], node, *others[place:]])
    return node


def _joined(others: list[str]) -> bytes:
    return bytes.fromhex("".join(others))


def _parted(raw: bytes) -> list[str]:
    text = raw.hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def _levels(rows: pd.DataFrame, size: int, levels: int) -> list[list[str]]:
    return ladder([x.hex() for x in rows["node"]], int(rows["n"].iloc[0]) <= size**levels, size, levels)


def _reduced(size: int, levels: int):
    block = size**levels

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """The node of one superblock, and how many the tree has on that tier."""
        rows = rows.sort_values("pos")
        top = _levels(rows, size, levels)[-1][0]
        n = int(rows["n"].iloc[0])
        return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "pos": [int(rows["pos"].iloc[0]) // block], "node": [bytes.fromhex(top)], "n": [-(-n // block)]})

    return run


def _outer_steps(outer: pd.DataFrame) -> list[tuple[int, list[str], bool]]:
    outer = outer.sort_values("step")
    return [(int(p), _parted(o), bool(a)) for p, o, a in zip(outer["place"], outer["others"], outer["above"])]


def _handed_down(above: bool, size: int, levels: int):
    def run(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        """The outer nodes of every node of a superblock: its local siblings, then those of the superblock."""
        if rows.empty:
            return pd.DataFrame()
        rows, out = rows.sort_values("pos"), []
        local, further = _levels(rows, size, levels), _outer_steps(outer)
        for at, (name, pos) in enumerate(zip(rows["name"], rows["child"])):
            steps = [(p, o, above) for p, o in local_steps(local, at, size)] + further
            out += [(name, pos, k, p, _joined(o), a) for k, (p, o, a) in enumerate(steps)]
        return pd.DataFrame(out, columns=["tree", "pos", "step", "place", "others", "above"]) if out else pd.DataFrame()

    return run


def _proved(size: int, levels: int, proofs: bool):
    def run(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        """Leaves of one superblock and the nodes it needs from outside: reduce, join the proofs, fold."""
        names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + ["proof"] * proofs
        if rows.empty:
            return pd.DataFrame()
        rows = rows.sort_values("pos")
        local, further = _levels(rows, size, levels), _outer_steps(outer)
        subroot = fold(local[-1][0], [(p, o) for p, o, a in further if not a])
        root = fold(subroot, [(p, o) for p, o, a in further if a])
        out = []
        for at, (leaf, other) in enumerate(zip(local[0], rows["changed"])):
            steps = [*local_steps(local, at, size), *[(p, o) for p, o, _ in further]]
            folded = fold(leaf if other is None else other.hex(), steps)
            proof = digest([x for _, o in steps for x in o])
            out.append((leaf, subroot, root, proof, folded, folded == root, [{"place": p, "others": o} for p, o in steps])[: len(names)])
        found = pd.DataFrame(out, columns=names)
        found.insert(0, "doc_id", rows["doc_id"].reset_index(drop=True))
        return found

    return run


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``pos``, a row's place from 0 in its ``tree`` by the order columns (nulls first), and ``n``, the rows of
    the tree.

    One range sort over all rows; a tree of any size is cut by the order columns. The offsets have a row for each
    tree and range.
    """
    kept = stored(
        rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_at", F.monotonically_increasing_id()), "placed"
    ).withColumn("_range", F.shiftright("_at", 33))
    runs = kept.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    tree = Window.partitionBy("tree")
    earlier = tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        "tree", "_range", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"), F.sum("_rows").over(tree).alias("n")
    )
    return (
        kept.join(pinned(offsets), ["tree", "_range"])
        .withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before"))
        .drop("_at", "_range", "_first", "_before")
    )


@dataclass(frozen=True)
class Forest:
    """Tiers of some trees: their nodes, then the superblocks' nodes, and so on; and the top node of each tree."""

    tiers: list[DataFrame]
    tops: DataFrame


def grown(nodes: DataFrame, size: int = FANOUT, levels: int = LEVELS) -> Forest:
    """Reduce the trees tier by tier, in one job each; a tier has a 4,096th of the rows below it."""
    block, tiers, tops = size**levels, [nodes], None
    while True:
        tier = tiers[-1].select("tree", "pos", "node", "n", F.floor(F.col("pos") / block).alias("block"))
        up = stored(tier.groupBy("tree", "block").applyInPandas(_reduced(size, levels), NODES), "tier")
        done = up.where("n = 1")
        tops = done if tops is None else tops.unionByName(done)
        if up.where("n > 1").isEmpty():
            return Forest(tiers, tops.select("tree", "node"))
        tiers.append(up.where("n > 1"))


def handed_down(forest: Forest, whole: DataFrame, above: bool, size: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The outer nodes of the superblocks of the lowest tier; ``whole`` holds those of the trees' tops (``pos`` 0)."""

    def with_tops(tier: int, lower: DataFrame | None) -> DataFrame:
        """A tree takes what its top needs on its highest tier only."""
        if lower is None:
            return whole
        higher = forest.tiers[tier + 1].where("pos = 0").select("tree")
        return whole.join(higher, "tree", "left_anti").unionByName(lower)

    outer = None
    for tier in range(len(forest.tiers) - 1, 0, -1):
        nodes = forest.tiers[tier].withColumns({"name": F.col("tree"), "child": F.col("pos")})
        outer = _outer_of(nodes, with_tops(tier, outer), above, size, levels)
    return with_tops(0, outer)


def _outer_of(tier: DataFrame, outer: DataFrame, above: bool, size: int, levels: int) -> DataFrame:
    rows = tier.select("tree", "pos", "node", "n", "name", "child", F.floor(F.col("pos") / size**levels).alias("block"))
    return stored(
        rows.groupBy("tree", "block").cogroup(outer.groupBy("tree", "pos")).applyInPandas(_handed_down(above, size, levels), OUTER), "outer"
    )


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = LEAF_COLUMNS,
    group: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    tampered: Column | None = None,
    proofs: bool = False,
    size: int = FANOUT,
    levels: int = LEVELS,
) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Where ``tampered`` holds, the folded leaf is that of the row with A-Z of its text in lower case; all others fold
    their own. ``proofs`` adds ``proof``: for each level the row's place in its run and the digests of the others.
    Null groups form a tree of their own, before all others; null ids come first in their tree; rows of equal ids
    go by their leaves, so repeated rows are neighbours with equal leaves. A null ``tampered`` is false. An empty
    table gives an empty one. Further columns are ignored, whatever their names. Texts are digested where they are
    read, however long; only digests move.
    """
    block = size**levels
    changed = record_digest([lower_ascii(F.col(c)) if c == text_col else F.col(c) for c in columns])
    leaf = record_digest([F.col(c) for c in columns])
    rows = stored(
        docs.select(
            F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
            F.col(id_col).alias("doc_id"),
            F.unhex(leaf).alias("node"),
            (F.when(tampered, F.unhex(changed)) if tampered is not None else F.lit(None).cast("binary")).alias("changed"),
        ),
        "leaves",
    )
    leaves = placed(rows, ["doc_id", "node"])
    low = grown(leaves, size, levels)
    subroots = placed(low.tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), ["name"])
    high = grown(subroots, size, levels)
    none = docs.sparkSession.createDataFrame([], OUTER)
    above = handed_down(high, none, True, size, levels)
    tops = _outer_of(subroots.withColumn("child", F.lit(0).cast("long")), above, True, size, levels)
    outer = handed_down(low, tops, False, size, levels)
    kind = docs.schema[id_col].dataType.simpleString()
    more = ", proof array<struct<place: int, others: array<string>>>" if proofs else ""
    return (
        leaves.withColumn("block", F.floor(F.col("pos") / block))
        .groupBy("tree", "block")
        .cogroup(outer.groupBy("tree", "pos"))
        .applyInPandas(_proved(size, levels, proofs), f"doc_id {kind}, {PROVED}{more}")
    )


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The manifest with every row tampered whose id's unsigned crc32 is divisible by three."""
    return manifest(docs, tampered=crc_text("doc_id") % 3 == 0)
