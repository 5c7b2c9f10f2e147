"""Nearest neighbours by inner product with an inverted multi-index.

Both halves of the vectors are quantised separately, and every vector is an entry of the cell of its two
centroids. A query walks the centroid pairs with a heap, by summed distance (the negative inner products of its
halves with the centroids), until it has passed enough entries, and reranks those with the original vectors.
How many are enough is measured, not guessed: for a sample of queries the exact neighbours are found in blocks
against all entries, and the budget is what a given share of those neighbours needs.

Equal vectors are one entry with its smallest ids. Entries are dealt into blocks by first centroid, queries into
blocks by hash, so no task holds more than a block of each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import stored

NEAREST = 20
TRAINING_BYTES = 32 << 20  # the centroids are fitted on a sample of vectors of this size
CALIBRATION = 256  # queries whose exact neighbours set the budget
TARGET = 0.97  # share of those neighbours that the budget must reach
ENTRY_BLOCK, QUERY_BLOCK = 4096, 512


def usable(column: str) -> Column:
    """True for vectors that are not null, not zero and hold finite components only."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0.0), F.lit(False))


def half_centroids(sample: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm on one half of the sampled vectors."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        code = nearest_centroid(sample, centres)
        sizes = np.bincount(code, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, code, sample)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def nearest_centroid(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, budget: float) -> Iterator[tuple[int, int, int]]:
    """Centroid pairs by rising ``first[i] + second[j]`` with the entries passed, until the budget is passed."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    da, db = first[a].tolist(), second[b].tolist()
    a, b = a.tolist(), b.tolist()
    heap, passed = [(da[0] + db[0], 0, 0)], 0
    while heap and passed < budget:
        _, i, j = heapq.heappop(heap)
        passed += int(sizes[a[i], b[j]])
        yield a[i], b[j], passed
        if j + 1 < len(b):
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))


def _vectors(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _best(queries: np.ndarray, entries: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None, keep: int):
    """For each query the rows of its best entries by (score, id), scored one pair at a time."""
    scores = queries @ entries.T
    if allowed is not None:
        scores[~allowed] = -np.inf
    take = min(keep, len(entries))
    for q in range(len(queries)):
        row = scores[q]
        least = np.partition(row, len(row) - take)[len(row) - take]
        near = np.flatnonzero((row >= least - 1e-9 * (1 + abs(least))) & (row > -np.inf)) if np.isfinite(least) else np.flatnonzero(row > -np.inf)
        exact = np.array([np.dot(queries[q], entries[e]) for e in near])
        order = np.lexsort((ids[near], -exact))[:take]
        yield q, near[order], exact[order]


class MultiIndex:
    """Entries of all usable vectors, the centroids and the sizes of the cells."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = NEAREST):
        spark = vectors.sparkSession
        self.nearest = nearest
        rows = vectors.where(usable(vector_col)).select(
            F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col).cast("array<double>"), lambda v: v + F.lit(0.0)).alias("vector")
        ).where("vec_id IS NOT NULL")
        # Inner products need one dimension: the commonest, the larger in a tie.
        common = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
        self.dims = common["dims"] if common else 0
        rows = rows.where(F.size("vector") == self.dims)
        # A rank limit, so that a vector with millions of copies is cut before the shuffle.
        ranked = rows.dropDuplicates(["vec_id", "vector"]).withColumn("rank", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("rank") <= nearest + 1)
        grouped = ranked.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        self.rows = rows
        entries = stored(grouped.select(F.col("ids")[0].alias("entry"), "ids", "vector"), "entries")
        count = entries.count()
        self.empty = count == 0
        if self.empty:
            self.entries = entries
            return
        sample_rows = max(1024, TRAINING_BYTES // (8 * self.dims))
        sample = _vectors(entries.orderBy(F.xxhash64("vector"), "entry").limit(sample_rows).select("vector").toPandas()["vector"])
        k = int(np.clip(2 ** round(np.log2(max(1.0, np.sqrt(count) / 8))), 2, 4096))
        cut = max(1, self.dims // 2)
        self.cut = cut
        centres = half_centroids(sample[:, :cut], k, 1), half_centroids(sample[:, cut:], k, 2) if self.dims > 1 else np.zeros((1, 0))
        shared = spark.sparkContext.broadcast(centres)  # two times k halves, k at most 4096
        schema = "entry long, ids array<long>, vector array<double>, first int, second int"

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            one, two = shared.value
            for rows in batches:
                if len(rows):
                    x = _vectors(rows["vector"])
                    yield rows.assign(first=nearest_centroid(x[:, :cut], one), second=nearest_centroid(x[:, cut:], two))

        self.entries = stored(entries.mapInPandas(assign, schema), "cells")
        self.centres = centres
        cells = self.entries.groupBy("first", "second").count().toPandas()  # k squared at most
        self.sizes = np.zeros((len(centres[0]), len(centres[1])), dtype=np.int64)
        self.sizes[cells["first"], cells["second"]] = cells["count"]

    def exact(self, queries: np.ndarray) -> list[list[int]]:
        """The cells of the exact neighbours of a few queries, found in one pass over all entries in blocks."""
        shared = self.entries.sparkSession.sparkContext.broadcast(queries)
        keep = self.nearest + 1

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: list = [[] for _ in shared.value]
            for rows in batches:
                if not len(rows):
                    continue
                ids, one, two = rows["entry"].to_numpy(), rows["first"].to_numpy(), rows["second"].to_numpy()
                for q, found, scores in _best(shared.value, _vectors(rows["vector"]), ids, None, keep):
                    merged = best[q] + [(-s, int(ids[e]), int(one[e]), int(two[e])) for e, s in zip(found, scores)]
                    best[q] = sorted(merged)[:keep]
            flat = [(q, *x) for q, xs in enumerate(best) for x in xs]
            yield pd.DataFrame(flat, columns=["query", "distance", "entry", "first", "second"])

        found = self.entries.mapInPandas(run, "query int, distance double, entry long, first int, second int")
        rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "entry"))
        rows = found.withColumn("rank", rank).where(F.col("rank") <= keep).collect()  # CALIBRATION times NEAREST + 1
        out: list = [[] for _ in queries]
        for r in rows:
            out[r["query"]].append((r["first"], r["second"]))
        return out

    def budget(self, queries: DataFrame, target: float = TARGET) -> int:
        """The entries that a query must pass so that the share ``target`` of exact neighbours is among them."""
        rows = queries.orderBy(F.xxhash64("vector", F.lit(3)), "query").limit(CALIBRATION).toPandas()
        if not len(rows):
            return 0
        sample = _vectors(rows["vector"])
        need = []
        for q, cells in zip(sample, self.exact(sample)):
            wanted = set(cells)
            if wanted:
                last = {}
                for i, j, passed in walk(-self.centres[0] @ q[: self.cut], -self.centres[1] @ q[self.cut :], self.sizes, float("inf")):
                    if (i, j) in wanted:
                        last[(i, j)] = passed
                        if len(last) == len(wanted):
                            break
                need += [last[c] for c in cells]
        return int(np.quantile(need, target, method="higher")) if need else 0

    def search(self, query_ids: Column, budget: int | None = None) -> DataFrame:
        """``query_id, rank, vec_id, score`` for the usable vectors that ``query_ids`` selects (a condition on ``vec_id``)."""
        spark = self.entries.sparkSession
        schema = "query_id long, rank int, vec_id long, score double"
        if self.empty:
            return spark.createDataFrame([], schema)
        asked = stored(self.rows.where(query_ids).dropDuplicates(["vec_id", "vector"]), "asked")
        queries = stored(asked.groupBy("vector").agg(F.min("vec_id").alias("query")).select("query", "vector"), "queries")
        if budget is None:
            budget = self.budget(queries)
        # Neighbouring first centroids share a block; one with more entries than a block has several.
        held, first_block, blocks, room = self.sizes.sum(axis=1), [], [], 0
        for n in held.tolist():
            if n > ENTRY_BLOCK or n > room:
                first_block.append(first_block[-1] + blocks[-1] if blocks else 0)
                blocks.append(max(1, -(-n // ENTRY_BLOCK)))
                room = ENTRY_BLOCK - n if n <= ENTRY_BLOCK else 0
            else:
                first_block.append(first_block[-1])
                blocks.append(1)
                room -= n
        first_block, blocks = np.array(first_block), np.array(blocks)
        query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
        shared = spark.sparkContext.broadcast((*self.centres, self.sizes, first_block, blocks))
        cut, keep, limit = self.cut, self.nearest + 1, max(budget, 1)

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            one, two, sizes, place, count = shared.value
            for rows in batches:
                for start in range(0, len(rows), 256):
                    part = rows.iloc[start : start + 256]
                    out = []
                    for query, block, vector in zip(part["query"], part["query_block"], part["vector"]):
                        q = np.asarray(vector, dtype=np.float64)
                        found: dict[int, list[int]] = {}
                        for i, j, _ in walk(-one @ q[:cut], -two @ q[cut:], sizes, limit):
                            if sizes[i, j]:
                                for b in range(place[i], place[i] + count[i]):
                                    found.setdefault(int(b), []).append(i * sizes.shape[1] + j)
                        out += [(b, block, query, vector, cells) for b, cells in found.items()]
                    yield pd.DataFrame(out, columns=["block", "query_block", "query", "vector", "cells"])

        def rerank(key, entries: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
            if not len(entries) or not len(probes):
                return pd.DataFrame({"query": [], "entry": [], "score": []})
            entries = entries.sort_values("entry", ignore_index=True)
            ids, x = entries["entry"].to_numpy(), _vectors(entries["vector"])
            cells, cell = np.unique(entries["cell"].to_numpy(), return_inverse=True)
            found = []
            for start in range(0, len(probes), 512):
                part = probes.iloc[start : start + 512]
                allowed = np.zeros((len(part), len(cells)), dtype=bool)
                for k, asked_cells in enumerate(part["cells"]):
                    allowed[k] = np.isin(cells, asked_cells)
                names = part["query"].to_numpy()
                for q, rows, scores in _best(_vectors(part["vector"]), x, ids, allowed[:, cell], keep):
                    found.append(pd.DataFrame({"query": names[q], "entry": ids[rows], "score": scores}))
            return pd.concat(found) if found else pd.DataFrame({"query": [], "entry": [], "score": []})

        block_of = F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int")
        probes = queries.withColumn("query_block", block_of).mapInPandas(
            probe, "block int, query_block int, query long, vector array<double>, cells array<int>"
        )
        place, counts = (F.array(*[F.lit(int(b)) for b in x]) for x in (first_block, blocks))
        salt = F.pmod(F.xxhash64("entry"), counts[F.col("first")])
        cell = F.col("first") * self.sizes.shape[1] + F.col("second")
        dealt = self.entries.select("entry", "vector", cell.alias("cell"), (place[F.col("first")] + salt).cast("int").alias("block"))
        dealt = dealt.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
        keys = ["block", "query_block"]
        near = dealt.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInPandas(rerank, "query long, entry long, score double")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
        near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
        found = near.join(self.entries.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("found_id"))
        # Each query's own row leaves; the copies of a query share its list.
        same = queries.select("query", "vector")
        own = asked.join(same, "vector").select(F.col("vec_id").alias("query_id"), "query")
        listed = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "found_id"))).where(F.col("place") <= keep)
        lists = listed.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "found_id", "score"))).alias("list"))
        kept = F.slice(F.filter("list", lambda x: x["found_id"] != F.col("query_id")), 1, self.nearest)
        out = own.join(lists, "query").select("query_id", F.posexplode(kept).alias("rank", "hit"))
        return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.found_id").alias("vec_id"), F.col("hit.score").alias("score"))


def nearest_neighbours(
    vectors: DataFrame, every: int = 20, nearest: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding", budget: int | None = None
) -> DataFrame:
    """The nearest neighbours by inner product of every usable vector whose id is divisible by ``every``.

    ``query_id, rank, vec_id, score``: largest product first, ties to the smaller id, the query's own row left
    out, at most ``nearest`` rows each. Vectors that are null, zero, or hold a null or non-finite component, rows
    with a null id and vectors of another than the commonest dimension take no part. Repeated rows count once; an
    id with several vectors is a candidate with each. An empty table gives an empty one. ``budget`` fixes the
    entries a query passes; by default it is calibrated.
    """
    return MultiIndex(vectors, id_col, vector_col, nearest).search(F.pmod(F.col("vec_id"), F.lit(every)) == 0, budget)
