import math
import random

import numpy as np
import pytest

from tracewell.llm.multi_index import nearest_neighbours, walk

SCHEMA = "vec_id long, embedding array<float>, entry string, label int"


def brute(rows, every, nearest):
    good = {(k, tuple(np.float32(v) + np.float32(0) for v in x)) for k, x in rows if k is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x)}
    dims = max({len(x) for _, x in good}, key=lambda d: (sum(len(x) == d for _, x in good), d), default=0)
    good = sorted((k, x) for k, x in good if len(x) == dims)
    out = {}
    for k, q in good:
        if k % every == 0:
            scores = sorted((-sum(float(a) * float(b) for a, b in zip(q, x)), j) for j, x in good if j != k)[:nearest]
            out[k] = [(j, -s) for s, j in scores]
    return out


def vectors(n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(n)]
    hot = [1.0, -2.0, 0.5, 3.0, 0.0, 1.0]
    rows += [(n + i, hot) for i in range(150)]
    rows += [(5, rows[5][1]), (2000, None), (2020, [0.0] * 6), (2040, [1.0, None] + [1.0] * 4), (2060, [float("nan")] * 6), (2080, [float("inf")] + [1.0] * 5), (2100, [1.0, 2.0]), (None, hot), (2120, [])]
    return rows


def found(spark, rows, **more):
    out = {}
    docs = spark.createDataFrame([(k, x, "e", 1) for k, x in rows], SCHEMA)
    for r in nearest_neighbours(docs, **more).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_exact_with_the_whole_budget(spark):
    rows = vectors()
    got, want = found(spark, rows, every=10, budget=10**9), brute(rows, 10, 20)
    assert got.keys() == want.keys()
    for k in want:
        assert [j for j, _ in got[k]] == [j for j, _ in want[k]]
        assert [s for _, s in got[k]] == pytest.approx([s for _, s in want[k]], rel=1e-12)


def test_calibrated_recall(spark):
    rows = vectors(900, 2)
    got, want = found(spark, rows, every=20), brute(rows, 20, 20)
    hits = sum(len({j for j, _ in got[k]} & {j for j, _ in want[k]}) for k in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_few_and_no_vectors(spark):
    assert found(spark, []) == {}
    assert found(spark, [(0, None)]) == {}
    assert found(spark, [(0, [1.0])]) == {}
    assert found(spark, [(0, [1.0]), (3, [2.0]), (7, [2.0])]) == {0: [(3, 2.0), (7, 2.0)]}


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(0)
    a, b = rng.random(7), rng.random(5)
    pairs = list(walk(a, b, np.ones((7, 5), dtype=int), 10**9))
    assert len({(i, j) for i, j, _ in pairs}) == 35
    sums = [a[i] + b[j] for i, j, _ in pairs]
    assert sums == sorted(sums) and [p for *_, p in pairs] == list(range(1, 36))
    assert len(list(walk(a, b, np.ones((7, 5), dtype=int), 8))) == 8
