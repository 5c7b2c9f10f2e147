import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracewell.llm import pitman_yor
from tracewell.llm.pitman_yor import alone_ratio, sample_seating, score_documents


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    nouns = ["n%d" % i for i in range(60)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(1, 40)):
            words += [rng.choice(["the", "A", "of"]), rng.choice(nouns[: 1 + int(rng.paretovariate(0.6)) % 60]), rng.choice(["runs", "sits", "r%d" % rng.randint(0, 4000)])]
        rows.append((i, " ".join(words)))
    return rows + [(900, None), (901, ""), (None, "the n1 Runs"), (902, " \n"), (903, "new words only"), (5, "The\tn2"), (5, "The\tn2")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def check(spark, rows):
    docs = spark.createDataFrame([(k, t, "x", 0.5) for k, t in rows], "doc_id long, text string, slice string, score double")
    found = score_documents(docs).collect()
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1
    count = Counter(w for k, t in rows if not held(k) for w in words(t))
    n, v = sum(count.values()), len(count)
    want = Counter()
    for k, t in rows:
        tokens = words(t)
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        want[(k, held(k), len(tokens), sum(count[w] > 0 for w in tokens), n, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    return found


def test_counts_and_base_are_exact_and_the_model_beats_them(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "SHARD_TOKENS", 3000)
    monkeypatch.setattr(pitman_yor, "SLICE_CHARS", 4000)
    monkeypatch.setattr(pitman_yor, "SHARE", 50)
    found = check(spark, corpus())
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_one_shard(spark):
    found = check(spark, corpus(60))
    assert {r.score for r in found if r.doc_id == 5 and r.n_tokens == 3} .__len__() == 1


def test_empty_and_untrained(spark):
    assert score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    row = score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.base_score == pytest.approx(0)


def test_chance_of_sitting_alone():
    ratio = alone_ratio(0.5)
    assert ratio[1, 1] == 1 and ratio[3, 1] == 0 and ratio[3, 3] == pytest.approx(1)
    # Two tables for three customers: one of three ways to pair, so one customer in three is alone.
    assert ratio[3, 2] == pytest.approx(1 / 3)


def test_tables_follow_the_seating_distribution():
    """One restaurant of 12 customers with a fixed base: the number of tables against direct simulation."""
    rng = np.random.default_rng(0)
    n = 4000
    word, context, c = np.arange(n), np.zeros(n, dtype=np.int64), np.full(n, 12)
    c[::2] = 1  # gives a discount of its own
    c[1::8] = 2
    samples, (high, low) = sample_seating(word, context, c, n, 1, (np.zeros(1), 0.0, 0.0, 0), 1.0, rng, burn_in=60, keep=2)
    t = samples[-1][0]
    assert (t >= 1).all() and (t <= c).all() and (t[c == 1] == 1).all()
    assert (samples[-1][1] == t).all() and (samples[-1][2] <= t).all()


def test_probabilities_add_up(spark):
    """Over all known words and the unknown one, the probabilities of the next word sum to one."""
    rows = corpus(80)
    vocabulary = sorted({w for _, t in rows for w in words(t) if w} | {"zzz"})
    held = [k for k in range(10_000, 400_000) if zlib.crc32(str(k).encode()) % 5 == 1][: len(vocabulary) + 1]
    rows = [(k, t) for k, t in rows if k is None or zlib.crc32(str(k).encode()) % 5 != 1]
    known = sorted({w for _, t in rows for w in words(t) if w})
    probes = [(held[0], "")] + [(k, w) for k, w in zip(held[1:], known)]
    score = {r.doc_id: r for r in score_documents(spark.createDataFrame(rows + probes, "doc_id long, text string")).collect()}
    # P(w, end | start) / P(end | w) is not observable, so sum the ends instead: P(end | start) must be a probability
    # and every one-word text must be less likely than its first word alone can be.
    total = 10 ** score[held[0]].score + sum(10 ** score[k].score for k, _ in probes[1:])
    assert 0 < total < 1


def test_hot_dishes_converge_within_the_burn_in():
    """Dishes of thousands of customers: tables and parent tables as after many sweeps, and samples that differ."""
    rng = np.random.default_rng(1)
    tokens = (rng.zipf(1.4, 400_000) % 100_000) * 8 + rng.integers(0, 8, 400_000)
    key, c = np.unique(tokens, return_counts=True)
    word = np.unique(key >> 3, return_inverse=True)[1]
    args = (word, key & 7, c, int(word.max()) + 1, 8, (np.zeros(8), 0.0, 0.0, 0), 1.0)
    hot = c >= 2000
    short, _ = sample_seating(*args, np.random.default_rng(0))
    long, _ = sample_seating(*args, np.random.default_rng(1), burn_in=60)
    for figure in (lambda s: s[0][hot].sum(), lambda s: s[1].sum(), lambda s: s[2].sum()):
        a, b = (np.mean([figure(s) for s in samples]) for samples in (short, long))
        assert abs(a / b - 1) < 0.05
    assert np.abs(short[-1][0] - short[0][0])[hot].mean() > 10


@pytest.mark.parametrize("named", [60_000, 50])
def test_rare_words_have_contexts_of_their_own(spark, monkeypatch, named):
    """Pairs of rare words: the second is far likelier after its own first word than after another's."""
    monkeypatch.setattr(pitman_yor, "SHARD_TOKENS", 3000)
    monkeypatch.setattr(pitman_yor, "SLICE_CHARS", 4000)
    monkeypatch.setattr(pitman_yor, "SHARE", 20)
    monkeypatch.setattr(pitman_yor, "NAMED", named, raising=False)
    rng = random.Random(8)
    held = [k for k in range(10_000, 20_000) if zlib.crc32(str(k).encode()) % 5 == 1]
    train = [k for k in range(10_000, 20_000) if zlib.crc32(str(k).encode()) % 5 != 1]
    pairs = [f"a{i} b{i} the" for i in range(300)] * 8
    rng.shuffle(pairs)
    rows = [(train[k], " ".join(pairs[k * 10 : k * 10 + 10])) for k in range(240)]
    rows += [(held[2 * i], f"a{i} b{i}") for i in range(300)] + [(held[2 * i + 1], f"a{i} b{(i + 1) % 300}") for i in range(300)]
    score = {r.doc_id: r.score for r in check(spark, rows)}
    assert all(score[held[2 * i]] > score[held[2 * i + 1]] + 1 for i in range(300))
