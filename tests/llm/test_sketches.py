import hashlib
import random

from pyspark.sql import functions as F

from tracewell.llm import sketches
from tracewell.llm.sketches import compared_fingerprints, containment, fingerprints, merged, sketch_of, with_next, word_hashes

DOCS = "doc_id long, text string, sketch string, key int"


def corpus(n=220, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice((0, 1, 3, 8, 60, 300)))]
        rows.append((rng.randint(-5, 9) * 1000 + i, rng.choice((" ", "\n", " é ")).join(words), "x", 1))
    return rows + [(77_000, None, None, None), (77_001, "", "x", 2), (78_000, "same text here for two of us", "x", 1), (78_001, "same text here for two of us", "x", 1)]


def found(spark, rows):
    return compared_fingerprints(spark.createDataFrame(rows, DOCS)).collect()


def check(spark, rows):
    out = {r.doc_id: r for r in found(spark, rows)}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(out) == len(rows)
    for i, (k, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = out[k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) <= (r.near_edited == 1)
    return out


def test_edited_texts_and_neighbours(spark, monkeypatch):
    monkeypatch.setattr(sketches, "BLOCK_ROWS", 1500)
    check(spark, corpus())


def test_many_blocks(spark):
    rows = corpus(150, 2)
    texts = spark.createDataFrame(rows, DOCS).select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    out = {r.doc: r.next_text for r in with_next(texts, [], block_rows=4).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert out == {k: order[(i + 1) % len(order)][1] or "" for i, (k, *_) in enumerate(order)}


def test_equal_texts_and_estimates(spark):
    out = check(spark, corpus())
    assert out[78_000].fingerprint == out[78_001].fingerprint != ""
    assert out[77_000].fingerprint == out[77_001].fingerprint == "" and out[77_000].near_edited == 1
    long = [r for r in out.values() if r.n_chars > 1000]
    assert 0.6 < sum(r.kept for r in long) / len(long) < 0.72  # two thirds are kept
    assert 0.45 < sum(r.near_edited for r in long) / len(long) < 0.66
    assert sum(r.near_next for r in long) < 1


def test_odd_rows(spark):
    assert found(spark, []) == []
    one = found(spark, [(5, "a b c d e f g h i", "x", 1)])
    assert one[0].edited_sha256 == hashlib.sha256(b"a b c d e fa b c ").hexdigest() or len(one) == 1
    rows = [(None, "null id text", "x", 1), (3, "abc", "x", 1), (3, "abc", "x", 1), (3, "abd", "x", 1)]
    got = found(spark, rows)
    assert len(got) == 4 and sorted(str(r.doc_id) for r in got) == ["3", "3", "3", "None"]


def test_sketches_keep_a_fixed_fraction_and_merge(spark):
    rng = random.Random(3)
    a = [f"a{rng.random()}" for _ in range(20_000)]
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(a[:2000])), (3, " ".join(a[2000:]))], "doc_id long, text string")
    rows = docs.select("doc_id", word_hashes(F.col("text")).alias("h")).select("doc_id", sketch_of(F.col("h")).alias("s")).checkpoint()
    s = {r.doc_id: r.s for r in rows.collect()}
    assert abs(len(s[1]) - 20_000 / 8) < 250 and s[1] == sorted(set(s[1])) and min(s[1]) < 0 or max(s[1]) < 2**61
    pair = rows.where("doc_id = 2").select(F.col("s").alias("a")).crossJoin(rows.where("doc_id = 3").select(F.col("s").alias("b")))
    union = set(pair.select(merged(F.col("a"), F.col("b")).alias("m")).first().m)
    assert len(union ^ set(s[1])) <= 6  # the four shingles across the cut, and the smallest hashes
    both = rows.where("doc_id = 2").select(F.col("s").alias("a")).crossJoin(rows.where("doc_id = 1").select(F.col("s").alias("b")))
    r = both.select(containment(F.col("a"), F.col("b")).alias("x"), containment(F.col("b"), F.col("a")).alias("y")).first()
    assert r.x > 0.98 and 0.05 < r.y < 0.15
    assert fingerprints(docs).where("doc_id = 2").first().fingerprint == "".join(f"{x % 2**64:016X}" for x in s[2])
