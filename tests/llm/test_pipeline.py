"""The pipeline's stages on a small corpus against what they promise, and the guard of the entry module."""

import random
import re

import pytest

import __spark_entry__
import corpus_pipeline
from tracewell.llm import LLM_ORACLES, LLM_QUERIES
from tracewell.llm.lines import dedup_lines
from tracewell.llm.surrogates import with_surrogates

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ba", "ko", "mi", "tu", "re", "sol"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(240):
        words = [word() for _ in range(rng.randint(30, 80))]
        bad = i % 7 == 0
        if bad:
            words[3:3] = ["idiot", "scum"]
        if i % 11 == 1:
            words.append(f"user{i}@mail.example.org")
        text = " ".join(words)
        rows.append([i, text + "\nAll rights of this page are reserved.", "en", "s", 0])
        labels.append((i, int(bad)))
        if i % 5 == 2:  # a near copy
            words[rng.randrange(len(words))] = "changed"
            rows.append([1000 + i, " ".join(words), "en", "s", 0])
    rows += [[5000, None, None, None, None], [5001, "", "en", "s", 0], rows[3]]
    return [tuple(r) for r in rows], labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("sf"))
    rows, labels = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_duplicates", "private_data", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = stage(spark, before, folder)
        kept.write.parquet(f"{folder}/{name}")
        kept = spark.read.parquet(f"{folder}/{name}")
        seen[name] = kept
        if name != "packing":
            assert kept.columns == docs.columns
    texts = {name: {r.doc_id: r.text for r in t.collect()} for name, t in seen.items() if name != "packing"}
    assert not any("idiot" in (t or "") for t in texts["toxicity"].values())
    assert {i for i in range(240) if i % 7} <= set(texts["toxicity"])
    assert sum("All rights" in (t or "") for t in texts["line_dedup"].values()) == 1
    assert texts["line_dedup"] == {r.doc_id: r.text for r in dedup_lines(seen["toxicity"]).collect()}
    rows = [(r.doc_id, r.text) for r in seen["line_dedup"].collect()]
    pairs = _groups(rows)
    assert set(texts["near_duplicates"]) == pairs
    assert texts["private_data"] == {r.doc_id: r.text for r in with_surrogates(seen["near_duplicates"]).collect()}
    assert not any(re.search(r"user\d+@mail", t or "") for t in texts["private_data"].values())
    packed = seen["packing"].collect()
    assert {r.doc_id for r in packed} == set(texts["private_data"])
    assert all(r.offset + r.length <= 2048 for r in packed)


def _groups(rows):
    """The smallest id of each group of similar texts."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return {min(rows[i][0] for i in range(len(rows)) if label[i] == x) for x in set(label)}


def test_entry_registers_everything():
    names = set(__spark_entry__.queries())
    assert set(LLM_QUERIES) | {"pipeline"} <= names and set(LLM_ORACLES) <= set(__spark_entry__.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))


def test_near_duplicates_of_repeated_and_null_ids(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(60)) for _ in range(6)]
    near = [t + " more" for t in texts]
    rows = [(5, texts[0]), (5, near[1]), (3, texts[1]), (7, texts[2]), (7, near[2]), (None, texts[3]), (None, near[3]), (None, near[1]), (None, texts[4]), (None, ""), (8, near[4]), (9, texts[5]), (9, texts[5]), (None, texts[5]), (None, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOCS)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    fixed = [(5, texts[0]), (3, texts[1]), (8, near[4]), (9, texts[5]), (None, ""), (None, None)]
    assert len(kept) == len(fixed) + 2 and set(fixed) < set(kept)
    assert sum(k == 7 for k, _ in kept) == 1 and sum(r in kept for r in [(None, texts[3]), (None, near[3])]) == 1


def test_short_boilerplate_goes(spark):
    texts = ["Accept all cookies\none two three four five\n\n使用条款和隐私政策请阅读全文", "Accept all cookies\nsix seven\n\n使用条款和隐私政策请阅读全文", "Accept all cookies"]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCS)
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert kept == {0: texts[0], 1: "six seven\n", 2: ""}
