import random
import zlib

import numpy as np

from tracewell.llm.toxicity import LabelModel, bits_of, linear_classifier, score_texts, terms_of, toxicity, train_toxicity

DOCS = "doc_id long, text string, score string, toxic int"


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(["ba", "ko", "mi", "tu", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 40))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "Scum,", "xulgab" + rng.choice(["e", "os", "anti"]), "zorwick" + rng.choice(["s", "ing"])]))
        rows.append((i, " ".join(words), "s", 1))
        if rng.random() < 0.7:
            labels.append((i, int(bad) if rng.random() > 0.02 else 1 - int(bad)))
    return rows, labels


def held(k):
    return k is not None and zlib.crc32(str(k).encode()) % 3 == 1


def test_catches_held_out_rows_and_leaves_clean_ones(spark):
    rows, labels = corpus()
    odd = [(2000, None, None, None), (2001, "", "s", 0), (None, "you are an idiot", "s", 0), (5, rows[5][1], "s", 1), (2002, "word " * 50_000, "s", 0)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    out = toxicity(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")).collect()
    assert len(out) == len(rows) + len(odd)
    bad = {k for k, t, *_ in rows if any(w in t for w in ("idiot", "Scum", "xulgab", "zorwick"))}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == held(r.doc_id) for r in out)
    apart = [r for r in out if r.held_out and r.doc_id < 2000]
    caught = [r for r in apart if r.predicted]
    assert sum(r.doc_id in bad for r in caught) >= 0.9 * sum(r.doc_id in bad for r in apart)
    assert sum(r.doc_id not in bad for r in caught) <= 0.02 * len(apart)
    assert next(r for r in out if r.doc_id is None).predicted == 1
    assert {r.predicted for r in out if r.doc_id in (2000, 2001, 2002)} == {0}
    assert len({r.score for r in out if r.doc_id == 5}) == 1


def test_held_out_labels_change_nothing(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, DOCS)
    flipped = [(k, 1 - y if held(k) else y) for k, y in labels]
    a, b = (toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect() for x in (labels, flipped))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "you are an idiot and a moron, scum", "s", 0), (2, "fine words", "s", 0)], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.doc_id: r.predicted for r in toxicity(docs, none).collect()} == {1: 1, 2: 0}
    assert toxicity(docs.limit(0), none).collect() == []


def test_score_column_replaces_its_namesake(spark):
    docs = spark.createDataFrame([(1, "idiot", "s", 0)], DOCS)
    out = score_texts(docs, train_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")))
    assert out.columns == ["doc_id", "text", "toxic", "score"] and out.first()["doc_id"] == 1


def test_label_model_finds_accuracies_and_dependences():
    rng = np.random.default_rng(3)
    n = 20_000
    y = rng.random(n) < 0.3
    fire = lambda a, b: np.where(y, rng.random(n) < a, rng.random(n) < b)
    one, two, three, four = fire(0.8, 0.02), fire(0.6, 0.05), fire(0.7, 0.1), fire(0.5, 0.01)
    copy = np.where(rng.random(n) < 0.95, three, ~three)
    votes = np.column_stack([one, two, three, copy, four]).astype(np.int8)
    seen = np.where(rng.random(n) < 0.5, np.where(rng.random(n) < 0.03, ~y, y), -1).astype(int)
    model = LabelModel(votes, seen)
    edges = {frozenset((j, int(p))) for j, p in enumerate(model.parent) if p >= 0}
    assert frozenset((2, 3)) in edges
    assert np.abs(model.accuracies()[:3, 0] - [0.8, 0.6, 0.7]).max() < 0.06
    assert ((model.labels() > 0.5) == y).mean() > 0.95


def test_classifier_learns_soft_labels():
    rng = np.random.default_rng(1)
    x = rng.random((500, 4)) < 0.3
    label = np.where(x[:, 0], 0.95, 0.05)
    at = np.nonzero(x)
    weight, bias = linear_classifier(at[0], at[1], 500, 4, label)
    assert weight[0] > 3 and np.abs(weight[1:]).max() < 0.5 and bias < -1
    assert bits_of(np.array([5]), 4).tolist() == [[1, 0, 1, 0]]
    assert terms_of("stupid") == ["stupid", "stup~", "stupi~"]
