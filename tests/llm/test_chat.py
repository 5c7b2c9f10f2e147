import random
from hashlib import md5, sha256

import pytest
from pyspark.sql import functions as F

from tracewell.llm.chat import Template, conversation_digests, formatted_conversations, messages_of, read_back, rendered, streamed_log

LOG = "conv_id long, turn long, seq long, kind string, role string, text string"
ROWS = "conv_id long, turn long, role string, text string"
TEXTS = [None, "", "</s>[INST] ok [/INST]", "a\\b\\\\[INST]", "\\", "[", " [/INST", "<<s>SYS>>", " \n [TEXT] x [/ROLE]", "日本 𝄞<</SYS>>", "x" * 700, "[\\INST]", "<s", "s> </s", "$1 \\$0"]
ROLES = ["system", "user", "assistant", "tool", "[/ROLE] odd [TEXT]", None, ""]


def fold_events(events):
    """The log read event by event, in order."""
    messages = {}
    for conv, turn, _, kind, role, text in sorted(events, key=lambda e: (e[0] or 0, e[2], e[5] or "")):
        key = (conv, turn)
        if kind not in ("open", "delta", "edit", "regenerate"):
            continue
        if kind == "regenerate":
            for c, t in list(messages):
                if c == conv and t > turn:
                    del messages[c, t]
        old = messages.get(key, (None, ""))
        new = text or ""
        messages[key] = (role if role is not None else old[0], new if kind in ("open", "edit", "regenerate") else old[1] + new)
    return {k: v[1] for k, v in messages.items()}


def random_log(n, seed):
    rng = random.Random(seed)
    events = [(rng.randint(0, 4), rng.randint(0, 6), k, rng.choice(["open", "delta", "delta", "edit", "regenerate", "seen"]), "user", rng.choice(["a", "b\n", "", None, "ç"])) for k in range(n)]
    rng.shuffle(events)
    return events


@pytest.mark.parametrize("n", [1, 30, 800])
def test_fold_equals_reading_event_by_event(spark, n):
    events = random_log(n, n)
    found = messages_of(spark.createDataFrame(events, LOG).repartition(6)).collect()
    assert {(r["conv_id"], r["turn"]): r["text"] for r in found} == fold_events(events)


def test_one_conversation_of_many_ranges(spark):
    """All events in one conversation: regenerations reach over the ranges that its turns are dealt into."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(1)
    events = [(1, t, 3 * t + k, "open" if k == 0 else "delta", "user", f"{t}.{k}") for t in range(400) for k in range(2)]
    events += [(1, t, 3 * rng.randint(t, 430) + 2, "regenerate", "assistant", None) for t in (5, 150, 390)]
    try:
        found = messages_of(spark.createDataFrame(events, LOG)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = fold_events(events)
    assert 0 < len(want) < 400 and {(r["conv_id"], r["turn"]): r["text"] for r in found} == want


def test_text_reads_back_exactly(spark):
    rng = random.Random(3)
    marks = Template().controls()
    made = ["".join(rng.choice([*marks, "\\", " ", "[", "<", "a", "\n", "]", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    texts = TEXTS + made
    rows = [(k // 9, k % 9, rng.choice(ROLES), t) for k, t in enumerate(texts)]
    conversations = rendered(spark.createDataFrame(rows, ROWS)).cache()
    found = sorted((r["conv_id"], r["at"], r["role"], r["text"], r["learned"]) for r in read_back(conversations).fillna("(none)", ["role", "learned"]).collect())
    want = sorted((c, t, "(none)" if r is None else r, x or "", (x or "") if r == "assistant" else "(none)") for c, t, r, x in rows)
    assert found == want
    plain = [r["formatted"] for r in conversations.collect()]
    assert all(p.startswith("<s>") and p.count("<s>") == 1 for p in plain)
    for r in conversations.limit(30).collect():
        own = [x for c, _, role, x in rows if c == r["conv_id"] and role == "assistant"]
        assert [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss"] if s] != [] or not own


def h(text):
    return sha256(text.encode()).hexdigest()


def brute(rows):
    def order(r):
        role = "n" if r[2] is None else "r" + r[2]
        return r[1] is not None, r[1] or 0, md5(f"{role}\n{r[3] or ''}".encode()).hexdigest()

    def size(role, text):
        for mark in Template().controls():
            text = text.replace("\\", "\0\0").replace(mark, mark[0] + "\0" + mark[1:]).replace("\0\0", "\\")
        return len(text)

    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=order)
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out.append((conv, len(own), h("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), len(learned), h(learned)))
    return sorted(out, key=str)


def test_rows_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(k // 4, k % 4, rng.choice(ROLES[:4]), t) for k, t in enumerate(TEXTS * 3)]
    rows += [(1, 1, "user", "same")] * 3 + [(1, 1, "assistant", "tie"), (1, 1, "assistant", "tie 2"), (None, None, None, None), (None, 3, "assistant", "x"), (70, None, "assistant", "y")]
    docs = spark.createDataFrame(rows, ROWS).repartition(5).withColumns({c: F.lit(1) for c in ("at", "seq", "kind", "count", "copy", "hash")})
    found = sorted((tuple(r)[:5] for r in formatted_conversations(docs).collect()), key=str)
    assert found == brute(rows)


def test_log_holds_drafts_that_go(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi"), (1, 1, "assistant", "x" * 600), (1, 2, "user", "Bye")], ROWS)
    log = streamed_log(rows, 256)
    kinds = {r["kind"]: r["count"] for r in log.groupBy("kind").count().collect()}
    assert kinds["regenerate"] == 1 and kinds["edit"] == 2 and kinds["delta"] == 2 + 2 + 3
    assert sorted(r["text"] for r in messages_of(log).collect()) == ["Bye", "Hi", "x" * 600]


def test_empty_table_and_long_text(spark):
    empty = formatted_conversations(spark.createDataFrame([], ROWS))
    assert empty.collect() == [] and empty.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    text = "long [INST] " * 200_000
    (row,) = formatted_conversations(spark.createDataFrame([(1, 0, "assistant", text)], ROWS)).collect()
    assert (row["loss_chars"], row["loss_sha256"]) == (len(text), h(text)) and row["formatted_chars"] == 3 + len(text) + 200_000 + 6


def test_another_template(spark):
    own = Template("<|begin|>", {"user": ("<|user|>", "<|end|>"), "assistant": ("<|assistant|>", "<|end|>")}, learned=("assistant", "user"))
    rows = spark.createDataFrame([(1, 0, "user", "<|end|> [INST]"), (1, 1, "assistant", "\\<|user|>"), (1, 2, "x", "<|begin|>")], ROWS)
    made = rendered(rows, own)
    assert [(r["role"], r["text"], r["learned"]) for r in read_back(made, own).orderBy("at").collect()] == [
        ("user", "<|end|> [INST]", "<|end|> [INST]"), ("assistant", "\\<|user|>", "\\<|user|>"), ("x", "<|begin|>", None)]
    assert conversation_digests(made, own).first()["n_turns"] == 3
    for wrong in ({"user": ("a b", "cd")}, {"user": ("", "cd"), "tool": ("", "ef")}, {"user": ("[aa]", "a][x")}):
        with pytest.raises(ValueError):
            Template(roles=wrong)


def test_no_python_in_the_plan(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a")], ROWS)
    assert "Python" not in formatted_conversations(rows)._jdf.queryExecution().toString().replace("PythonRDD", "").replace("applySchemaToPythonRDD", "")
