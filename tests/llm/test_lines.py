import random
import re

from pyspark.sql import functions as F

from tracewell.llm import lines
from tracewell.llm.lines import dedup_lines

DOCS = "doc_id long, text string, pos int, name string"


def word_set(line):
    return set(re.split(r"[ \t\r]", line)) - {""}


def brute(rows, similarity=75, least=5):
    seen, out = [], []
    order = sorted({(k, t) for k, t, *_ in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len({k for k, _ in order}) == len(order)  # one text for each id, so the hash decides nothing
    gone = {}
    for k, text in order:
        for pos, line in enumerate(text.split("\n")):
            s = word_set(line)
            if len(s) < least:
                continue
            if any(100 * len(s & x) >= similarity * len(s | x) for x in seen):
                gone.setdefault(k, set()).add(pos)
            seen.append(s)
    for k, t, *_ in rows:
        kept = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(k, ()))
        out.append((k, kept, len(gone.get(k, ())) if t is not None else 0))
    return sorted(out, key=str)


def corpus(seed=1, n=250):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and"] + [f"w{rng.randint(0, 400)}" for _ in range(6)])
    bases = [[word() for _ in range(rng.randint(3, 30))] for _ in range(60)]
    license_line = "this work is licensed under some terms"
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(1, 6)):
            if rng.random() < 0.5:
                line = list(rng.choice(bases))
                for _ in range(rng.choice((0, 1, 1, 2, 5))):
                    line[rng.randrange(len(line))] = word()
            else:
                line = [word() for _ in range(rng.randint(1, 25))]
            text.append(rng.choice((" ", "  ")).join(line))
        if rng.random() < 0.4:
            text.append(license_line)
        rows.append((n - i, "\n".join(text), i, "x"))
    return rows


def found(spark, rows, **more):
    out = dedup_lines(spark.createDataFrame(rows, DOCS), count_col="removed", **more).collect()
    return sorted(((r.doc_id, r.text, r.removed) for r in out), key=str)


def test_like_brute_force(spark):
    rows = corpus() + [(900, None, 1, None), (901, "", 1, None), (902, "\n\n", 1, "y"), (None, "one two three four five six\nx", 1, "z"), (903, "five four three two one six", 1, "z"), (5000, "a b c d e " * 20_000 + "\na b c d e", 1, "")]
    assert found(spark, rows) == brute(rows)


def test_joined_instead_of_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", -1)
    rows = corpus(2, 80)
    assert found(spark, rows) == brute(rows)


def test_other_similarity(spark):
    rows = corpus(3, 80)
    assert found(spark, rows, similarity=60, least_words=2) == brute(rows, 60, 2)


def test_near_copies_of_one_line(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(20)]
    rows = []
    for i in range(120):
        line = list(base)
        for _ in range(rng.randint(0, 4)):
            line[rng.randrange(20)] = f"v{rng.randint(0, 500)}"
        rows.append((i, " ".join(line), 1, "x"))
    assert found(spark, rows) == brute(rows)


def test_rows_equal_in_id_and_text_fare_alike(spark):
    rows = [(1, "a b c d e\nf g h i j", 1, "x"), (1, "a b c d e\nf g h i j", 2, "y"), (2, "e d c b a\nnew", 3, "z")]
    assert found(spark, rows) == [(1, rows[0][1], 0), (1, rows[0][1], 0), (2, "new", 1)]


def test_repeated_ids_with_other_texts(spark):
    rows = [(1, "a b c d e", 1, "x"), (1, "a b c d f g h", 2, "y"), (1, "a b c d e\nk", 2, "y")]
    assert sum(r[2] for r in found(spark, rows)) == 1


def test_empty_table_and_columns(spark):
    docs = spark.createDataFrame([], DOCS)
    assert dedup_lines(docs).collect() == [] and dedup_lines(docs).columns == docs.columns


def test_only_sets_of_fitting_sizes_meet(spark):
    sizes = list(range(1, 61))
    rows = spark.createDataFrame([(n, n, 0, 0, list(range(n))) for n in sizes], "mark long, n int, bits long, more long, rarest array<int>")
    n = F.col("n")
    one, own = F.slice("rarest", 1, 1), lines._class(n, 75)
    x = lines._entries(rows, "x", one, F.array(own))
    y = lines._entries(rows, "y", one, F.sequence(own, lines._class(F.floor(n * 100 / 75), 75)))
    met = {(r.x_mark, r.y_mark) for r in x.join(y, "key").collect()}
    assert all((a, b) in met for a in sizes for b in sizes if b <= a and 100 * b >= 75 * a)
    assert not any(a >= 2 * b or b >= 2 * a for a, b in met)


def test_shorter_prefix_of_the_smaller_set(spark):
    # Sets of m words, similar ones of at least as many: what both prefixes leave out cannot be all they share.
    sizes = spark.range(1, 200).select(F.col("id").cast("int").alias("n"))
    rows = {r.n: (r.whole, r.part) for r in sizes.select("n", lines._prefix(F.col("n"), 75).alias("whole"), lines._indexed(F.col("n"), 75).alias("part")).collect()}
    for m in rows:
        for n in range(m, min(199, m * 4 // 3) + 1):
            shared = -(-(n + m) * 75 // 175)
            assert rows[n][0] >= n - shared + 1 and rows[m][1] >= m - shared + 1
    assert sum(part for _, part in rows.values()) < 0.65 * sum(whole for whole, _ in rows.values())
