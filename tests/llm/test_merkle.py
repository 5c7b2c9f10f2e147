import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tracewell.llm.merkle import FANOUT, LEVELS, fold, grown, manifest, placed, tampered_manifest


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    out = ""
    for v in row:
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(out)


def tree(nodes, size):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + size]) for i in range(0, len(levels[-1]), size)])
    return levels


def siblings(levels, at, size):
    out = []
    for level in levels[:-1]:
        start = at // size * size
        out.append((at - start, [x for k, x in enumerate(level[start : start + size], start) if k != at]))
        at //= size
    return out


def brute(rows, size=8):
    """The contract, tree by tree in plain Python."""
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append((row[0], leaf_of(row), row))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees.append(tree([leaf for _, leaf, _ in by_lang[lang]], size))
    top = tree([t[-1][0] for t in trees], size)
    out = []
    for k, lang in enumerate(langs):
        for at, (doc_id, leaf, row) in enumerate(by_lang[lang]):
            steps = siblings(trees[k], at, size) + siblings(top, k, size)
            node = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                low = None if row[4] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4])
                node = leaf_of((*row[:4], low))
            for place, others in steps:
                node = h(*others[:place], node, *others[place:])
            out.append((doc_id, leaf, trees[k][-1][0], top[-1][0], h(*[x for _, o in steps for x in o]), node, node == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def some_rows(n):
    rows = [(k, f"s{k % 3}", "en" if k % 3 else "dé", k, f"Text {k} ÄB") for k in range(n)]
    return rows + [(None, None, None, None, None), (None, "s", "en", 1, "A"), (5, "s", "en", 1, "Twice"), (5, "s", "en", 1, "Twice"), (9, "", "", 0, ""), (3, "x", None, 2, "QQ")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(7)


def result(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in df.select(names).collect()), key=str)


@pytest.mark.parametrize("n", [0, 1, 60, 700])
def test_rows_equal_brute_force(spark, n):
    rows = some_rows(n)
    assert result(tampered_manifest(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("size,levels", [(2, 1), (3, 2)])
def test_many_tiers(spark, size, levels):
    """Superblocks of two and of nine leaves, so trees have several tiers; the languages too."""
    rows = some_rows(40) + [(k, "s", f"l{k}", 1, "Z") for k in range(23)]
    docs = frame(spark, rows)
    found = manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, size=size, levels=levels, proofs=True)
    assert result(found) == brute(rows, size)
    for r in found.where("verified").limit(20).collect():
        assert fold(r["leaf"], [(s["place"], list(s["others"])) for s in r["proof"]]) == r["root"]


def test_a_lone_leaf_is_its_subroot_and_root(spark):
    row = (1, None, "en", None, "x")
    (found,) = manifest(frame(spark, [row])).collect()
    assert found["leaf"] == found["subroot"] == found["root"] == found["folded_root"] == leaf_of(row)
    assert found["proof_sha256"] == h() and found["verified"]


def test_one_tree_beyond_a_superblock(spark):
    """4,097 leaves: the second superblock holds one leaf and still has all levels of a superblock."""
    n = FANOUT**LEVELS + 1
    rows = [(k, "s", "en", 1, "T") for k in range(n)]
    assert result(tampered_manifest(frame(spark, rows))) == brute(rows)


def test_empty_long_and_further_columns(spark):
    empty = tampered_manifest(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = [(1, "s", "en", 2_000_000, "É" * 2_000_000), (2, "s", "en", 1, "a")]
    docs = frame(spark, rows).withColumns({c: F.lit(1) for c in ("tree", "node", "pos", "n", "changed", "block", "_at")})
    assert result(tampered_manifest(docs)) == brute(rows)


def test_places_run_through_every_tree(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("tree"), (F.col("id") % 100).alias("k"), F.col("id").alias("t"))
    found = placed(rows.repartition(5), ["k", "t"]).collect()
    for name in "ab":
        own = sorted((r["k"], r["t"], r["pos"], r["n"]) for r in found if r["tree"] == name)
        assert [r[2] for r in own] == list(range(len(own))) and {r[3] for r in own} == {len(own)}


def test_tiers_shrink(spark):
    nodes = spark.range(100).select(F.lit("t").alias("tree"), F.col("id").alias("pos"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("node"), F.lit(100).cast("long").alias("n"))
    forest = grown(nodes, 2, 2)
    assert [t.count() for t in forest.tiers] == [100, 25, 7, 2] and forest.tops.count() == 1
