"""Threshold-scaled sketches of documents, in DataFrame operations alone.

A sketch retains every shingle hash below a fixed fraction of the hash range (and the smallest one, so that no
text with words is without a sketch). The share of retained hashes is the same for all documents, so sketches of
very unequal documents compare directly, and the sketch of a union follows from the sketches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import whole_text

WIDTH = 5
SCALE_BITS = 3  # one hash in 2 ** SCALE_BITS is retained
BLOCK_ROWS = 1500  # documents of a block of neighbours
MAX_BLOCKS = 65_536
_LOWEST = -(2**63)


def _below(x: Column, bits: int) -> Column:
    """Below the fraction, read as an unsigned number."""
    return (x >= 0) & (x < F.lit(2 ** (64 - bits)))


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words between white space, in order."""
    words = F.split(F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     "), " ")
    return F.array_remove(F.transform(words, lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def sketch_of(hashes: Column, width: int = WIDTH, bits: int = SCALE_BITS) -> Column:
    """The sorted sketch of a text's word hashes; fewer than ``width`` words are one shingle, none are an empty sketch."""
    last = F.greatest(F.size(hashes) - width, F.lit(0))
    shingles = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))
    return _trimmed(F.when(F.size(hashes) > 0, shingles).otherwise(F.array().cast("array<long>")), bits)


def _trimmed(hashes: Column, bits: int) -> Column:
    low = F.filter(hashes, lambda x: _below(x, bits))
    least = F.filter(F.array(F.array_min(hashes)), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.concat(low, least)))


def merged(a: Column, b: Column, bits: int = SCALE_BITS) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return _trimmed(F.concat(a, b), bits)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first one's shingles that the second has too; 1 for an empty first sketch."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance: shared hashes among all of both, 1 for equal sketches, 0 if only one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(a == b, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both)).cast("double")


def as_text(sketch: Column) -> Column:
    """16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def with_next(texts: DataFrame, carried: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``texts`` (``doc, text`` and ``carried``) with ``next_<column>`` of the next row by falling ``doc``.

    The last row is followed by the first. Rows are dealt into blocks of neighbouring ids, and the first row of each
    block also closes the block before it, so texts are shuffled once and no task holds more than a block.
    """
    key = F.coalesce(F.col("doc"), F.lit(_LOWEST))
    keys = texts.select(key.alias("key"), F.xxhash64("text").alias("version"))
    count = keys.count()
    blocks = int(min(MAX_BLOCKS, max(1, -(-count // block_rows))))
    cuts = [(k + 1) / blocks for k in range(blocks - 1)]
    bounds = keys.agg(F.percentile_approx("key", cuts, 100 * blocks)).first()[0] if cuts else []
    bounds = sorted(set(bounds or []))
    heads = keys.groupBy(_position(F.col("key"), bounds).alias("block")).agg(F.max(F.struct("key", "version")).alias("head"))
    found = sorted((r["block"], r["head"]["key"], r["head"]["version"]) for r in heads.collect())  # MAX_BLOCKS at most
    # Falling ids: the block before a head is the next higher one; the lowest block is followed by the highest.
    ghosts = [(k, v, found[(i + 1) % len(found)][0]) for i, (_, k, v) in enumerate(found)]
    ghosts = texts.sparkSession.createDataFrame(ghosts, "ghost_key long, ghost_version long, ghost long")
    rows = texts.withColumns({"key": key, "version": F.xxhash64("text")})
    rows = rows.join(F.broadcast(ghosts), (F.col("key") == F.col("ghost_key")) & (F.col("version") == F.col("ghost_version")), "left")
    own = F.struct(_position(F.col("key"), bounds).alias("block"), F.lit(False).alias("copy"))
    other = F.struct(F.col("ghost").alias("block"), F.lit(True).alias("copy"))
    rows = rows.withColumn("place", F.explode(F.when(F.col("ghost").isNull(), F.array(own)).otherwise(F.array(own, other))))
    order = Window.partitionBy("place.block").orderBy("place.copy", F.desc("key"), F.desc("version"))
    names = ["text", *carried]
    rows = rows.select("doc", *names, *[F.lead(n).over(order).alias(f"next_{n}") for n in names], F.col("place.copy").alias("copy"))
    return rows.where(~F.col("copy")).drop("copy")


def _position(key: Column, bounds: list[int]) -> Column:
    """How many bounds lie below the key, looked up in two steps."""
    if not bounds:
        return F.lit(0).cast("long")
    step = max(1, math.isqrt(len(bounds)))
    every = F.expr(f"CAST(split('{','.join(map(str, bounds))}', ',') AS array<bigint>)")
    coarse = F.expr(f"CAST(split('{','.join(map(str, bounds[step - 1 :: step]))}', ',') AS array<bigint>)")
    whole = F.size(F.filter(coarse, lambda b: b < key))
    return (whole * step + F.size(F.filter(F.slice(every, whole * step + 1, step), lambda b: b < key))).cast("long")


def fingerprints(docs: DataFrame, width: int = WIDTH, bits: int = SCALE_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every whole text; null counts as empty and has an empty fingerprint."""
    rows = docs.select(docs[id_col].alias("doc_id"), word_hashes(whole_text(text_col)).alias("hashes"))
    return rows.select("doc_id", as_text(sketch_of(F.col("hashes"), width, bits)).alias("fingerprint"))


def compared_fingerprints(docs: DataFrame, width: int = WIDTH, bits: int = SCALE_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of documents and of their edited texts.

    The edited text has its last third (rounded down, in code points) replaced by the beginning of the next
    document by falling id; the first follows the last. Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, kept``: the likeness of the document's
    sketch to the edited text's and to the next document's, and how much of the document's sketch the edited text's
    contains. One row for each row. Null texts are empty. Rows with equal
    ids stand in the order of their texts' hashes, a null id after all others; a single document follows itself.
    An empty table gives an empty one; further columns are ignored.
    """
    texts = docs.select(docs[id_col].cast("long").alias("doc"), whole_text(text_col).alias("text"))
    if texts.isEmpty():
        return texts.sparkSession.createDataFrame(
            [], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept double"
        )
    texts = texts.withColumn("hashes", word_hashes(F.col("text"))).select("doc", "text", sketch_of(F.col("hashes"), width, bits).alias("sketch"))
    rows = with_next(texts, ["sketch"])
    chars = F.length("text")
    third = F.floor(chars / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), chars - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("doc", chars.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = rows.withColumn("hashes", word_hashes(F.col("edited")))
    rows = rows.select("doc", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sketch", "next_sketch", sketch_of(F.col("hashes"), width, bits).alias("edited_sketch"))
    return rows.select(
        F.col("doc").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("kept"),
    )
