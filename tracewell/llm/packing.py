"""Best-fit packing of tokenised documents, with bounds that certify the number of sequences.

Documents become items of at most ``size`` tokens. Every partition packs its items by best-fit decreasing and
computes a lower bound on its sequences from dual-feasible functions. Where both agree the partition is
certified and stays. The others give up the documents of their emptiest sequences: partitions with gaps are
merged in groups, the documents so exchanged are packed anew by best-fit decreasing, and so on until one
partition is left. A repacking is used only where it needs no more sequences than before.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import slices, stored, strings, whole_text

ITEMS = 20_000  # items of a partition in the first round
FAN_IN = 8  # partitions with gaps that exchange in a later round
EXCHANGED = 128  # sequences that a partition with a gap gives up
SLICE_CHARS = 4_000_000
CACHED = 1_000_000
# White space as Unicode lists it; the vocabulary's normaliser and splitter cut there. Fixed values.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'  # without the apostrophe, which may belong to the letters behind it
PIECE_SCHEMA = "piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Ids of texts as little-endian 32-bit bytes; each distinct word goes through the library once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = False
        self.cache: dict[str, bytes] = {"": b""}
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are kept as little-endian 32-bit numbers")
        probe = "It's a bé\n12 x"
        if self._words(probe) != self._whole(probe):
            raise ValueError("the vocabulary must split at white space")

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _words(self, text: str) -> bytes:
        try:
            text.encode("latin-1")  # there, lower case is a matter of single characters, as in the vocabulary
            text = text.lower()
        except UnicodeEncodeError:
            pass
        for c in SPACES:
            if c in text:
                text = text.replace(c, " ")
        words = text.split(" ")
        try:
            return b"".join(map(self.cache.__getitem__, words))
        except KeyError:
            self.learn(words)
            return b"".join(map(self.cache.__getitem__, words))

    def learn(self, words: list[str]) -> None:
        """Ids of new words; letters with marks behind them are two tokens to the vocabulary's splitter."""
        cache, ends = self.cache, {}
        new = set(words).difference(cache)
        for w in new:
            stem = w.rstrip(MARKS)
            if stem != w and stem.isalpha():
                ends[w] = stem
        parts = new.difference(ends)
        for w, stem in ends.items():
            parts.add(stem)
            parts.add(w[len(stem) :])
        parts = [p for p in parts if p not in cache]
        for start in range(0, len(parts), 10_000):
            part = parts[start : start + 10_000]
            for w, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False)):
                cache[w] = array("I", e.ids).tobytes()
        for w, stem in ends.items():
            cache[w] = cache[stem] + cache[w[len(stem) :]]

    def of(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHED:
            self.cache = {"": b""}
        return [self._whole(t) if any(s in t for s in self.special) else self._words(t) for t in texts]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(
    docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``): each document's ids with one ``end_id``, cut at ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            texts = strings(batch.column(1))
            for a, b in slices([len(t) for t in texts], SLICE_CHARS):
                rows, columns = [], [[], [], [], []]
                kept = []
                for k, raw in enumerate(word_ids(tokenizer).of(texts[a:b])):
                    raw += end
                    for piece, start in enumerate(range(0, len(raw), 4 * size)):
                        part = raw[start : start + 4 * size]
                        rows.append(a + k)
                        for column, value in zip(columns, (piece, start // 4, len(part) // 4, zlib.crc32(part))):
                            column.append(value)
                        kept.append(part)
                arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int32())]
                arrays += [pa.array(c, pa.int64()) for c in columns[1:]]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in kept], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, {PIECE_SCHEMA}" + ", ids array<int>" * with_ids
    return docs.select(docs[id_col].alias("doc_id"), whole_text(text_col)).mapInArrow(run, schema)


def best_fit_decreasing(lengths: np.ndarray, size: int) -> np.ndarray:
    """The sequence of each item: longest items first, each into the fullest sequence that still takes it."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(size + 1)]  # sequences by free room
    rooms, made = 0, 0  # bit r is set where a sequence with room r exists
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            chosen = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            room, chosen, made = size, made, made + 1
        bins[i] = chosen
        if room > n:
            free[room - n].append(chosen)
            rooms |= 1 << (room - n)
    return bins


def bins_needed(lengths: np.ndarray, size: int) -> int:
    """A lower bound on the sequences: the best of two families of dual-feasible functions.

    One counts items above ``size - k`` as whole and drops those below ``k``; the other rounds ``n (k + 1) / size``.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    total = np.arange(size + 1) * count
    upto, number = np.concatenate([[0], np.cumsum(total)]), np.concatenate([[0], np.cumsum(count)])
    k = np.arange(0, size // 2 + 1)
    large = number[-1] - number[size - k + 1]
    middle = upto[size - k + 1] - upto[np.minimum(k, size - k + 1)]
    best = int((large + -(-middle // size)).max())
    items = np.arange(size + 1)
    for m in range(1, 101):
        scaled = items * (m + 1)
        value = np.where(scaled % size == 0, items * m, (scaled // size) * size)  # in units of 1 / (m size)
        best = max(best, int(-(-int((value * count).sum()) // (m * size))))
    return best


def _packed(rows: pd.DataFrame, size: int, label: int, give: int) -> pd.DataFrame:
    """One partition: pack, compare with the bound, and mark what it gives up.

    Items that come back from earlier rounds keep their old sequences if the repacking needs more.
    """
    rows = rows.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
    lengths = rows["length"].to_numpy()
    bins = best_fit_decreasing(lengths, size)
    used, bound = int(bins.max()) + 1, bins_needed(lengths, size)
    old = rows["sequence_id"].to_numpy()
    if (old >= 0).all() and len(np.unique(old)) < used:
        bins = np.unique(old, return_inverse=True)[1]
        used = int(bins.max()) + 1
    fill = np.bincount(bins, weights=lengths, minlength=used)
    open_bins = np.zeros(used, dtype=bool)
    if used > bound:
        open_bins[np.argsort(fill, kind="stable")[:give]] = True
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    first = np.searchsorted(bins[order], np.arange(used))
    offset = np.empty(len(rows), dtype=np.int64)
    offset[order] = ends - lengths[order] - np.repeat((ends - lengths[order])[first], np.diff(np.append(first, len(rows))))
    return rows.assign(sequence_id=(np.int64(label) << 32) + bins, offset=offset, open=open_bins[bins], bins=used, bound=bound)


def _packer(size: int, level: int, give: int):
    return lambda rows: _packed(rows, size, (level << 24) + int(rows["part"].iloc[0]), give)


def pack(items: DataFrame, size: int = 2048, items_per_part: int = ITEMS, fan_in: int = FAN_IN, give: int = EXCHANGED) -> tuple[DataFrame, list]:
    """Pack items (``doc_id, piece, start, length, ids_crc32``) into sequences of at most ``size`` tokens.

    Returns the items with ``sequence_id`` and ``offset``, and for each round the partitions, sequences, bounds
    and certified partitions. Sequences of other partitions are never touched, so each round only moves the
    documents that are exchanged. Full items are sequences of their own. Repeated rows are items like any
    others; an empty table gives an empty one.
    """
    items = stored(items, "items")
    total = items.count()
    parts = max(1, -(-total // items_per_part))
    schema = f"{items.schema.simpleString()[7:-1].replace(':', ' ')}, part long, sequence_id long, offset long, open boolean, bins long, bound long"
    seed = F.xxhash64(*[F.col(c) for c in items.columns])
    # Equal rows are dealt one by one: a few documents may be a third of all rows.
    part = F.pmod(F.xxhash64(seed, F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(parts))
    current = items.withColumns({"part": part, "sequence_id": F.lit(-1).cast("long")})
    closed, certificate, level = [], [], 0
    while True:
        packed = stored(current.groupBy("part").applyInPandas(_packer(size, level, give), schema), f"packed{level}")
        by_part = packed.groupBy("part").agg(F.max("bins").alias("bins"), F.max("bound").alias("bound"))
        figures = by_part.agg(
            F.count("*").alias("parts"), F.sum("bins").alias("sequences"), F.sum("bound").alias("bound"), F.sum((F.col("bins") == F.col("bound")).cast("long")).alias("certified")
        ).first()
        certificate.append({"round": level, **figures.asDict()})
        gaps = (figures["parts"] or 0) - (figures["certified"] or 0)
        if parts == 1 or gaps < 2:
            closed.append(packed)
            break
        closed.append(packed.where(~F.col("open")))
        parts = -(-parts // fan_in)
        current = packed.where("open").withColumn("part", F.pmod(F.col("part"), F.lit(parts)).cast("long")).select(*items.columns, "part", "sequence_id")
        level += 1
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out.select(*items.columns, "sequence_id", "offset"), certificate


def packed_documents(docs: DataFrame, tokenizer: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and pack documents: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is a document of the end id alone; null ids stay null.
    """
    return pack(token_pieces(docs, tokenizer, size, id_col=id_col, text_col=text_col), size)[0]
