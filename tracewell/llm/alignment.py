"""Alignment of two tokenizers' tokens over the same text, by byte ranges.

A is a byte-level vocabulary of the ``tokenizers`` library and reads the text behind one blank; B is a vocabulary of
the sentencepiece library, which adds that blank itself. The libraries' spans are the coarse cuts: A's character
offsets and those of B's immutable proto, which this version of the library hands out as its offset mapping. Where a
span does not end with its token (a character in several tokens, or in byte pieces) the cut follows from the bytes
the tokens decode to.

A text is cut into segments in front of single blanks and line ends between other characters, and between letters and
stops where B allows it. No token of either vocabulary reaches across such a place, so a segment is aligned once and
remembered, and a text is the sequence of its segments. The counts of id pairs over the corpus come back to the documents in slices: each slice of documents has a
dictionary of its pairs, dealt into blocks by B's id, and only those blocks meet the table of counts.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import slices, stored, strings, whole_text

CUT = r"(?<=\S)(?=[ \n]\S)"
LETTER, STOP = "[a-zà-öø-ÿ]", "[.,]"  # a cut between the two as well, if no piece of B holds them side by side
CACHED = 300_000  # segments that a worker remembers; beyond them those that occurred once go
BATCH = 4_096  # segments that the libraries encode in one call
SLICE_CHARS = 2_000_000  # characters of the texts of a slice
BLOCKS = 256  # parts of the pair table, by B's id
SLICES_A_GROUP = 64  # slices that meet one copy of a block
HELD_PAIRS = 2_000_000  # pairs that a task sums up before it hands them on
BLANK = "▁"

ROWS = (
    "slice long, block int, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "codes binary, places binary, times binary"
)


def byte_of_letter() -> dict[str, int]:
    """The bytes behind the letters of a byte-level vocabulary: printable bytes stand for themselves, the others
    follow from U+0100 on in their order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(0x100 + i): b for i, b in enumerate(other)}}


def token_ends(coarse: list[int], decoded: list[int]) -> list[int]:
    """Byte offsets where the tokens end.

    ``coarse`` holds the ends by the library's spans, ``decoded`` the running sizes of the tokens' bytes. A span that
    ends with its token stands; inside a character, or in byte pieces, the decoded bytes say where the token ends.
    """
    if coarse == decoded:
        return coarse
    return [c if c == d else d for c, d in zip(coarse, decoded)]


def groups_and_links(a_ends: list[int], b_ends: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Groups (how many tokens of A and of B stand before each common end) and pairs of positions whose byte ranges
    overlap."""
    groups, links, i, j = [], [], 0, 0
    for a in a_ends:
        b = b_ends[j]
        links.append((i, j))
        while b < a:
            j += 1
            b = b_ends[j]
            links.append((i, j))
        i += 1
        if a == b:
            j += 1
            groups.append((i, j))
    return groups, links


class Aligner:
    """Both vocabularies and the segments aligned so far."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sp = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_of_letter()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [bytes(letters[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
        self.wide = sp.get_piece_size()
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace(BLANK, " ").encode()
            for i, p in enumerate(map(sp.id_to_piece, range(self.wide)))
        ]
        words = [] if self.a.pre_tokenizer is None else [w for w, _ in self.a.pre_tokenizer.pre_tokenize_str(" a 1.\nb ... c\n")]
        if self.a.normalizer is not None or words != ["Ġa", "Ġ1", ".", "Ċ", "b", "Ġ...", "Ġc", "Ċ"]:
            raise ValueError("the first vocabulary must be byte-level and part words as its usual pattern does")
        if any(b" " in t.lstrip(b" ") or (b"\n" in t and len(t) > 1) for t in self.b_bytes) or next(self._pieces([" a  b"]))[0] != sp.encode("a  b"):
            raise ValueError("a piece of the second vocabulary reaches across blanks or lines: texts can't be cut there")
        glued = any(re.search(LETTER + STOP, sp.id_to_piece(i)) for i in range(self.wide))
        self.cut = re.compile(CUT if glued else f"{CUT}|(?<={LETTER})(?={STOP})")
        self.digits = list(map(str, range(max(len(self.a_bytes), self.wide))))
        self.clear()

    def thin_out(self) -> None:
        """Forget the segments that occurred once, and the others' counts."""
        keep = np.flatnonzero(self.seen > 1)
        if len(keep) > CACHED // 2:
            self.clear()
            return
        place = np.full(len(self.seen), -1)
        place[keep] = np.arange(len(keep))
        place = place.tolist()
        self.index = {s: place[i] for s, i in self.index.items() if place[i] >= 0}
        self.groups = [self.groups[i] for i in keep.tolist()]
        self.codes = self.codes[_ranges(self.first[keep], self.sizes[keep, 3])]
        self.sizes, self.good, self.seen = self.sizes[keep], self.good[keep], np.zeros(len(keep), dtype=np.int64)
        self.first = np.cumsum(self.sizes[:, 3]) - self.sizes[:, 3]

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.sizes = np.zeros((0, 4), dtype=np.int64)  # tokens of A and of B, groups, links
        self.good = np.zeros(0, dtype=bool)
        self.first = np.zeros(0, dtype=np.int64)
        self.codes = np.zeros(0, dtype=np.int64)
        self.seen = np.zeros(0, dtype=np.int64)

    def _pieces(self, segments: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """B's ids and coarse ends, in characters, of segments.

        The library puts a blank ahead: it stands for that of a segment that begins with one. Others are encoded on a
        line of their own, and what comes of the blank and the line end is left out.
        """
        sent = [s[1:] if s[0] == " " else s if s[0] == "\n" else "\n" + s for s in segments]
        for segment, found in zip(segments, self.b.encode(sent, num_threads=1, return_type="offset_mapping")):
            ids, ends = found["ids"], [end for _, end in found["offsets"]]
            if segment[0] == " ":
                yield ids, [end + 1 for end in ends]
            elif segment[0] == "\n":
                yield ids[1:], ends[1:]
            else:
                yield ids[2:], [end - 1 for end in ends[2:]]

    def align(self, segments: list[str]) -> Iterator[tuple[list[int], list[int], list, list] | None]:
        """For each segment A's ids, B's ids, groups and links; None where the bytes are not the segment's."""
        for start in range(0, len(segments), BATCH):
            yield from self._aligned(segments[start : start + BATCH])

    def _aligned(self, segments: list[str]) -> Iterator[tuple[list[int], list[int], list, list] | None]:
        a_bytes, b_bytes = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        a_found = self.a.encode_batch(segments, add_special_tokens=False)
        for segment, a, (b_ids, b_coarse) in zip(segments, a_found, self._pieces(segments)):
            raw, a_ids, a_coarse = segment.encode(), a.ids, [end for _, end in a.offsets]
            a_raw, b_raw = list(map(a_bytes, a_ids)), list(map(b_bytes, b_ids))
            if b"".join(a_raw) != raw or b"".join(b_raw) != raw:
                yield None
                continue
            if len(raw) != len(segment):  # character offsets to bytes
                before = [0, *accumulate(len(c.encode()) for c in segment)]
                a_coarse, b_coarse = [before[end] for end in a_coarse], [before[end] for end in b_coarse]
            a_ends = token_ends(a_coarse, list(accumulate(map(len, a_raw))))
            b_ends = token_ends(b_coarse, list(accumulate(map(len, b_raw))))
            yield (a_ids, b_ids, *groups_and_links(a_ends, b_ends))

    def learn(self, segments: Iterable[str]) -> None:
        new = [s for s in dict.fromkeys(segments) if s not in self.index]
        sizes, codes, wide, digits = [], [], self.wide, self.digits
        for segment, found in zip(new, self.align(new)):
            self.index[segment] = len(self.groups)
            if found is None:
                self.groups.append(b"")
                sizes.append((-1, 0, 0, 0))
                continue
            a_ids, b_ids, groups, links = found
            text, i, j = [], 0, 0
            for a, b in groups:
                if a - i == 1 and b - j == 1:
                    text.append(digits[a_ids[i]] + "|" + digits[b_ids[j]])
                else:
                    text.append(",".join([digits[x] for x in a_ids[i:a]]) + "|" + ",".join([digits[x] for x in b_ids[j:b]]))
                i, j = a, b
            self.groups.append(";".join(text).encode())
            sizes.append((len(a_ids), len(b_ids), len(groups), len(links)))
            codes += [a_ids[i] * wide + b_ids[j] for i, j in links]
        if new:
            rows = np.array(sizes, dtype=np.int64)
            good = rows[:, 0] >= 0
            rows[~good] = 0
            starts = len(self.codes) + np.cumsum(rows[:, 3]) - rows[:, 3]
            self.sizes = np.concatenate([self.sizes, rows])
            self.good = np.concatenate([self.good, good])
            self.first = np.concatenate([self.first, starts])
            self.codes = np.concatenate([self.codes, np.array(codes, dtype=np.int64)])
            self.seen = np.concatenate([self.seen, np.zeros(len(rows), dtype=np.int64)])

    def documents(self, texts: list[str]) -> tuple[np.ndarray, list[str], tuple[np.ndarray, ...]]:
        """Sizes and group digests of texts, and their links as (document, code, times) in order."""
        cut = [self.cut.split(" " + t) if t else [] for t in texts]
        if len(self.index) > CACHED:
            self.thin_out()
        collecting = gc.isenabled()
        gc.disable()  # nothing here refers to itself, and a collection would walk through all that is remembered
        try:
            self.learn(chain.from_iterable(cut))
        finally:
            if collecting:
                gc.enable()
        many = np.array([len(c) for c in cut], dtype=np.int64)
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(many.sum()))
        self.seen += np.bincount(at, minlength=len(self.seen))
        doc = np.repeat(np.arange(len(texts)), many)
        bad = np.zeros(len(texts), dtype=bool)
        bad[doc[~self.good[at]]] = True
        keep = ~bad[doc]
        totals = np.stack([np.bincount(doc[keep], weights=self.sizes[at[keep], k], minlength=len(texts)) for k in range(4)], axis=1)
        digests, start = [], 0
        for n, odd in zip(many.tolist(), bad.tolist()):
            own = at[start : start + n].tolist()
            start += n
            digests.append("" if odd or not n else hashlib.sha256(b";".join([self.groups[i] for i in own])).hexdigest())
        at, doc = at[keep], doc[keep]
        # The links of each segment that occurs, as places in the sorted codes of these texts.
        used, local = np.unique(at, return_inverse=True)
        spread = _ranges(self.first[used], self.sizes[used, 3])
        known, place = np.unique(self.codes[spread], return_inverse=True)
        begins = np.cumsum(self.sizes[used, 3]) - self.sizes[used, 3]
        widths = self.sizes[at, 3]
        links = place[_ranges(begins[local], widths)]
        key, times = np.unique(np.repeat(doc, widths) * max(len(known), 1) + links, return_counts=True)
        return totals.astype(np.int64), digests, (known, key // max(len(known), 1), key % max(len(known), 1), times)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many each, behind one another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def packed(numbers: np.ndarray, width: int) -> bytes:
    """Numbers as planes of bytes: the first bytes of all, then the second ones. High planes compress to nothing."""
    return numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def unpacked(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(width, -1).T.copy().view(f"<u{width}").ravel().astype(np.int64)


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _slice_rows(own: Aligner, number: int, ids: pa.Array, texts: list[str], kind: pa.DataType) -> pa.RecordBatch:
    """The rows of a slice: one for each document and one for each block of its pairs."""
    sizes, digests, (known, doc, place, times) = own.documents(texts)
    n = len(texts)
    bounds = np.searchsorted(doc, np.arange(n + 1))
    doc_places, doc_times = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        doc_places.append(packed(np.diff(place[a:b], prepend=0), 4))
        doc_times.append(packed(times[a:b], 4))
    total = np.bincount(place, weights=times, minlength=len(known)).astype(np.int64)
    block = known % own.wide % BLOCKS
    order = np.argsort(block, kind="stable")
    blocks, begin = np.unique(block[order], return_index=True)
    parts = np.split(order, begin[1:]) if len(blocks) else []
    m = len(parts)
    none = pa.nulls(m, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + m, number, dtype=np.int64)),
            pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(blocks.astype(np.int32))]),
            pa.concat_arrays([ids.cast(kind), pa.nulls(m, kind)]),
            *[pa.concat_arrays([pa.array(sizes[:, k]), none]) for k in range(4)],
            pa.array(digests + [None] * m, pa.string()),
            pa.array([None] * n + [packed(known[p], 8) for p in parts], pa.binary()),
            pa.array(doc_places + [packed(p, 4) for p in parts], pa.binary()),
            pa.array(doc_times + [packed(total[p], 4 if total.max() < 2**32 else 8) for p in parts], pa.binary()),
        ],
        ["slice", "block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "places", "times"],
    )


def _summed(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    known, place = np.unique(np.concatenate(codes), return_inverse=True)
    return known, np.bincount(place, weights=np.concatenate(times), minlength=len(known)).astype(np.int64)


def _times(row_times: bytes, row_places: bytes) -> np.ndarray:
    return unpacked(row_times, len(row_times) * 4 // len(row_places)) if row_places else np.zeros(0, np.int64)


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their counts, summed up over the slices of the task."""

    def out(codes, times):
        known, total = _summed(codes, times)
        return pa.RecordBatch.from_arrays([pa.array(known), pa.array(total)], ["code", "n"])

    codes, times, held = [], [], 0
    for batch in batches:
        for code, place, time in zip(*[batch.column(k).to_pylist() for k in range(3)]):
            codes.append(unpacked(code, 8))
            times.append(_times(time, place))
            held += len(codes[-1])
            if held > 2 * HELD_PAIRS:
                codes, times = ([x] for x in _summed(codes, times))
                held = len(codes[0])
                if held > HELD_PAIRS:
                    yield out(codes, times)
                    codes, times, held = [], [], 0
    if held:
        yield out(codes, times)


def _pair_block(wide: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """One block of the pair table: codes in order, counts, and whether the count is the highest of its B id."""
        rows = rows.sort_values("code")
        codes, counts = rows["code"].to_numpy(), rows["n"].to_numpy()
        _, b = np.unique(codes % wide, return_inverse=True)
        highest = np.zeros(b.max() + 1, dtype=np.int64)
        np.maximum.at(highest, b, counts)
        return pd.DataFrame(
            {"block": [int(rows["block"].iloc[0])], "codes": [packed(codes, 8)], "counts": [packed(counts, 8)], "best": [packed(counts == highest[b], 1)]}
        )

    return run


def _look_up(asked: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
    """The counts of the pairs that some slices asked one block for."""
    if asked.empty:
        return pd.DataFrame()
    codes, counts, best = (unpacked(table[c].iloc[0], w) for c, w in (("codes", 8), ("counts", 8), ("best", 1)))
    at = [np.searchsorted(codes, unpacked(c, 8)) for c in asked["codes"]]
    return pd.DataFrame(
        {"slice": asked["slice"], "places": asked["places"], "counts": [packed(counts[i], 8) for i in at], "best": [packed(best[i], 1) for i in at]}
    )


def _document_counts(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """Sums over the links of the documents of one slice."""
    places = [unpacked(p, 4) for p in found["places"]]
    size = max((int(p.max()) + 1 for p in places if len(p)), default=0)
    counts, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for p, c, b in zip(places, found["counts"], found["best"]):
        counts[p], best[p] = unpacked(c, 8), unpacked(b, 1)
    n_best, count_sum = [], []
    for p, t in zip(docs["places"], docs["times"]):
        own, times = np.cumsum(unpacked(p, 4)), unpacked(t, 4)
        n_best.append(int((best[own] * times).sum()) if len(own) else 0)
        count_sum.append(int((counts[own] * times).sum()) if len(own) else 0)
    out = docs[["doc_id", "n_a", "n_b", "n_groups", "n_links"]].copy()
    out["n_best"], out["count_sum"], out["groups_sha256"] = n_best, count_sum, docs["groups_sha256"]
    return out


def encoded_slices(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored rows of all slices: documents (``block`` null) with their links as places in the slice's
    dictionary, and the blocks of that dictionary."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b in slices(pc.utf8_length(batch.column(1)).to_pylist(), SLICE_CHARS):
                ids = batch.column(0).slice(a, b - a)
                yield _slice_rows(aligner(a_path, b_path), number, ids, strings(batch.column(1).slice(a, b - a)), ids.type)
                number += 1

    rows = docs.select(docs[id_col].alias("doc_id"), whole_text(text_col).alias("text"))
    return stored(rows.mapInArrow(run, ROWS.format(kind=kind.simpleString())), "alignment")


def pair_counts(encoded: DataFrame) -> DataFrame:
    """``code, n``: how many links of the corpus hold each pair of ids; a code is A's id times B's size plus B's id."""
    blocks = encoded.where("block IS NOT NULL").select("codes", "places", "times")
    return blocks.mapInArrow(_partial_counts, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def aligned_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Align the tokens of two vocabularies in every whole text.

    One row for each row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.
    Texts that are null or empty, or whose tokens do not decode to the text, have zeros and an empty digest.
    Repeated rows count as often as they occur; among pairs with equal counts all are best; an empty table gives an
    empty one; null ids stay null; further columns are ignored, whatever their names. A text is handled by one task,
    in about 60 bytes of memory for each of its characters.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    encoded = encoded_slices(docs, a_path, b_path, id_col, text_col)
    wide = aligner(a_path, b_path).wide
    counts = pair_counts(encoded).withColumn("block", (F.col("code") % wide % BLOCKS).cast("int"))
    table = stored(counts.groupBy("block").applyInPandas(_pair_block(wide), "block int, codes binary, counts binary, best binary"), "pairs")
    asked = encoded.where("block IS NOT NULL").select("slice", "block", "codes", "places")
    number = encoded.where("block IS NULL").select("slice").distinct().count()
    groups = -(-number // SLICES_A_GROUP) or 1
    salted = asked.withColumn("part", F.pmod(F.xxhash64("slice"), F.lit(groups)))
    copies = table.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    found = (
        salted.groupBy("block", "part")
        .cogroup(copies.groupBy("block", "part"))
        .applyInPandas(_look_up, "slice long, places binary, counts binary, best binary")
    )
    return (
        encoded.where("block IS NULL")
        .drop("block", "codes")
        .groupBy("slice")
        .cogroup(found.groupBy("slice"))
        .applyInPandas(
            _document_counts,
            f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
        )
    )
