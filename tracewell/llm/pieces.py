"""SentencePiece encoding and decoding for vocabularies of the merge type (BPE).

The text is normalised (dummy prefix, blanks as U+2581) and cut into chunks at places where no piece of the
vocabulary reaches across, so no merge does either. Inside a chunk an agenda of adjacent symbol pairs is
worked off by score, the best first and the leftmost among equals, until no pair is a piece. Characters that
are no piece become byte pieces. Short chunks of an Arrow batch run their agendas side by side as rows of a
matrix; long ones use a heap. What a batch has encoded anew is held against the library in one call.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewell.llm.common import slices, strings, whole_text

BLANK = "▁"
WIDE = 24  # symbols of a chunk in the matrix; longer chunks use the heap
CACHED = 1_000_000  # chunks that a worker remembers
SLICE_CHARS = 4_000_000  # characters of text handled at once

codecs.register_error("each-broken-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class PieceCodec:
    """The codec of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        if any(sp.is_unused(i) for i in range(size)):
            raise ValueError("vocabularies with unused pieces are not supported")
        if sp.encode("a  b", out_type=str)[0][:1] != BLANK or sp.decode(sp.encode(" a  b ")) != " a  b ":
            raise ValueError("the model must add a dummy prefix and keep blanks")
        self.id_of = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(sp.id_to_piece(i) != f"<0x{b:02X}>" for b, i in enumerate(self.byte_ids)):
            raise ValueError("the model must have byte pieces")
        self.symbol = dict(self.id_of)
        joined = [p for p in self.id_of if len(p) > 1]
        for p in joined:
            for c in p:
                self.symbol.setdefault(c, size + len(self.symbol))
        self._bare = {i: c for c, i in self.symbol.items() if i >= size}  # in pieces, but none themselves
        self.base = max(self.symbol.values()) + 1  # a character without symbol is base + its code point
        scores = sorted({-sp.get_score(self.id_of[p]) for p in joined})
        rank = {s: i for i, s in enumerate(scores)}
        keys = {}
        for p in joined:
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    keys[a * self.base + b] = (rank[-sp.get_score(self.id_of[p])], self.id_of[p])
        self.merge = keys
        self.keys = np.array(sorted(keys), dtype=np.int64)
        self.ranks = np.array([keys[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.merged = np.array([keys[k][1] for k in self.keys.tolist()], dtype=np.int64)
        self.no_pair = len(scores)
        inside = {c for p in joined for c in p}
        if any(BLANK in p.lstrip(BLANK) for p in joined) or "\n" in inside:
            raise ValueError("a piece reaches across blanks or lines: chunks can't be cut there")
        self.chunk = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")
        self.id_text = [str(i).encode() for i in range(size)]
        self.id_bytes = [p.replace(BLANK, " ").encode() for p in self.pieces]
        for i in special:
            self.id_bytes[i] = " ⁇ ".encode() if sp.is_unknown(i) else b""
        for b, i in enumerate(self.byte_ids):
            self.id_bytes[i] = bytes([b])
        self.cache: dict[str, tuple[bytes, bytes]] = {}

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def _ids(self, symbols: list[int]) -> list[int]:
        out = []
        for s in symbols:
            if s < len(self.pieces):
                out.append(s)
            else:
                c = chr(s - self.base) if s >= self.base else self._bare[s]
                out += [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]
        return out

    def _symbols(self, chunk: str) -> list[int]:
        get, base = self.symbol.get, self.base
        return [get(c, base + ord(c)) for c in chunk]

    def encode_chunk(self, chunk: str) -> list[int]:
        """One chunk by a heap of candidate pairs; stale candidates are skipped when they come up."""
        ids = self._symbols(chunk)
        n = len(ids)
        left, right, agenda = list(range(-1, n - 1)), list(range(1, n + 1)), []

        def propose(i: int) -> None:
            j = right[i]
            if j < n and ids[j] < self.base and (found := self.merge.get(ids[i] * self.base + ids[j])):
                heapq.heappush(agenda, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            propose(i)
        while agenda:
            _, i, a, b, new = heapq.heappop(agenda)
            j = right[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            propose(i)
            if left[i] >= 0:
                propose(left[i])
        return self._ids([s for s in ids if s >= 0])

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; the rank is ``no_pair`` where the pair is no piece."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0) & (b < self.base) & (a < self.base)
        return np.where(hit, self.ranks[at], self.no_pair), np.where(hit, self.merged[at], -1)

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Many short chunks: a row of symbols each, one merge for each row and turn."""
        n, width = len(chunks), max(map(len, chunks))
        ids = np.full((n, width + 1), -1, dtype=np.int64)
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=n)
        unique, code = np.unique(points, return_inverse=True)
        known = np.array([self.symbol.get(chr(p), self.base + p) for p in unique.tolist()], dtype=np.int64)
        ids[np.arange(width + 1) < sizes[:, None]] = known[code]
        rank, piece = self._look_up(ids[:, :-1], ids[:, 1:])
        done, column = np.zeros(n, dtype=bool), np.arange(width + 1)
        rows = np.arange(n)
        out: list = [None] * n
        while len(rows):
            best = rank.argmin(axis=1)
            each = np.arange(len(rows))
            done = rank[each, best] >= self.no_pair
            if done.any():
                ended, whole = rows[done], ids[done]
                odd = (whole >= len(self.pieces)).any(axis=1)
                for k, size, row in zip(ended.tolist(), sizes[ended].tolist(), whole.tolist()):
                    out[k] = row[:size]
                for k in ended[odd].tolist():
                    out[k] = self._ids(out[k])
                keep = ~done
                rows, ids, rank, piece, best = rows[keep], ids[keep], rank[keep], piece[keep], best[keep]
                if not len(rows):
                    break
                each = np.arange(len(rows))
            new = piece[each, best]
            sizes[rows] -= 1
            after = column[None, :-1] > best[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ids[each, best] = new
            shift = after[:, :-1]
            rank[:, :-1] = np.where(shift, rank[:, 1:], rank[:, :-1])
            piece[:, :-1] = np.where(shift, piece[:, 1:], piece[:, :-1])
            rank[:, -1], piece[:, -1] = self.no_pair, -1
            rank[each, best], piece[each, best] = self._look_up(new, ids[each, best + 1])
            inner = best > 0
            at = best[inner] - 1
            rank[each[inner], at], piece[each[inner], at] = self._look_up(ids[each[inner], at], new[inner])
            width = int(sizes[rows].max()) + 1
            if width + 4 < ids.shape[1]:
                ids, rank, piece, column = ids[:, :width], rank[:, : width - 1], piece[:, : width - 1], column[:width]
                ids, rank, piece = ids.copy(), rank.copy(), piece.copy()
        return out

    def checked(self, chunks: list[str], found: list[list[int]]) -> None:
        """The library must give the same ids for the chunks, put on lines of their own."""
        line = self.byte_ids[10]
        want = [self.id_of[BLANK]]
        for ids in found:
            want.append(line)
            want += ids
        got = self.library.encode("\n" + "\n".join(chunks).replace(BLANK, " "), num_threads=1)
        if got != want:
            raise ValueError("the ids differ from the library's")

    def learn(self, chunks: list[str]) -> None:
        """Encode the chunks that the cache lacks and check them."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.cache and c != "\n"]
        if "\n" not in self.cache:
            ids = [self.byte_ids[10]]
            self.cache["\n"] = (self.id_text[ids[0]], b"\n")
        short = sorted((c for c in new if len(c) <= WIDE), key=len)
        for start in range(0, len(short), 8192):
            part = short[start : start + 8192]
            self._remember(part, self.encode_chunks(part))
        for c in new:
            if len(c) > WIDE:
                self._remember([c], [self.encode_chunk(c)])

    def _remember(self, chunks: list[str], found: list[list[int]]) -> None:
        self.checked(chunks, found)
        text, raw = self.id_text.__getitem__, self.id_bytes.__getitem__
        for c, ids in zip(chunks, found):
            self.cache[c] = (b",".join(map(text, ids)), b"".join(map(raw, ids)))

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        chunks = self.chunks(text)
        self.learn(chunks)
        return [int(i) for c in chunks for i in self.cache[c][0].split(b",")]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, byte pieces as UTF-8, without the prefix; U+FFFD for each broken byte."""
        raw = b"".join(self.id_bytes[i] for i in ids)
        first = next((i for i in ids if self.id_bytes[i]), None)
        if first is not None and self.pieces[first].startswith(BLANK):
            raw = raw[1:]
        return raw.decode("utf-8", "each-broken-byte")

    def digests(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        """Number of ids, digest of the ids and digest of the decoded text, for each text."""
        cut = [self.chunks(t) for t in texts]
        if len(self.cache) > CACHED:
            self.cache.clear()
        self.learn([c for chunks in cut for c in chunks])
        counts, ids, decoded = [], [], []
        for chunks in cut:
            pairs = [self.cache[c] for c in chunks]
            joined = b",".join([p[0] for p in pairs])
            counts.append(joined.count(b",") + 1 if joined else 0)
            ids.append(hashlib.sha256(joined).hexdigest())
            decoded.append(hashlib.sha256(b"".join([p[1] for p in pairs])[1:]).hexdigest())
        return counts, ids, decoded


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """The worker's codec of a model file."""
    return PieceCodec(path)


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of every whole text. Null and empty texts have an empty list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            for a, b in slices([len(t) for t in texts], SLICE_CHARS):
                own = codec(model)
                if len(own.cache) > CACHED:
                    own.cache.clear()
                ids = pa.array([own.encode(t) for t in texts[a:b]], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), whole_text(text_col)).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = codec(model)
            text = pa.array([own.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def encoding_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text and return digests instead of the lists.

    ``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row for each row of ``docs``. A null text counts as
    empty: no ids, and the digests of nothing. Repeated rows give repeated results; an empty table gives an
    empty one; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            for a, b in slices([len(t) for t in texts], SLICE_CHARS):
                counts, ids, decoded = codec(model).digests(texts[a:b])
                columns = [batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), whole_text(text_col)).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
