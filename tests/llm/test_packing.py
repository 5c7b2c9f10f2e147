import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tracewell.llm.packing import best_fit_decreasing, bins_needed, pack, packed_documents, token_pieces, word_ids

WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \n", "It's a test. " * 900, "Ünï cödé é 日本 語 12 345!?", "<|endoftext|> x<|startoftext|>", "\x1ca\x1fb", "a", "a"]


def check(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        spans.sort()
        at = 0
        for offset, length in spans:
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_words_give_the_ids_of_whole_texts():
    library = Tokenizer.from_file(WORDS)
    rng = random.Random(4)
    made = ["".join(rng.choice("aB é́\n \x85'sII1.,ß日\x1d") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts = [t or "" for t in TEXTS] + made
    for text, raw in zip(texts, word_ids(WORDS).of(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_best_fit_and_bounds():
    rng = np.random.default_rng(1)
    for size in (10, 64, 2048):
        for n in (0, 1, 7, 300):
            lengths = rng.integers(1, size + 1, n)
            bins = best_fit_decreasing(lengths, size)
            assert (np.bincount(bins, weights=lengths) <= size).all() if n else len(bins) == 0
            used = len(np.unique(bins))
            assert -(-int(lengths.sum()) // size) <= bins_needed(lengths, size) <= used <= 11 / 9 * bins_needed(lengths, size) * 1.3 + 1
    assert bins_needed(np.array([6, 6, 6]), 10) == 3  # more than half each, though 18 tokens fit two
    assert bins_needed(np.array([4] * 6), 10) == 3


def test_exchange_closes_gaps(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 50), 0, 0, rng.randint(1, 90), 7) for _ in range(900)] + [(1, 0, 0, 40, 7)] * 300
    items = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out, certificate = pack(items, size=100, items_per_part=60, fan_in=3, give=6)
    found = out.collect()
    assert sorted(tuple(r)[:5] for r in found) == sorted(rows)
    assert len(certificate) > 1
    first = certificate[0]["sequences"]
    used = check(found, 100)
    assert bins_needed(np.array([r[3] for r in rows]), 100) <= used <= first


def test_documents(spark):
    rows = [(i if i else None, t, 3) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    library = Tokenizer.from_file(WORDS)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), 64)):
            part = ids[start : start + 64]
            want.append((i, piece, start, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    found = packed_documents(docs, WORDS, 64).collect()
    assert sorted(map(str, (tuple(r)[:5] for r in found))) == sorted(map(str, want))
    check(found, 64)
    ids = token_pieces(docs, WORDS, 64, with_ids=True).where("doc_id = 7").first()["ids"]
    assert ids == library.encode("a", add_special_tokens=False).ids + [0]


def test_empty_table(spark):
    assert packed_documents(spark.createDataFrame([], "doc_id long, text string"), WORDS).collect() == []
