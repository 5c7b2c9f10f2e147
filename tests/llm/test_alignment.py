import hashlib
from collections import Counter
from functools import lru_cache

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracewell.llm import alignment
from tracewell.llm.alignment import aligned_documents, aligner, byte_of_letter, packed, token_ends, unpacked

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "a", "a", "  a  b ", "Iechä 日本𝄞.\nErst, it's 12 <|endoftext|> <s></s> x", "ab ▁ cd", "\n\nx \n y", "a\x1cb \x00 c", "  　z\t",
         "é ﬁ①\r\nq", "The cat. " * 300, "😀 😀😀\n😀"]


@lru_cache
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_tokens(text):
    """Ids and bytes of whole texts, straight from the libraries; None without tokens."""
    a, b = libraries()
    if not text:
        return None
    letters = byte_of_letter()
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_raw = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
    b_raw = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    want = (" " + text).encode()
    return (a_ids, a_raw, b_ids, b_raw) if b"".join(a_raw) == want == b"".join(b_raw) else None


def spans(raw):
    at, out = 0, []
    for x in raw:
        out.append((at, at + len(x)))
        at += len(x)
    return out


def brute(texts):
    """Every pair of tokens of every text compared, counts over all texts."""
    found, counts = [], Counter()
    for text in texts:
        tokens = plain_tokens(text)
        if tokens is None:
            found.append(None)
            continue
        a_ids, a_raw, b_ids, b_raw = tokens
        a, b = spans(a_raw), spans(b_raw)
        links = [(a_ids[i], b_ids[j]) for i, (p, q) in enumerate(a) for j, (r, s) in enumerate(b) if p < s and r < q]
        counts.update(links)
        cuts = sorted({q for _, q in a} & {s for _, s in b})
        groups, low = [], 0
        for cut in cuts:
            groups.append([[i for i, (_, e) in zip(ids, own) if low < e <= cut] for ids, own in ((a_ids, a), (b_ids, b))])
            low = cut
        found.append((a_ids, b_ids, groups, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a_ids, b_ids, groups, links = f
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a_ids), len(b_ids), len(groups), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links),
                    hashlib.sha256(text.encode()).hexdigest()))
    return out


def result(frame):
    return sorted(((r["doc_id"], *list(r)[1:]) for r in frame.collect()), key=str)


def test_rows_equal_brute_force(spark):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, slice string, block int").repartition(5)
    assert result(aligned_documents(docs, A, B)) == sorted(((k, *r) for k, r in enumerate(brute(TEXTS))), key=str)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("length(text) < 2500")
    rows = sorted(docs.collect())
    assert result(aligned_documents(docs, A, B)) == sorted(((r[0], *x) for r, x in zip(rows, brute([r[1] for r in rows]))), key=str)


def test_many_slices_and_groups(spark, monkeypatch):
    """Counts are those of the corpus, however documents fall into slices and slices into groups."""
    for name, value in (("SLICE_CHARS", 40), ("SLICES_A_GROUP", 2), ("HELD_PAIRS", 5), ("CACHED", 10)):
        monkeypatch.setattr(alignment, name, value)
    texts = [t for t in TEXTS if t is None or len(t) < 200] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    assert result(aligned_documents(docs, A, B)) == sorted(((k, *r) for k, r in enumerate(brute(texts))), key=str)


def test_odd_tables(spark):
    empty = aligned_documents(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [list(r)[1:] for r in aligned_documents(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B).collect()] == [[0, 0, 0, 0, 0, 0, ""]]
    twice = aligned_documents(spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "x" * 200_000)], "doc_id long, text string"), A, B).collect()
    assert sorted(r["doc_id"] is None for r in twice) == [False, True, True]
    assert [list(r) for r in twice if r["doc_id"] is None] == [[None, 2, 2, 2, 2, 2, 4, hashlib.sha256(twice_groups().encode()).hexdigest()]] * 2


def twice_groups():
    a_ids, _, b_ids, _ = plain_tokens("a b")
    return ";".join(f"{a}|{b}" for a, b in zip(a_ids, b_ids))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab theE.,'s1\n\r\t ▁é日😀"), st.characters(exclude_categories=["Cs"])), min_size=1, max_size=50))
def test_segments_give_the_tokens_of_whole_texts(text):
    own = aligner(A, B)
    parts = own.cut.split(" " + text)
    found, want = list(own.align(parts)), plain_tokens(text)
    if want is None:
        assert None in found
    else:
        assert [i for f in found for i in f[0]] == want[0] and [i for f in found for i in f[1]] == want[2]


def test_spans_are_refined_inside_characters():
    own = aligner(A, B)
    a_ids, b_ids, groups, links = next(own.align([" 𝄞"]))
    sizes = [len(own.b_bytes[i]) for i in b_ids]
    assert sizes == [1] * 5 and len(links) >= len(b_ids)
    assert token_ends([1, 1, 1, 1, 5], [1, 2, 3, 4, 5]) == [1, 2, 3, 4, 5]
    import numpy as np

    numbers = np.array([0, 1, 2**31, 5])
    assert unpacked(packed(numbers, 4), 4).tolist() == numbers.tolist()
    with pytest.raises(ValueError):
        alignment.Aligner(public_tokenizers.path("word_bpe_49k.json"), B)
