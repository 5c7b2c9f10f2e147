import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm.pieces import WIDE, codec, decode_documents, encode_documents, encoding_digests

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  a", "a  b", "▁x ▁", "\n\n x ", " a\n\nb\t c ", "ﬁ①é é", "<s>x</s><0x0A>", "x" * 3000, "日本語 😀 한국어", "\r\n a", "a  b"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab thein\n▁é."), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_same_ids_and_text_as_the_library(text):
    own = codec(MODEL)
    ids = own.encode(text)
    assert ids == own.library.encode(text)
    assert own.decode(ids) == own.library.decode(ids)
    assert [i for c in own.chunks(text) for i in own.encode_chunk(c)] == ids


def test_heap_and_matrix_agree_on_long_chunks():
    own = codec(MODEL)
    chunk = "▁" + "internationalisierungs" * 5
    assert len(chunk) > WIDE
    assert own.encode_chunks([chunk, "▁a"])[0] == own.encode_chunk(chunk)


def test_broken_bytes_decode_as_in_the_library():
    own = codec(MODEL)
    for ids in ([own.byte_ids[0xE2], own.byte_ids[0x82]], [1, 2, 259], [], [28705, own.byte_ids[0xC3], 29351]):
        assert own.decode(ids) == own.library.decode(ids)


def test_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "y"), (0, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    library = codec(MODEL).library
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "")
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        want.append((i, len(ids), *digest))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted((tuple(r) for r in encoding_digests(docs, MODEL).collect()), key=key) == sorted(want, key=key)
    back = decode_documents(encode_documents(docs.dropna(subset=["doc_id"]), MODEL), MODEL).distinct().collect()
    assert {r.doc_id: r.text for r in back} == {i: library.decode(library.encode(t or "")) for i, t, _ in rows if i is not None}


def test_empty_table(spark):
    assert encoding_digests(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []


def test_missing_model_fails(spark):
    with pytest.raises(Exception):
        codec("/nowhere.model")
