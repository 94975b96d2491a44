"""Token units, packing and SentencePiece against the libraries."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemill.llm import packing, queries, spm, tokens
from tidemill.llm import text as T

SPEC = queries.byte_bpe_spec()
TOK = Tokenizer.from_str(SPEC)
RAW = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
LIB = sentencepiece.SentencePieceProcessor(model_proto=RAW)
TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \n\t'abzAZ019.,-_\u00a0\u2003\u3000é漢\U0001f600▁"), st.characters(exclude_categories=("Cs",))), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_units_encode_like_whole_texts(texts):
    for s in T.slices(pa.array(texts)):
        whole = tokens.has_wide_space(s)
        doc, start, size = tokens.byte_level_units(s)
        assert int(size.sum()) == len(s.buf)
        for i in range(s.n):
            if not whole[i]:
                got = [x for a, n in zip(start[doc == i], size[doc == i], strict=True) for x in TOK.encode(s.buf[a : a + n].tobytes().decode(), add_special_tokens=False).ids]
                assert got == TOK.encode(texts[s.first + i], add_special_tokens=False).ids


def check_packing(rows, texts, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in texts.items():
        ids = np.array([*TOK.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            assert r.length == capacity or k == 0
            at += r.length
        assert at == len(ids)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(bins)


def test_packing_round_trip_and_waste(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op10_best_fit_packing(spark, sf).collect()
    n = check_packing(rows, texts, 1024)
    assert n <= -(-sum(r.length for r in rows) // 1024) * 1.02 + 1


def test_packing_edges(spark, edge_docs):
    one = edge_docs.where("doc_id <> 1 AND doc_id IS NOT NULL")
    rows = packing.pack(one, SPEC, capacity=64).collect()
    check_packing(rows, {r.doc_id: r.text for r in one.collect()}, 64)
    assert packing.pack(edge_docs, SPEC).where("doc_id = 1").count() == 2
    assert packing.pack(edge_docs, SPEC).where("doc_id IS NULL").count() == 1
    assert packing.pack(edge_docs.limit(0), SPEC).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_patterns_use_every_piece_once(lengths):
    h = np.bincount(lengths, minlength=21)
    used = np.zeros(21, int)
    for pack, times in packing.best_two_fit(h, 20):
        assert sum(pack) <= 20 and times > 0
        np.add.at(used, pack, times)
    assert (used == h).all()


def test_two_documents_replace_the_smallest():
    # 12 + 6 leaves 2; without the 6, a 5 and a 3 fill the sequence
    assert packing.best_two_fit(np.bincount([12, 6, 5, 3], minlength=21), 20)[0] == ([12, 5, 3], 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_sentencepiece_parity_and_round_trip(texts):
    enc = _encoder()
    ids, same = enc.encode(texts)
    assert ids == LIB.encode(texts)
    for t, x, back, ok in zip(texts, ids, enc.decode(ids), same, strict=True):
        assert ok == (enc.tok.encode(t, add_special_tokens=False).ids == x)
        if "▁" not in t:
            assert back == t


_ENC = []


def _encoder():
    if not _ENC:
        _ENC.append(spm.Encoder(spm.Model(RAW)))
    return _ENC[0]


def test_rebuilt_tokenizer_encodes_and_decodes_whole_texts():
    tok = spm.build(spm.Model(RAW))
    for t in ("Hello world", "  two  spaces", "naïve 漢字 \U0001f600\n\ttab"):
        assert tok.encode(t, add_special_tokens=False).ids == LIB.encode(t)
        assert tok.decode(LIB.encode(t)) == t


def test_sentencepiece_rows(spark, edge_docs):
    rows = spm.encode_documents(edge_docs, RAW).collect()
    assert len(rows) == edge_docs.count() and all(r.round_trip for r in rows)
    texts = {r.doc_id: r.text for r in edge_docs.collect()}
    for r in rows:
        assert list(r.ids) == LIB.encode(texts[r.doc_id] or "") and r.n_tokens == len(r.ids)
    assert sum(not r.parity for r in rows) <= 1
    assert spm.encode_documents(edge_docs.limit(0), RAW).count() == 0


def test_decoded_rows(spark, edge_docs):
    encoded = spm.encode_documents(edge_docs, RAW)
    back = sorted(((r.doc_id, r.text) for r in spm.decode_documents(encoded, RAW).collect()), key=str)
    assert back == sorted(((r.doc_id, r.text or "") for r in edge_docs.collect()), key=str)
    odd = spark.createDataFrame([(1, None, 0), (2, [], 0), (None, [15043, None], 0)], "doc_id long, ids array<int>, text int")
    assert [(r.doc_id, r.text) for r in spm.decode_documents(odd, RAW).collect()] == [(1, None), (2, ""), (None, LIB.decode([15043]))]
    with pytest.raises(Exception, match="from 0 to"):
        spm.decode_documents(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), RAW).collect()


def test_disagreement_shows_and_yields_the_models_own_ids(monkeypatch):
    enc = spm.Encoder(spm.Model(RAW))
    enc.tok = spm.build(spm.Model(RAW.replace("▁the".encode(), "▁thz".encode(), 1)))
    ids, same = enc.encode(["the cat", "cats"])
    assert ids == LIB.encode(["the cat", "cats"]) and same == [False, True]


def _message(n, body):
    size, out = len(body), b""
    while size > 127:
        out, size = out + bytes([size & 127 | 128]), size >> 7
    return bytes([n << 3 | 2]) + out + bytes([size]) + body


def test_a_unigram_model_of_full_size(spark):
    """The public file's pieces under a unigram model, with byte fallback, against the model's own library on the documents."""
    m = spm.Model(RAW)
    raw = b""
    for i, (piece, _, kind) in enumerate(m.pieces):
        body = _message(1, piece.encode()) + bytes([2 << 3 | 5]) + np.float32(-np.log(i + 10.0) * 2).tobytes()
        raw += _message(1, body + (bytes([3 << 3, kind]) if kind != spm.NORMAL else b""))
    for f, v in spm._fields(RAW):
        if f == 2:
            raw += _message(2, v + bytes([3 << 3, spm.UNIGRAM]))  # the last value of a field counts
        elif f == 3:
            raw += _message(3, v)
    own = sentencepiece.SentencePieceProcessor(model_proto=raw)
    assert spm.Model(raw).kind == spm.UNIGRAM and spm.Model(raw).byte_fallback
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 120")
    rows = spm.encode_documents(docs, raw).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(list(r.ids) == own.encode(texts[r.doc_id] or "") for r in rows)
    assert sum(r.parity for r in rows) >= 0.95 * len(rows) and all(r.round_trip for r in rows)


def test_unigram_model_is_rebuilt(tmp_path):
    def field(n, kind, body):
        return bytes([n << 3 | kind]) + body

    def piece(text, score, kind=1):
        t = text.encode()
        body = field(1, 2, bytes([len(t)]) + t) + field(2, 5, np.float32(score).tobytes()) + field(3, 0, bytes([kind]))
        return field(1, 2, bytes([len(body)]) + body)

    raw = piece("<unk>", 0, 2) + piece("▁a", -1) + piece("b", -2) + piece("▁ab", -1.5) + field(2, 2, bytes([2]) + field(3, 0, bytes([1])))
    m = spm.Model(raw)
    assert m.kind == spm.UNIGRAM and m.unk_id == 0
    assert spm.build(m).encode("ab a").ids == [3, 1]


def test_unknown_model_type_is_an_error():
    with pytest.raises(ValueError, match="neither"):
        spm.build(spm.Model(b"\x0a\x05\x0a\x01a\x18\x02\x12\x02\x18\x03"))
