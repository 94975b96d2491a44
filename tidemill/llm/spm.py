"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here; normaliser, metaspace marker, piece scores (unigram) or
merges (BPE) and byte fallback are rebuilt as a ``tokenizers.Tokenizer``. Whole texts are encoded and decoded in
batches by several threads, and every text's ids are held against the sentencepiece library's.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, tokens
from . import text as T

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed-size values and messages as bytes."""
    i = 0

    def varint(i: int) -> tuple[int, int]:
        x = shift = 0
        while True:
            x |= (b[i] & 127) << shift
            shift += 7
            i += 1
            if b[i - 1] < 128:
                return x, i

    while i < len(b):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            v, i = varint(i)
        else:
            n, i = {1: (8, i), 5: (4, i)}.get(kind) or varint(i)
            v, i = b[i : i + n], i + n
        yield tag >> 3, v


@dataclass(frozen=True)
class Model:
    """What a model file says: pieces (text, score, type) by id, and its options."""

    raw: bytes

    @cached_property
    def _parsed(self) -> tuple[list[tuple[str, float, int]], dict, dict]:
        pieces, trainer, normalizer = [], {}, {}
        for f, v in _fields(self.raw):
            if f == 1:
                d = dict(_fields(v))
                pieces.append((d[1].decode(), struct.unpack("<f", d.get(2, bytes(4)))[0], d.get(3, NORMAL)))
            elif f == 2:
                trainer = dict(_fields(v))
            elif f == 3:
                normalizer = dict(_fields(v))
        return pieces, trainer, normalizer

    @property
    def pieces(self) -> list[tuple[str, float, int]]:
        return self._parsed[0]

    @property
    def kind(self) -> int:
        return self._parsed[1].get(3, UNIGRAM)

    @property
    def byte_fallback(self) -> bool:
        return bool(self._parsed[1].get(35, 0))

    @property
    def unk_id(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @property
    def charsmap(self) -> bytes:
        return self._parsed[2].get(2, b"")

    @property
    def dummy_prefix(self) -> bool:
        return bool(self._parsed[2].get(3, 1))

    @property
    def squeeze(self) -> bool:
        """Whether leading, trailing and repeated spaces go."""
        return bool(self._parsed[2].get(4, 1))

    @cached_property
    def merges(self) -> list[tuple[str, str]]:
        """Every way to make a piece of two, the best piece first."""
        ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        found = []
        for p, score, kind in self.pieces:
            if kind in (NORMAL, USER):
                found += [(-score, ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        return [(a, b) for *_, a, b in sorted(found)]


def build(model: Model):
    """The tokenizer: normaliser, metaspace marks, pieces with scores or merges, byte fallback, decoder."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if model.kind == BPE:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, model.merges, unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk_id, model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    tok = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tok.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    tail = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tok


class Encoder:
    """Encodes and decodes batches of whole texts on several threads, and holds the ids against the sentencepiece library's."""

    def __init__(self, model: Model, threads: int = 2) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        self.tok, self.threads = build(model), threads
        self.other = sentencepiece.SentencePieceProcessor(model_proto=model.raw)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """Each whole text's ids, and whether both libraries agree on them; where they do not, the ids are the model's own library's."""
        ours = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        known = self.other.encode(texts, num_threads=self.threads)
        return known, [a == b for a, b in zip(ours, known, strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)


#: Bytes of texts that are encoded at once.
ENCODED = 1 << 20


def _encoder(raw_model: bytes, threads: int) -> Encoder:
    return tokens.kept(("sentencepiece", raw_model, threads), lambda: Encoder(Model(raw_model), threads))


def encode_documents(docs: DataFrame, raw_model: bytes, *, threads: int = 2) -> DataFrame:
    """doc_id, n_tokens, ids, ids_crc32, round_trip and parity of every row.

    ``parity``: the rebuilt tokenizer and the sentencepiece library give the whole text the same ids; where they do not, the
    latter's are returned. ``round_trip``: the sentencepiece library turns the ids back into the text (always so with byte fallback,
    unless the normaliser changes the text). A null or empty text has no ids and both are true. Repeated rows stay repeated, a null doc_id stays null,
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(raw_model, threads)
        for b in batches:
            for s in T.slices(b.column(1), ENCODED):
                texts = pc.fill_null(b.column(1).slice(s.first, s.n), "").to_pylist()
                ids, same = enc.encode(texts)
                back = enc.other.decode(ids)
                count = np.fromiter(map(len, ids), np.int64, len(ids))
                end = np.cumsum(count)
                flat = np.fromiter((x for y in ids for x in y), np.int32, int(count.sum()))
                raw = memoryview(flat.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(s.first, s.n),
                        pa.array(count),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]), pa.int32()), pa.array(flat, pa.int32())),
                        pa.array([zlib.crc32(raw[4 * (j - n) : 4 * j]) for n, j in zip(count, end, strict=True)], pa.int64()),
                        pa.array([x == y for x, y in zip(back, texts, strict=True)], pa.bool_()),
                        pa.array(same, pa.bool_()),
                    ],
                    ["doc_id", "n_tokens", "ids", "ids_crc32", "round_trip", "parity"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(base.frugal(run), f"doc_id {kind}, n_tokens long, ids array<int>, ids_crc32 long, round_trip boolean, parity boolean")


def decode_documents(encoded: DataFrame, raw_model: bytes, *, threads: int = 2) -> DataFrame:
    """doc_id and text of every row of ``encoded`` (doc_id, ids); null ids give a null text, no ids an empty one.

    Null ids inside a list are left out; an id that the model does not have is an error. Repeated rows stay repeated, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(raw_model, threads)
        most = enc.other.get_piece_size()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rows = part.column(1).to_pylist()
                ids = [[x for x in r or [] if x is not None] for r in rows]
                if any(not 0 <= x < most for r in ids for x in r):
                    raise ValueError(f"ids must be from 0 to {most - 1}")
                texts = [None if r is None else t for r, t in zip(rows, enc.decode(ids), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(base.frugal(run), f"doc_id {kind}, text string")
