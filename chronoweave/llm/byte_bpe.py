"""Byte-level BPE through sentencepiece: encode and decode.

A rank vocabulary (token bytes -> rank) is serialised as a sentencepiece BPE model: bytes become printable
characters one to one, each token is a piece with score -rank, and normalisation is the identity.  Merging the
adjacent pair with the best score is then merging the pair with the lowest rank.  Text is split into
pre-tokens first; each is encoded by itself.  Decoding maps the pieces' characters back to bytes.

Defined cases: null and empty text give no ids; a pre-token that is a vocabulary entry is that one id; text of any
length is encoded whole; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

#: Distinct pre-tokens that a Python worker remembers, and bytes of them and their ids, about; the memory is emptied beyond that.
REMEMBERED, REMEMBERED_BYTES = 400_000, 64 << 20

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> list[bytes]:
    """The token bytes of a rank file in the order of their ranks, which have to be 0, 1, 2 and so on."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (x.split() for x in lines if x.strip()))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks have gaps")
    return [token for _, token in pairs]


def byte_characters() -> str:
    """256 printable characters, one for each byte: bytes that print stand for themselves, others follow from 256 up."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(rest)) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 0x7F
        out.append(low | (0x80 if n else 0))
        if not n:
            return bytes(out)


def _field(number: int, value: int | bytes | float) -> bytes:
    """One protocol-buffer field: an int as varint, bytes by length, a float in 32 bits."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model in which piece i is token i; the unknown piece comes last."""
    chars = byte_characters()
    pieces = [
        _field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1))
        for rank, token in enumerate(tokens)
    ]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    # Trainer: model type BPE, vocabulary size, ids of the unknown, begin, end and padding pieces.
    trainer = _field(3, 2) + _field(4, len(tokens) + 1)
    trainer += _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    # Normaliser: identity, no prefix, white space neither removed nor escaped.
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder for one vocabulary and one pre-token pattern."""

    def __init__(self, tokens: list[bytes], pattern: str, remembered: int = REMEMBERED):
        self.tokens, self.remembered, self._bytes = tokens, remembered, 0
        self._split = regex.compile(pattern).findall
        self._model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        self._whole = {token: struct.pack("<I", rank) for rank, token in enumerate(tokens)}
        # latin-1 turns bytes into code points, and this table those into the pieces' characters.
        self._table = dict(enumerate(byte_characters()))
        self._known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        unknown, mapped = [], []
        for word in words:
            raw = word.encode()
            if (one := self._whole.get(raw)) is not None:
                self._known[word] = one
            else:
                unknown.append(word)
                mapped.append(raw.decode("latin-1").translate(self._table))
        if unknown:
            for word, ids in zip(unknown, self._model.encode(mapped, num_threads=1), strict=True):
                self._known[word] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        words = self._split(text)
        known = self._known
        new = [w for w in set(words) if w not in known]
        if new:
            if len(known) + len(new) > self.remembered or self._bytes > REMEMBERED_BYTES:
                known.clear()
                new, self._bytes = list(set(words)), 0
            self._learn(new)
            self._bytes += 8 * sum(map(len, new))
        return b"".join(map(known.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """The coder of a rank file, built once in a Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _loaded[path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, number of tokens, SHA-256 of the ids and of the bytes that they decode to, for each row of ``docs``.

    A narrow map over Arrow batches: nothing is shuffled, and a task holds one batch and a bounded memory of pre-tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py())
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
