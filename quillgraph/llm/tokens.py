"""Encoding of texts with a public byte-level BPE vocabulary (problem 8).

The vocabulary file (``rank`` per byte string) is rewritten as a sentencepiece
BPE model: every token becomes a piece of printable characters, one character
for each byte, with the negative rank as its score, and the normaliser is the
identity. Merging the adjacent pair with the best score is then the same as
merging the pair with the lowest rank, so ids are the vocabulary's own ids.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie if no path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the vocabulary's split pattern for pre-tokens.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens whose ids a worker keeps; when full the memory starts anew.
REMEMBERED = 500_000


def byte_characters() -> list[str]:
    """One printable character for each byte: printable Latin-1 bytes stand for
    themselves, the others are numbered from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file in the order of their ids."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"the ranks of {path} are not 0..n-1")
    return [ranks[i] for i in range(len(ranks))]


def _varint(number: int) -> bytes:
    out = bytearray()
    while number > 0x7F:
        out.append(number & 0x7F | 0x80)
        number >>= 7
    out.append(number)
    return bytes(out)


def _bytes_field(tag: int, value: bytes) -> bytes:
    return _varint(tag << 3 | 2) + _varint(len(value)) + value


def _int_field(tag: int, value: int) -> bytes:
    return _varint(tag << 3) + _varint(value & 0xFFFFFFFFFFFFFFFF)


def bpe_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model whose piece ids are the positions in ``tokens``.

    Fixed values, from the public protobuf schema: ModelProto has pieces in
    field 1, the trainer's settings in 2 and the normaliser's in 3; a piece has
    its text in 1, score in 2 and type in 3 (1 normal, 2 unknown); the trainer
    has the model type in 3 (2 is BPE) and unk, bos, eos, pad ids in 40 to 43;
    the normaliser has its name in 1, dummy prefix in 3, blank removal in 4 and
    blank escaping in 5.
    """
    letters = byte_characters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        text = "".join(letters[b] for b in token).encode()
        out += _bytes_field(1, _bytes_field(1, text) + b"\x15" + struct.pack("<f", -float(rank)) + _int_field(3, 1))
    out += _bytes_field(1, _bytes_field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _int_field(3, 2))
    trainer = _int_field(3, 2) + _int_field(40, len(tokens)) + b"".join(_int_field(tag, -1) for tag in (41, 42, 43))
    normaliser = _bytes_field(1, b"identity") + b"".join(_int_field(tag, 0) for tag in (3, 4, 5))
    return bytes(out + _bytes_field(2, trainer) + _bytes_field(3, normaliser))


class Codec:
    """Encodes and decodes texts with a model of :func:`bpe_model`."""

    def __init__(self, model: bytes, pattern: str = PATTERN) -> None:
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        letters = byte_characters()
        self.to_letters = {b: ord(c) for b, c in enumerate(letters)}
        self.to_byte = {c: b for b, c in enumerate(letters)}
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """The ids of one text; the empty list for an empty text and for None."""
        if not text:
            return []
        known, words = self.known, self.split(text)
        new = [w for w in {*words} if w not in known]
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list({*words})
            mapped = [w.encode().decode("latin-1").translate(self.to_letters) for w in new]
            known.update(zip(new, self.model.encode(mapped, num_threads=1)))
        ids: list[int] = []
        for word in words:
            ids += known[word]
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, through the inverse mapping of characters to bytes."""
        pieces = "".join(self.model.id_to_piece(int(i)) for i in ids)
        return bytes(self.to_byte[c] for c in pieces).decode()


_codecs: dict[int, Codec] = {}


def _codec(model: bytes, pattern: str) -> Codec:
    key = hash((model, pattern))
    if key not in _codecs:
        _codecs[key] = Codec(model, pattern)
    return _codecs[key]


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``(key, ids)`` of every row of ``df``, without special tokens.

    A narrow step: one pass over ``key`` and ``text``, no shuffle. The model
    (about 1 MB, the size of the vocabulary) is broadcast, so executors need no
    file. Null and empty texts give the empty list, a blank text its own ids;
    repeated rows stay repeated; an empty table gives an empty table; other
    columns, whatever their names, are not read.
    """
    model = df.sparkSession.sparkContext.broadcast(bpe_model(read_ranks(vocabulary)))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        codec = _codec(model.value, pattern)
        for batch in batches:
            lists = [codec.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for ids in lists for i in ids), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``(key, text)``: the inverse of :func:`encode_corpus` (null texts come back empty)."""
    model = df.sparkSession.sparkContext.broadcast(bpe_model(read_ranks(vocabulary)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = _codec(model.value, pattern)
        for batch in batches:
            texts = [codec.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
