"""Encoding whole texts with a public byte-level BPE vocabulary (problem 7).

A sentencepiece BPE model is serialised directly from the vocabulary: every token's bytes are mapped to
printable characters, its score is its negative rank, and the normalisation is the identity. Texts are
cut into pre-tokens; each distinct pre-token is encoded once per worker and remembered.

The model travels with the task (about 1 MB, fixed by the vocabulary), so the vocabulary file is needed
on the driver only. Defined results: null and empty texts have no tokens (an empty list); special tokens
are never produced, their strings are ordinary text.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.session import spread

TOKENIZERS = "/opt/tokenizers"
# fixed value: how byte-level BPE vocabularies of this family cut text before merging
PRE_TOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 400_000


def byte_letters() -> list[str]:
    """A printable character for each byte: bytes that print stand for themselves, the rest follow from U+0100."""
    stand = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(stand) else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id, from a .tiktoken file of ranks or a tokenizers .json file."""
    if path.endswith(".tiktoken"):
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    back = {c: b for b, c in enumerate(byte_letters())}
    spec = json.loads(Path(path).read_text("utf-8"))
    special = {x["content"] for x in spec["added_tokens"]}
    return {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model (protobuf wire format) whose piece ids are the ranks; the unknown piece comes last."""
    letters = byte_letters()
    by_id = sorted(ranks.items(), key=lambda x: x[1])
    if [i for _, i in by_id] != list(range(len(by_id))):
        raise ValueError("token ids must be 0..n-1")
    pieces = [_field(1, _field(1, "".join(letters[b] for b in t).encode()) + b"\x15" + struct.pack("<f", -float(i))) for t, i in by_id]
    unknown = _field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _flag(3, 2))
    trainer = _flag(3, 2) + _flag(4, len(by_id) + 1) + _flag(40, len(by_id)) + b"".join(_varint(n << 3) + _varint((1 << 64) - 1) for n in (41, 42, 43))
    identity = _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, identity)


class Codec:
    """Encodes and decodes with a serialised model; one per Python worker."""

    _made: dict[int, Codec] = {}

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(PRE_TOKEN)
        self.to = {b: c for b, c in enumerate(byte_letters())}
        self.back = {c: b for b, c in self.to.items()}
        self.known: dict[str, list[int]] = {}

    @classmethod
    def of(cls, model: bytes) -> Codec:
        key = hash(model)
        if key not in cls._made:
            cls._made[key] = cls(model)
        return cls._made[key]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of a batch."""
        cut = [self.cut.findall(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if new := list({p for ps in cut for p in ps if p not in self.known}):
            mapped = [p.encode("utf-8").decode("latin-1").translate(self.to) for p in new]
            self.known.update(zip(new, self.sp.encode(mapped, num_threads=1), strict=True))
        known, offsets, ids = self.known, np.zeros(len(texts) + 1, np.int32), []
        for i, ps in enumerate(cut):
            for p in ps:
                ids += known[p]
            offsets[i + 1] = len(ids)
        return offsets, np.array(ids, np.int32)

    def decode(self, ids: list[int]) -> str:
        return bytes(self.back[c] for i in ids for c in self.sp.id_to_piece(int(i))).decode("utf-8", "replace")


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", check: bool = False) -> DataFrame:
    """key and ids (array<int>) per row; with check also round_trip: whether decoding gives the text back."""
    model = serialise(read_ranks(vocabulary))
    rows = df.select(F.col(key), F.col(text).alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                offsets, ids = codec.encode(texts)
                out = [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))]
                if check:
                    out.append(pa.array([codec.decode(ids[a:b]) == (t or "") for t, a, b in zip(texts, offsets, offsets[1:], strict=False)]))
                yield pa.RecordBatch.from_arrays(out, names=[key, "ids", "round_trip"][: len(out)])

    return spread(rows).mapInArrow(run, f"`{key}` {kind}, ids array<int>" + ", round_trip boolean" * check)
