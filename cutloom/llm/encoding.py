"""Encoding of a corpus with a public byte-level BPE vocabulary, run as a sentencepiece model built from the vocabulary.

Each token of the vocabulary becomes a piece: its bytes are mapped to visible characters, its score is its negative rank, and
normalisation is the identity. Merging the best-scored neighbours is then the same as merging by rank. Texts are split into
pre-tokens by the vocabulary's pattern, mapped, encoded, and decoded by the inverse map.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutloom.session import spread

#: Where the public vocabularies lie, unless another folder is given.
TOKENIZER_DIR = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"

#: Fixed value: the public pattern that splits text into pre-tokens for this vocabulary.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens whose ids a worker remembers at least; it holds at most twice as many and those of one text.
CACHE = 200_000


def byte_chars() -> list[str]:
    """A visible character for each byte: printable Latin-1 ones stand for themselves, the others come after U+00FF in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer message: bytes and messages by length, ints as varint, floats as fixed 32 bits."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def load_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank from a file of lines 'base64 rank'."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


@lru_cache(maxsize=4)
def build_model(path: str) -> bytes:
    """The serialised sentencepiece BPE model of a rank file; the id of a piece is its rank, one unknown piece comes last."""
    chars, tokens = byte_chars(), load_ranks(path)
    pieces = b"".join(_field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1)) for rank, token in enumerate(tokens))
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + unknown + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Encodes and decodes texts; made once per worker from the serialised model."""

    def __init__(self, model: bytes) -> None:
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(PRE_TOKEN).findall
        self.map = {i: c for i, c in enumerate(byte_chars())}
        self.inverse = {c: i for i, c in self.map.items()}
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; the empty list for null and empty ones. Strings of special tokens are ordinary text."""
        if not text:
            return []
        known, parts = self.known, self.split(text)
        missing = {p for p in parts if p not in known}
        if missing:
            if len(known) > CACHE:  # what is still in use comes back from the older half
                self.older, self.known = known, (known := {})
                missing = set(parts)
            known.update((p, self.older[p]) for p in missing if p in self.older)
            missing = [p for p in missing if p not in known]
            mapped = [p.encode().decode("latin-1").translate(self.map) for p in missing]
            known.update(zip(missing, self.processor.encode(mapped, out_type=int, num_threads=1), strict=True))
        return [i for p in parts for i in known[p]]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, by the inverse map."""
        return bytes(self.inverse[c] for i in ids for c in self.processor.id_to_piece(int(i))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _encoder(model: bytes) -> Encoder:
    return Encoder(model)


def _path(path: str | None) -> str:
    return path or f"{TOKENIZER_DIR}/{BYTE_BPE_50K}"


def token_ids(text: Column, path: str | None = None) -> Column:
    """ARRAY<INT> of ids of a text column; the empty array for null and empty texts."""
    model = build_model(_path(path))

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(model)
        for texts in batches:
            yield pd.Series([encoder.encode(t) for t in texts], dtype=object)

    return run(text)


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of tokens of a text column; 0 for null and empty texts. Not moved by the optimiser: a filter on it does not count again."""
    model = build_model(_path(path))

    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(model)
        for texts in batches:
            yield pd.Series([len(encoder.encode(t)) for t in texts], dtype="int64")

    return run.asNondeterministic()(text)


def token_text(ids: Column, path: str | None = None) -> Column:
    """The text of a column of ids, by the inverse map; the empty text for null and empty arrays."""
    model = build_model(_path(path))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(model)
        for rows in batches:
            yield pd.Series([encoder.decode(x) if x is not None else "" for x in rows], dtype=object)

    return run(ids)


def encode_corpus(df: DataFrame, *, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """id and ids of every row, whole texts, in place: no shuffle. Repeated rows stay; other columns are left out."""
    return spread(df.select(id_col, text_col)).select(F.col(id_col), token_ids(F.col(text_col), path).alias("ids"))
