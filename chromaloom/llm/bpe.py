"""Byte-level BPE encoding and decoding on a sentencepiece model built from a rank file.

The model is serialised straight from the vocabulary: each token's bytes are
mapped to one printable character apiece, its score is its negative rank, and
the normaliser leaves texts as they are.  A text is cut into pre-tokens; each is
looked up whole and else encoded by the model; decoding maps ids back to bytes.

The pattern's character classes are those of the pattern library; a test holds
every code point against the reference tokenizer, so that a library with newer
tables is noticed.

Defined cases: a null text encodes like an empty one (no ids); lone surrogates
cannot occur in Arrow strings; texts are processed whole, whatever their length;
repeated rows give a row each; an empty table gives an empty result; columns
that bear the names of those added give way to them.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches_of

#: Columns that encoding adds.
ADDED = ("n_tokens", "ids_sha256", "decoded_sha256", "token_ids")
#: Pre-tokens kept with their ids by each Python worker; when full, only those of the batch at hand stay.
REMEMBERED = 200_000
#: Characters at most of a remembered pre-token.
LONGEST_REMEMBERED = 64


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable, else the next one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as file:
        found = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in file if line.strip())}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must be 0 to n-1")
    return [found[i] for i in range(len(found))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol-buffer field: bytes, int (varint) or float (32 bits)."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised BPE model: piece 0 is unknown, piece r + 1 has rank r."""
    chars = byte_characters()
    unknown, bpe = 2, 2
    out = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))]
    out += (_field(1, _field(1, "".join(map(chars.__getitem__, t)).encode()) + _field(2, float(-rank))) for rank, t in enumerate(tokens))
    # TrainerSpec: model_type, vocab_size, hard_vocab_limit, unk_id, bos_id, eos_id, pad_id (-1: none)
    none = (1 << 64) - 1
    trainer = _field(3, bpe) + _field(4, len(tokens) + 1) + _field(40, 0) + _field(41, none) + _field(42, none) + _field(43, none)
    # NormalizerSpec: name, add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes texts to ids and back.  ``pattern`` cuts texts into pre-tokens."""

    def __init__(self, tokens: list[bytes], pattern: str, model: bytes | None = None):
        import regex
        import sentencepiece

        self.tokens = tokens
        self.whole = {t: rank for rank, t in enumerate(tokens)}
        self.cut = regex.compile(_exact_space(pattern)).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model or sentencepiece_model(tokens))
        self.chars = dict(enumerate(byte_characters()))
        self.known: dict[str, tuple[int, ...]] = {}
        self.numbers = list(self.whole.values())  # one object for each id

    def _learn(self, tokens: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of pre-tokens: looked up whole, the others encoded by the model in one call."""
        found, rest, number = {}, [], self.numbers
        for token in tokens:
            rank = self.whole.get(token.encode())
            if rank is None:
                rest.append(token)
            else:
                found[token] = (rank,)
        for token, pieces in zip(rest, self.pieces.encode([t.encode().decode("latin-1").translate(self.chars) for t in rest], num_threads=1) if rest else [], strict=True):
            found[token] = tuple([number[i - 1] for i in pieces])
        return found

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text."""
        cuts = [self.cut(t) if t else [] for t in texts]
        used: set[str] = set().union(*cuts)
        here = self.known
        if new := used.difference(here):
            ids = self._learn(new)
            long = {t: i for t, i in ids.items() if len(t) > LONGEST_REMEMBERED}
            if len(here) + len(ids) > REMEMBERED:  # what this batch needs stays; the rest goes
                here = self.known = {t: v for t, v in here.items() if t in used}
            here.update(ids)
            if long:
                here = dict(here)
                for t in long:
                    del self.known[t]
        get = here.__getitem__
        return [list(chain.from_iterable(map(get, tokens))) for tokens in cuts]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _exact_space(pattern: str) -> str:
    """The same pattern with Unicode's White_Space for \\s; this library's \\s takes in four more control characters."""
    return pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    return Codec(read_ranks(path), pattern)


def _encoded(docs: DataFrame, keep: list[str], path: str, pattern: str, text_column: str, ids: bool) -> DataFrame:
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches_of(batches, text_column):
            counts, id_digests, text_digests, lists = [], [], [], []
            for found in codec.encode_batch(batch.column(text_column).to_pylist()):
                counts.append(len(found))
                id_digests.append(digest(str(found)[1:-1].replace(" ", "").encode()))
                text_digests.append(digest(codec.decode(found)))
                if ids:
                    lists.append(pa.array(found, pa.int32()))
            columns = [*(batch.column(c) for c in keep), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
            names = [*keep, *ADDED[:3]]
            if ids:
                values = pa.concat_arrays(lists) if lists else pa.array([], pa.int32())
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), values))
                names.append(ADDED[3])
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens bigint, ids_sha256 string, decoded_sha256 string"]) + ", token_ids array<int>" * ids
    return docs.select(*dict.fromkeys([*keep, text_column])).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", ids: bool = True) -> DataFrame:
    """Per row: the id column, n_tokens, ids_sha256, decoded_sha256 and, if asked, token_ids.

    ``path`` names the rank file on every executor.  Rows stay in their partitions; nothing is shuffled.
    """
    return _encoded(docs, [id_column], path, pattern, text_column, ids)


def with_tokens(docs: DataFrame, path: str, pattern: str, text_column: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256 and token_ids; columns of ``docs`` with these names give way."""
    return _encoded(docs, [c for c in docs.columns if c not in ADDED], path, pattern, text_column, True)
