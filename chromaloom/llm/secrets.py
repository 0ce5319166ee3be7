"""Secret scans: keyword prefilter, anchored expressions near hits, embedded checksums.

An Aho-Corasick automaton runs over the ASCII-lower-cased text; a regular
expression is tried only where a keyword ends up starting a secret, anchored
there.  Issuer tokens that embed a checksum are added only if it is right.
Runs of hexadecimal digits have no keyword; they are found on the bytes.

Kinds, in order: assign, access, hex (the base rules), then github, npm, jwt and
pem.  Spans are (kind, start, end) in code points, end exclusive.

A failed match is not tried again inside the run of characters it looked at, so
a scan costs the same for each character, whatever the text.

Defined cases: a null text counts as empty; overlapping spans of different
kinds are all reported, by start and then kind; a keyword whose match is too
short is dropped and the scan goes on behind it; repeated rows give a row each;
an empty table gives an empty result; further columns are left out by
``find_secrets`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches_of

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE = KINDS[:3]
RANK = {kind: i for i, kind in enumerate(KINDS)}
#: Least characters of an assigned value, an access key and a hexadecimal run.
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
#: The digits in which issuers write their CRC-32.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: What replaces a secret.
MASK = "[SECRET]"


def _base62_crc(body: str, width: int = 6) -> str:
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out.rjust(width, "0")


def _crc_holds(m: re.Match[str]) -> bool:
    return _base62_crc(m[1]) == m[2]


def _jwt_holds(m: re.Match[str]) -> bool:
    """The first two parts are base64url of JSON objects, the first with an algorithm."""
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))) for part in m[0].split(".")[:2])
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head and isinstance(body, dict)


def _pem_holds(m: re.Match[str]) -> bool:
    """The body is base64 of a DER sequence that is as long as its header says."""
    try:
        data = base64.b64decode("".join(m[1].split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    if len(data) < 2 or data[0] != 0x30:
        return False
    if data[1] < 0x80:
        return len(data) == 2 + data[1]
    n = data[1] & 0x7F
    return len(data) == 2 + n + int.from_bytes(data[2 : 2 + n], "big")


def _value_long(m: re.Match[str]) -> bool:
    return len(m[2]) >= LEAST_VALUE


def _access_long(m: re.Match[str]) -> bool:
    return len(m[0]) >= LEAST_ACCESS


#: Kind -> (keywords in lower case, expression anchored at a keyword, test of the match).
RULES: dict[str, tuple[tuple[str, ...], re.Pattern[str], Callable[[re.Match[str]], bool]]] = {
    "assign": (("password", "passwd", "secret", "token", "api_key", "apikey"), re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), _value_long),
    "access": (("akia",), re.compile(r"AKIA[A-Z0-9]+"), _access_long),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), _crc_holds),
    "npm": (("npm_",), re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), _crc_holds),
    "jwt": (("eyj",), re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), _jwt_holds),
    "pem": (("-----begin ",), re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END (?:[A-Z]+ )?PRIVATE KEY-----"), _pem_holds),
}

#: Kinds whose keyword starts a run that is matched to its end: if one keyword of a run fails, so do the later ones.
RUNS = {"jwt": re.compile(r"[A-Za-z0-9_-]+")}

_HEX = np.zeros(256, np.bool_)
_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True


class Scanner:
    """Finds the spans of one text; one for each worker process."""

    def __init__(self) -> None:
        import ahocorasick

        found: dict[str, list[str]] = {}
        for kind, (words, _, _) in RULES.items():
            for word in words:
                found.setdefault(word, []).append(kind)
        self.automaton = ahocorasick.Automaton()
        for word, kinds in found.items():
            self.automaton.add_word(word, (len(word), kinds))
        self.automaton.make_automaton()

    def hex_runs(self, data: bytes) -> list[tuple[int, int]]:
        """Maximal runs of LEAST_HEX hexadecimal digits or more, in bytes."""
        marks = np.flatnonzero(np.diff(_HEX[np.frombuffer(data, np.uint8)], prepend=False, append=False))
        starts, ends = marks[::2], marks[1::2]
        long = ends - starts >= LEAST_HEX
        return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))

    def scan(self, text: str | None) -> list[tuple[str, int, int]]:
        if not text:
            return []
        data = text.encode()
        ascii_only = len(data) == len(text)
        lowered = data.lower().decode()
        found: list[tuple[str, int, int]] = []
        upto = dict.fromkeys(RULES, 0)
        hits = sorted((end - n + 1, kinds) for end, (n, kinds) in self.automaton.iter(lowered))
        for start, kinds in hits:
            for kind in kinds:
                _, pattern, holds = RULES[kind]
                if start < upto[kind]:
                    continue
                if m := pattern.match(text, start):
                    upto[kind] = m.end()
                    if holds(m):
                        found.append((kind, start, m.end()))
                elif kind in RUNS and (run := RUNS[kind].match(text, start)):
                    upto[kind] = run.end()
        if runs := self.hex_runs(data):
            place = None if ascii_only else np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
            for start, end in runs:
                at = start if place is None else int(place[start])
                found.append(("hex", at, at + end - start))
        return sorted(found, key=lambda s: (s[1], RANK[s[0]], s[2]))


_scanner: Scanner | None = None


def scanner() -> Scanner:
    global _scanner
    if _scanner is None:
        _scanner = Scanner()
    return _scanner


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str | None, spans: list[tuple[str, int, int]], by: str = MASK) -> str | None:
    """The text with every span, overlapping ones merged, replaced."""
    if not spans or text is None:
        return text
    out, at, end = [], 0, -1
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= end:
            out += (text[at:a], by)
        end = at = max(end, b)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id column, n_assign, n_access, n_hex, base_sha256, spans (joined) and n_added."""
    kind = dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner().scan
        for batch in batches_of(batches, text_column):
            rows = [scan(t) for t in batch.column(text_column).to_pylist()]
            base = [[s for s in spans if s[0] in BASE] for spans in rows]
            counts = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in BASE]
            digest = pa.array([hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base], pa.string())
            added = pa.array([len(a) - len(b) for a, b in zip(rows, base, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(id_column), *counts, digest, pa.array(map(joined, rows), pa.string()), added], [id_column, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_added bigint")


def redact(docs: DataFrame, text_column: str = "text", by: str = MASK) -> DataFrame:
    """``docs`` with every secret in ``text_column`` masked; the other columns and all rows stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner().scan
        for batch in batches_of(batches, text_column):
            i = batch.schema.get_field_index(text_column)
            texts = [mask(t, scan(t), by) for t in batch.column(i).to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
