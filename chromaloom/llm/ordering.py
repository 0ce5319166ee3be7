"""Training order: every sequence gets a slot by a keyed permutation; shards hold the slots in order.

Documents' token ids (byte-level BPE by default, two bytes each) are cut into
sequences of a fixed length; sequences are
numbered densely, partition by partition.  A keyed Feistel network, walked in
cycles until it lands inside the range, permutes the numbers to slots without
any table.  Slots are dealt into ranges; each range's task places its records
at their offsets and writes whole shards of fixed-stride records, so a reader
finds any slot by arithmetic and resumes anywhere.

A record: id (int64), part of the document (uint32), tokens (uint32), then the
ids, little-endian, padded with zeros.  Shard files are named by number, written
under another name and renamed: a task that runs again writes the same bytes.

Before the shuffle each task packs the records of a range into compressed
blobs.  A range's task holds RANGE_BYTES at most, whatever the input.

Defined cases: null and empty payloads make one sequence without tokens; a null
id is marked in the record and reads as None; ids that are not whole numbers are
written as their 64-bit hash (xxhash64 of the id as text); an empty table makes
no shard; repeated rows are sequences of their own; further columns are left
out, whatever their names.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import batches_of, cut, shared_dir

#: Bytes of a record, of its head, and of what a range's task holds.
STRIDE, HEAD, RANGE_BYTES = 512, 16, 48 << 20
#: Shards in a range.
SHARDS_PER_RANGE = 2
ROUNDS = 6
#: Marks, in the number of a part, a record without an id.
NO_ID = 1 << 31
#: Characters from which on a text is encoded by the codec of ``bpe``, whose pattern search never gives up.
LONG = 100_000
#: How ids are compressed while they wait for their place: in the shared folder, and in the shuffle.
PACKED, LEVEL = {"compression": "zstd", "parquet.compression.codec.zstd.level": "7"}, 6
#: The columns ``encoded`` gives.
ID, PAYLOAD = "id", "payload"
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Permutation:
    """A keyed bijection of 0 to n-1."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = _U(max(1, (max(1, n - 1).bit_length() + 1) // 2))
        self.mask = _U((1 << int(self.half)) - 1)
        seeds = np.arange(1, ROUNDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(key & 0xFFFFFFFFFFFFFFFF)
        self.keys = _mix(seeds)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ (_mix(left ^ k) & self.mask), left
            else:
                left, right = right, left ^ (_mix(right ^ k) & self.mask)
        return left << self.half | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), back)
        while (outside := np.flatnonzero(out >= _U(self.n))).size:
            out[outside] = self._once(out[outside], back)
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, False)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


@dataclass(frozen=True)
class Layout:
    """What a reader must know; kept beside the shards as manifest.json."""

    sequences: int
    stride: int
    width: int  # bytes of a token id
    per_shard: int
    key: int

    @property
    def length(self) -> int:
        return (self.stride - HEAD) // self.width

    @property
    def shards(self) -> int:
        return -(-self.sequences // self.per_shard)


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _put(uri: str, name: str, data: bytes) -> None:
    """Write under a name of its own, then rename: what bears the final name is whole."""
    files, path = _opened(uri)
    other = f"{path}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(other) as out:
        out.write(data)
    files.move(other, f"{path}/{name}")


def shard_name(number: int) -> str:
    return f"shard-{number:08d}.bin"


def _records(ids: list[int | None], payloads: list[bytes | None], layout: Layout) -> np.ndarray:
    """Records of the documents' sequences, end to end (rows of bytes)."""
    room = layout.length * layout.width
    parts = [max(1, -(-len(p or b"") // room)) for p in payloads]
    out = np.zeros((sum(parts), layout.stride), np.uint8)
    at = 0
    for i, p, n in zip(ids, payloads, parts, strict=True):
        data = np.frombuffer(p or b"", np.uint8)
        whole = len(data) // room
        if whole:
            out[at : at + whole, HEAD : HEAD + room] = data[: whole * room].reshape(whole, room)
        if len(data) > whole * room:
            out[at + whole, HEAD : HEAD + len(data) - whole * room] = data[whole * room :]
        head = np.zeros(n, [("id", "<i8"), ("part", "<u4"), ("tokens", "<u4")])
        head["id"], head["part"] = i or 0, np.arange(n) + (NO_ID if i is None else 0)
        head["tokens"] = np.minimum(room, np.maximum(0, len(data) - room * np.arange(n))) // layout.width
        out[at : at + n, :HEAD] = head.view(np.uint8).reshape(n, HEAD)
        at += n
    return out


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    """The reference tokenizer and the codec of ``bpe``, which give the same ids; one of each for a worker process."""
    import tiktoken

    codec = bpe.Codec(bpe.read_ranks(path), pattern)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=codec.whole, special_tokens={}), codec


def encoded(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, int]:
    """Per row: id and payload (its text's BPE ids, little-endian), written to the shared folder; and the bytes of an id."""
    width = 2 if len(bpe.read_ranks(path)) <= 1 << 16 else 4
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast, codec = _encoder(path, pattern)
        for batch in batches_of(batches, "_text"):
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            found = (fast.encode_to_numpy(t).astype(kind) if len(t) < LONG else np.array(codec.encode(t), kind) for t in texts)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([x.tobytes() for x in found], pa.binary())], [ID, PAYLOAD])

    rows = docs.select(_whole(docs, id_column).alias("_id"), F.col(text_column).alias("_text"))
    return cut(rows.mapInArrow(run, f"{ID} bigint, {PAYLOAD} binary"), options=PACKED), width


def _whole(docs: DataFrame, id_column: str) -> Column:
    """The id as a whole number: itself, or a hash of it."""
    c = F.col(id_column)
    if dict(docs.dtypes)[id_column] in ("tinyint", "smallint", "int", "bigint"):
        return c.cast("bigint")
    return F.when(c.isNotNull(), F.xxhash64(c.cast("string")))


def plan(docs: DataFrame, payload: Column, width: int = 1, stride: int = STRIDE, key: int = 0, range_bytes: int = RANGE_BYTES) -> tuple[Layout, dict[int, tuple[int, int]]]:
    """The layout, and the number of each partition's first sequence and how many it has.

    One number for each partition reaches the driver.
    """
    room = (stride - HEAD) // width * width
    n = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length(payload), F.lit(0)) / room))
    rows = docs.select(F.spark_partition_id().alias("p"), n.alias("n")).groupBy("p").agg(F.sum("n").alias("n")).collect()
    first, total = {}, 0
    for r in sorted(rows):
        first[r["p"]] = (total, r["n"])
        total += r["n"]
    per_shard = max(1, min(range_bytes // stride, max(1, total)) // SHARDS_PER_RANGE)
    return Layout(total, stride, width, per_shard, key), first


def materialise(docs: DataFrame, out_dir: str, payload: Column, width: int, id_column: str = "doc_id", stride: int = STRIDE, key: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes all sequences in training order below ``out_dir`` when the result is computed.

    ``docs`` must be a scan or another frame whose partitions are the same each
    time it runs; a task whose partition differs from the plan fails.  ``payload``
    holds token ids of ``width`` bytes each (``encoded`` makes such a frame).
    The result has one row for each sequence: id, part, slot, shard, offset, n_tokens and crc32 of the record.
    """
    layout, first = plan(docs, payload, width, stride, key, range_bytes)
    per_range = layout.per_shard * SHARDS_PER_RANGE
    ranges = max(1, -(-layout.sequences // per_range))
    starts = docs.sparkSession.sparkContext.broadcast(first)
    files, path = _opened(out_dir)
    files.create_dir(path, recursive=True)
    _put(out_dir, "manifest.json", json.dumps(asdict(layout)).encode())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, expected = starts.value.get(part, (0, 0))
        end = number + expected
        order, codec = Permutation(layout.sequences, layout.key), pa.Codec("zstd", compression_level=LEVEL)
        for batch in batches_of(batches, "_payload", 8 << 20):
            records = _records(batch.column("_id").to_pylist(), batch.column("_payload").to_pylist(), layout)
            slots = order.slot(np.arange(number, number + len(records)))
            number += len(records)
            by = np.argsort(slots, kind="stable")
            slots, records = slots[by], records[by]
            of = slots // per_range
            cuts = np.flatnonzero(np.diff(of, prepend=-1))
            ends = [*cuts[1:].tolist(), len(of)]
            blobs = [codec.compress(slots[a:b].astype("<i8").tobytes() + records[a:b].tobytes(), asbytes=True) for a, b in zip(cuts.tolist(), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(of[cuts], pa.int32()), pa.array([b - a for a, b in zip(cuts.tolist(), ends, strict=True)], pa.int32()), pa.array(blobs, pa.binary())], ["range", "n", "blob"])
        if number != end:
            raise RuntimeError(f"partition {part} has other rows than when its sequences were counted")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, low, got, codec = None, 0, 0, pa.Codec("zstd")
        for batch in batches:
            for which, n, blob in zip(*(batch.column(c) for c in ("range", "n", "blob")), strict=True):
                if held is None:
                    low = which.as_py() * per_range
                    held = np.zeros((min(per_range, layout.sequences - low), stride), np.uint8)
                n = n.as_py()
                data = codec.decompress(blob.as_buffer(), n * (8 + stride))
                slots = np.frombuffer(data, "<i8", n)
                held[slots - low] = np.frombuffer(data, np.uint8, offset=8 * n).reshape(n, stride)
                got += n
        if held is None:
            return
        if got != len(held):
            raise RuntimeError(f"slots {low} on: {got} records for {len(held)} slots")
        for a in range(0, len(held), layout.per_shard):
            some = held[a : a + layout.per_shard]
            number = (low + a) // layout.per_shard
            _put(out_dir, shard_name(number), some.data)
            head = np.ascontiguousarray(some[:, :HEAD]).view([("id", "<i8"), ("part", "<u4"), ("tokens", "<u4")])[:, 0]
            at = np.arange(len(some), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(head["id"], mask=head["part"] >= NO_ID), pa.array(head["part"].astype(np.int64) % NO_ID), pa.array(low + a + at), pa.array(np.full(len(some), number, np.int64)), pa.array(at * stride), pa.array(head["tokens"].astype(np.int64)), pa.array([zlib.crc32(r) for r in some], pa.int64())],
                [id_column, "part", "slot", "shard", "offset", "n_tokens", "crc32"],
            )

    packed = docs.select(_whole(docs, id_column).alias("_id"), payload.alias("_payload")).mapInArrow(pack, "range int, n int, blob binary")
    dealt = packed.repartitionById(ranges, F.col("range"))
    return dealt.mapInArrow(write, f"`{id_column}` bigint, part bigint, slot bigint, shard bigint, offset bigint, n_tokens bigint, crc32 bigint")


def read_layout(out_dir: str) -> Layout:
    files, path = _opened(out_dir)
    with files.open_input_stream(f"{path}/manifest.json") as src:
        return Layout(**json.loads(src.read()))


def read(out_dir: str, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, int | None, int, np.ndarray]]:
    """(slot, id, part, token ids) in training order from slot ``start`` on; a reader resumes at any slot."""
    layout = read_layout(out_dir)
    files, path = _opened(out_dir)
    stop = layout.sequences if stop is None else min(stop, layout.sequences)
    kind = {1: "<u1", 2: "<u2", 4: "<u4"}[layout.width]
    for number in range(start // layout.per_shard, -(-stop // layout.per_shard)):
        low = number * layout.per_shard
        with files.open_input_file(f"{path}/{shard_name(number)}") as src:
            first = max(start, low)
            src.seek((first - low) * layout.stride)
            for slot in range(first, min(stop, low + layout.per_shard)):
                data = src.read(layout.stride)
                who, part, n = np.frombuffer(data, "<i8", 1)[0], *np.frombuffer(data, "<u4", 2, 8)
                yield slot, None if part >= NO_ID else int(who), int(part) % NO_ID, np.frombuffer(data, kind, int(n), HEAD)


def folder_for(docs: DataFrame) -> str:
    """A new folder for shards in the shared folder of the cluster."""
    base = shared_dir(docs.sparkSession)
    return f"{base}/training-order-{uuid.uuid4().hex}"
