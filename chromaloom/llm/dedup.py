"""Near-duplicate documents by DartMinHash signatures.

A document is the weighted set of its five-word shingles, weighted by how often
each occurs.  The weights of an element are cut into regions, [0, 1) and then
one for each power of two; into each region that the element's weight reaches a
Poisson stream of darts is thrown, seeded by the element and the region, and
darts above the weight miss.  So a heavy element costs its logarithm in regions,
and what it shares with a lighter one is told by the darts below both.  The darts
before a rank bound that suits the document's total weight are dealt over the
signature's coordinates, and each coordinate keeps its earliest dart.  Two
documents agree on a coordinate with their weighted Jaccard similarity as
probability.  Bands of coordinates are joined; what shares a band is linked if
the exact similarity of the two shingle sets reaches the threshold.

Texts with the same words are one vertex, named by a 64-bit hash of the words,
so a group of copies of any size is one candidate.  In a band each vertex meets
only the band's center, the one that shares most with most others, and what those
links connect is one class.  Where that does not settle the matter (members in
different classes), small bands are paired in full, and large ones go by their
tokens: relative to the center of the band, a pair at the threshold either shares
a shingle that the center lacks, of which a prefix suffices, or both lie in the
center so far that their sizes betray them.  The prefix is taken in the order of
how many documents around the center have a shingle, told by a sample: what a
family of them has in common comes last, so a family is not paired in full for
it.  Any order finds every pair, a good one finds few others.  Both conditions
are equi-joins, so no link between classes is lost to the shortcut.  Before an
exact test, pairs whose signatures agree too rarely for the threshold are left out.

Groups that may hold many rows (copies, classes) are joined in two parts: the
large groups, of which there are LARGE_GROUPS at most, by broadcast, the others
by a shuffle.

Defined cases: texts of fewer than five words are one shingle; texts without a
word (null ones too) are alike to nothing; a null id takes no part and gets a
null class; in ``near_duplicates`` rows that repeat an id are one document,
whose texts all count; in ``deduplicate`` every text counts for itself.  The
class is named by its least id, which is also the one that stays; of texts with
the same id the one with the lesser hash.  An empty table gives an empty result;
ids may be of any type that has an order; further columns may bear any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import batches_of, cut, free_names, scope

SHINGLE, SIMILARITY = 5, 0.8
#: Bands and coordinates in each; a pair at the threshold shares no band with probability 3e-5.
BANDS, DEPTH = 26, 5
#: Least equal coordinates of a pair that is tested: one at the threshold has fewer with probability 1e-7.
AGREEING = 80
#: Ids that are broadcast to pick texts; more of them meet the texts in a shuffle.
BROADCAST_IDS = 2_000_000
#: Groups that count as large at most; the others hold fewer rows than this share of all, or SMALL_GROUP.
LARGE_GROUPS, SMALL_GROUP = 10_000, 1_000
#: Documents of a band that is paired in full.
SMALL_BAND = 16
#: Sizes of one class differ by less than this factor.
SIZE_STEP = 1.01
#: Documents around a center, about, that tell how frequent a shingle is there: so many or this share, whichever is more.
FREQUENCY_SAMPLE, FREQUENCY_SHARE = 512, 1 / 8
#: Expected darts beyond those that fill all coordinates on average, in units of the coordinates.
SLACK = 2.5

_U = np.uint64


def _table(df: DataFrame) -> DataFrame:
    """An intermediate table of ids, written in few files."""
    return cut(df, gather=True)


_WORD_BYTE = np.zeros(256, np.bool_)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that leaves no bit unmoved."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]))
        for i, b in enumerate((_BASE, _BASE_INVERSE)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z folded; separators: other ASCII) laid end to end, and words in each text."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = _WORD_BYTE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    power, inverse = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLD[data].astype(np.uint64) + _U(1)) * power[: len(data)], out=total[1:])
    hashes = mix((total[end] - total[start]) * inverse[start])
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(start, ends)
    return hashes, np.diff(upto, prepend=0)


def shingles(hashes: np.ndarray, sizes: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts end to end, sorted within each, and how many each has."""
    n = len(hashes)
    places = np.arange(1, width + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)
    total = np.zeros(n, np.uint64)
    for j in range(min(width, n)):
        total[: n - j] += mix(hashes[j:] + places[j])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    count = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    keep = np.ones(n, bool)
    drop = np.minimum(np.maximum(sizes - 1, 0), width - 1)
    for j in range(1, width):
        at = ends[drop >= j] - j
        keep[at] = False
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    for i in short:  # one shingle of all words, told from longer ones by their number
        a, b = starts[i], ends[i]
        total[a] = mix(hashes[a:b] + places[: b - a]).sum(dtype=np.uint64) + _U(b - a)
    out = mix(total[keep])
    at = 0
    for c in count.tolist():
        out[at : at + c].sort()
        at += c
    return out, count


def fingerprints(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's word sequence."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    place = (np.arange(len(hashes)) - np.repeat(starts, sizes)).astype(np.uint64)
    out = np.zeros(len(sizes), np.uint64)
    full = sizes > 0
    if full.any():
        out[full] = np.add.reduceat(mix(hashes ^ mix(place + _U(0x8CB92BA72F3D8DD7))), starts[full])
    return mix(out + sizes.astype(np.uint64))


def _units(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash for each unit of weight: the shingle's, and for its repetitions others."""
    n = len(hashes)
    first = np.ones(n, bool)
    first[1:] = hashes[1:] != hashes[:-1]
    starts = np.cumsum(count) - count
    first[starts[count > 0]] = True
    if first.all():
        return hashes
    at = np.arange(n)
    times = at - np.maximum.accumulate(np.where(first, at, 0))
    return np.where(times > 0, mix(hashes + times.astype(np.uint64) * _U(0xE7037ED1A0B428DB)), hashes)


def signatures(hashes: np.ndarray, count: np.ndarray, size: int = BANDS * DEPTH) -> np.ndarray:
    """Signatures of texts, whose shingles are sorted within each, weighted by how often they occur."""
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    first[(np.cumsum(count) - count)[count > 0]] = True
    at = np.flatnonzero(first)
    owner = np.repeat(np.arange(len(count)), count)[at]
    return weighted_signatures(hashes[at], np.diff(at, append=len(hashes)).astype(np.float64), np.bincount(owner, minlength=len(count)), size)


def weighted_signatures(elements: np.ndarray, weights: np.ndarray, count: np.ndarray, size: int = BANDS * DEPTH) -> np.ndarray:
    """The earliest dart of each coordinate, for each set (rows); zeros for a set without weight.

    ``elements`` (hashes, distinct in a set) and their ``weights`` lie end to end, ``count`` of them in each
    set.  Weights are best scaled so that most are about 1 or more: a lighter element wastes darts.
    """
    texts = len(count)
    out = np.zeros((texts, size), np.uint64)
    best = np.full((texts, size), np.inf)
    owner = np.repeat(np.arange(texts), count)
    weights = np.maximum(np.asarray(weights, np.float64), 0.0)
    total = np.bincount(owner, weights, texts)
    # regions of weight: [0, 1) for all, then [1, 2), [2, 4) and so on, as far as the weight reaches
    seeds, low, top = [elements], [np.zeros(len(elements))], [weights]
    owners, level, at = [owner], 0, np.flatnonzero(weights > 1)
    while len(at):
        level += 1
        start = 2.0 ** (level - 1)
        seeds.append(mix(elements[at] + _U(level * 0xE7037ED1A0B428DB & 0xFFFFFFFFFFFFFFFF)))
        low.append(np.full(len(at), start))
        top.append(weights[at])
        owners.append(owner[at])
        at = at[weights[at] > 2 * start]
    seed, below, above, who = (np.concatenate(x) if level else x[0] for x in (seeds, low, top, owners))
    width = np.maximum(below, 1.0)
    partial = above < below + width  # the region reaches beyond the weight: darts above it miss
    plain = not level and not partial.any()
    unit = lambda h: (h >> _U(11)).astype(np.float64) * 2.0**-53
    bound = size * (np.log(size) + SLACK) / np.where(total > 0, total, 1.0)
    todo = total > 0
    while todo.any():
        at = np.flatnonzero(todo[who])
        base, of, rank, turn = seed[at], who[at], np.zeros(len(at)), 0
        wide = None if plain else width[at]
        best[todo] = np.inf
        while len(base):
            turn += 1
            h = mix(base + _U(turn * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF))
            gap = np.log1p(-unit(h))
            rank = rank - (gap if plain else gap / wide)
            live = rank < bound[of]
            base, of, rank, h = base[live], of[live], rank[live], h[live]
            dart = mix(h ^ _U(0x589965CC75374CC3))
            cell, when = of * size + (dart % _U(size)).astype(np.int64), rank
            if not plain:
                at, wide = at[live], wide[live]
                some = np.flatnonzero(partial[at])
                if len(some):
                    missed = some[below[at[some]] + unit(mix(h[some] ^ _U(0xA0761D6478BD642F))) * wide[some] >= above[at[some]]]
                    hit = np.ones(len(at), bool)
                    hit[missed] = False
                    cell, when, dart = cell[hit], when[hit], dart[hit]
            flat, ids = best.reshape(-1), out.reshape(-1)
            np.minimum.at(flat, cell, when)
            won = flat[cell] == when
            ids[cell[won]] = dart[won]
        todo = todo & np.isinf(best).any(1)
        bound = bound * 2
    return out


def bands_of(signature: np.ndarray, bands: int = BANDS, depth: int = DEPTH) -> np.ndarray:
    """A key for each band of each text."""
    places = (np.arange(depth, dtype=np.uint64) + _U(1)) * _U(0xC2B2AE3D27D4EB4F)
    split = mix(signature.reshape(len(signature), bands, depth) + places).sum(2, dtype=np.uint64)
    return mix(split + np.arange(1, bands + 1, dtype=np.uint64) * _U(0x165667B19E3779F9))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays of shingles."""
    both = np.concatenate([np.stack([_counted(a), np.ones(len(a), np.uint64)]), np.stack([_counted(b), np.ones(len(b), np.uint64)])], axis=1)[0]
    total = len(both)
    same = total - len(np.unique(both))
    return same / (total - same) if total > same else 1.0


def _counted(a: np.ndarray) -> np.ndarray:
    return _units(a, np.array([len(a)]))


def _sketch(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Per row with an id and a word: _id, _v (hash of the words), _n (shingles), _bands and _sig (8 bits of each coordinate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "_text", 1 << 19):
            hashes, sizes = word_hashes(batch.column("_text").cast(pa.binary()).to_pylist())
            prints = fingerprints(hashes, sizes)
            some = np.flatnonzero(sizes)
            sets, count = shingles(hashes, sizes)
            found = signatures(sets, count)[some]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(bands_of(found).view(np.int64).reshape(-1)), BANDS).cast(pa.list_(pa.int64()))
            short = [row.tobytes() for row in (found >> _U(40)).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(some)), pa.array(prints[some].view(np.int64)), pa.array(count[some].astype(np.int64)), lists, pa.array(short, pa.binary())], ["_id", "_v", "_n", "_bands", "_sig"])

    rows = docs.where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    return rows.mapInArrow(run, f"_id {dict(docs.dtypes)[id_column]}, _v bigint, _n bigint, _bands array<bigint>, _sig binary")


def sketch_sets(sets: DataFrame, id_column: str, elements_column: str, weights_column: str) -> DataFrame:
    """Signature (array of bigint) and bands of weighted sets: id, an array of distinct strings and one of their weights.

    A null array is an empty set; a null or negative weight counts as 0; a set without weight has null in both columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "_e"):
            names = [x or [] for x in batch.column("_e").to_pylist()]
            weights = [[w or 0.0 for w in x or []] for x in batch.column("_w").to_pylist()]
            flat = [(n or "").encode().hex().encode() for x in names for n in x]  # one word each, whatever it holds
            hashes, _ = word_hashes(flat)
            w = np.array([v for x in weights for v in x], np.float64)
            found = weighted_signatures(hashes, w, np.array([len(x) for x in names], np.int64))
            bands = bands_of(found)
            some = found.any(1)
            lists = lambda x: pa.array([row.tolist() if ok else None for row, ok in zip(x.view(np.int64), some, strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), lists(found), lists(bands)], [id_column, "signature", "bands"])

    kind = dict(sets.dtypes)[id_column]
    return sets.select(F.col(id_column).alias("_id"), F.col(elements_column).alias("_e"), F.col(weights_column).cast("array<double>").alias("_w")).mapInArrow(run, f"`{id_column}` {kind}, signature array<bigint>, bands array<bigint>")


def _agreeing(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose signatures (_id, _sig) agree on AGREEING coordinates."""
    kind = dict(pairs.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("_x", "_y"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= AGREEING))

    first, second = sigs.select(F.col("_id").alias("a"), F.col("_sig").alias("_x")), sigs.select(F.col("_id").alias("b"), F.col("_sig").alias("_y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "_x", "_y").mapInArrow(run, f"a {kind}, b {kind}")


def _packed(units: np.ndarray) -> bytes:
    """Five bytes of each sorted hash: enough to tell the shingles of two documents apart, and small."""
    return np.ascontiguousarray(np.sort(units >> _U(24)).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpacked(data: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view(np.uint64).reshape(-1)


def _shared_units(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of ``a`` (distinct, sorted) are in ``b`` (likewise)."""
    if not len(b):
        return np.zeros(len(a), bool)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return b[at] == a


def _shingle_sets(docs: DataFrame, wanted: DataFrame, first: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Per vertex in ``wanted`` (_id): _id and its units of weight, packed, from the text of the vertex' first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "_text", 1 << 19):
            hashes, sizes = word_hashes(batch.column("_text").cast(pa.binary()).to_pylist())
            found, count = shingles(hashes, sizes)
            ends = np.cumsum(count)
            units = _units(found, count)
            sets = [_packed(units[e - c : e]) for c, e in zip(count.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(fingerprints(hashes, sizes).view(np.int64)), pa.array(sets, pa.binary())], ["_id", "_set"])

    ids = _table(first.join(wanted.withColumnRenamed("_id", "_v"), "_v", "left_semi").select(F.col("_first").alias("_id")).distinct())
    some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = docs.where(F.col(text_column).isNotNull()).select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).join(some, "_id", "left_semi")
    return rows.select("_text").mapInArrow(run, "_id bigint, _set binary").dropDuplicates(["_id"])


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose exact similarity reaches ``least``."""
    kind = dict(pairs.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "_x", 32 << 20):
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("_x"), batch.column("_y"), strict=True)):
                x, y = _unpacked(x), _unpacked(y)
                small, large = sorted((len(x), len(y)))
                if small >= least * large - 1e-9:
                    same = int(_shared_units(x, y).sum())
                    if same >= least * (len(x) + len(y) - same) - 1e-9:
                        keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    first = sets.select(F.col("_id").alias("a"), F.col("_set").alias("_x"))
    second = sets.select(F.col("_id").alias("b"), F.col("_set").alias("_y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "_x", "_y").mapInArrow(run, f"a {kind}, b {kind}")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Per vertex of ``edges`` (a, b): v and the least vertex it is connected to, root.

    Each round every vertex takes the least root around it and then that root's
    root; rounds end when nothing changes.  Each round is written, so lineage stays short.
    """
    both = _table(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    state = _table(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("root")))
    if not state.limit(1).count():
        return state
    for _ in range(rounds):
        near = both.join(state.select(F.col("v").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("v")).agg(F.min("r").alias("r"))
        hop = state.join(near, "v", "left").select("v", "root", F.least("root", "r").alias("to"))
        jump = state.select(F.col("v").alias("to"), F.col("root").alias("further"))
        new = _table(hop.join(jump, "to", "left").select("v", F.least("to", "further").alias("root"), (F.least("to", "further") < F.col("root")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        state = new.select("v", "root")
        if not moved:
            return state
    raise RuntimeError("components did not settle")


def _places(units: np.ndarray, center: np.ndarray) -> tuple[np.ndarray, int]:
    """Places of ``units`` in the center's table of frequencies, and the size of that, some four times the center's."""
    size = 1 << min(22, max(8, (4 * len(center)).bit_length()))
    return (units & _U(size - 1)).astype(np.int64), size


def _frequencies(members: DataFrame, centers: DataFrame, sets: DataFrame) -> DataFrame:
    """Per center c of ``members`` (c, d, n of them): frequencies, place * 256 + level of shingles that it lacks and several of a sample of its documents have.

    Levels rise with the logarithm of the count; of shingles with the same place the most frequent one's counts.
    """
    kind = dict(members.dtypes)["d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "_x", 1 << 20):
            take, keys, places = [], [], []
            for i, (x, y) in enumerate(zip(batch.column("_x"), batch.column("_y"), strict=True)):
                own, center = _unpacked(x), _unpacked(y)
                other = own[~_shared_units(own, center)]
                take.append(np.full(len(other), i))
                keys.append(other.view(np.int64))
                places.append(_places(other, center)[0])
            if take:
                yield pa.RecordBatch.from_arrays([batch.column("c").take(pa.array(np.concatenate(take))), *(pa.array(np.concatenate(x)) for x in (keys, places))], ["c", "key", "place"])

    some = members.where(F.pmod(F.xxhash64("c", "d"), F.col("n")) < F.greatest(F.lit(FREQUENCY_SAMPLE), F.col("n") * FREQUENCY_SHARE)).select("c", "d")
    rows = some.join(centers, "c").join(sets.select(F.col("_id").alias("d"), F.col("_set").alias("_x")), "d").repartition("c", "d")
    counts = rows.select("c", "_x", "_y").mapInArrow(run, f"c {kind}, key bigint, place bigint").groupBy("c", "key", "place").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    level = F.least(F.lit(255), F.floor(8 * F.log2(F.col("n").cast("double")))).cast("int")
    return counts.groupBy("c", "place").agg(F.max(level).alias("level")).groupBy("c").agg(F.collect_list((F.col("place") * 256 + F.col("level")).cast("int")).alias("frequencies"))


def _around(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Join keys of documents (d, root, asks) around their band's center (c, n of them): c, kind, key, d, root, n, o, rest.

    kind 1: shingles that the center lacks (a prefix, the rare ones around it first,
    then in hash order; ``frequencies`` tells).  kind 2 and 3:
    sizes of documents that could be linked to d by the center's shingles alone,
    asked for and owned.  n counts the shingles of d, o those that the center has,
    rest those from the key on that it lacks.  ``sizes`` lists the classes of sizes
    (some two thousand at most) that occur around the center; no smaller partner
    need be reckoned with.
    """
    kind = dict(members.dtypes)["d"]
    share = least / (1 + least)  # of both sizes, that a pair at the threshold has in common

    def size_class(n: np.ndarray) -> np.ndarray:
        return np.floor(np.log(np.maximum(n, 1)) / np.log(SIZE_STEP)).astype(np.int64)

    def least_partner(n: int, around: np.ndarray) -> int:
        """No document around the center that could be linked to one of n shingles has fewer than so many; n itself at most."""
        smallest = int(np.ceil(least * n - 1e-9))
        highs = np.ceil(SIZE_STEP ** (around + 1.0)) + 1  # beyond every size of the class, rounding errors included
        lows = np.floor(SIZE_STEP**around.astype(float)) - 1
        return max(smallest, min([n, *lows[highs >= smallest].astype(np.int64).tolist()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "_x", 8 << 20):
            take, kinds, keys, numbers = [], [], [], []
            last, center, known, levels = None, None, np.zeros(0, np.int64), None
            for i, (x, y, c, asks, around, often) in enumerate(zip(batch.column("_x"), batch.column("_y"), batch.column("c").to_pylist(), batch.column("asks").to_pylist(), batch.column("sizes"), batch.column("frequencies"), strict=True)):
                if last is None or c != last:
                    last, center, known, levels = c, _unpacked(y), around.values.to_numpy(), None
                    if often.is_valid:
                        told = often.values.to_numpy()
                        levels = np.zeros(_places(center[:0], center)[1], np.uint8)
                        levels[told >> 8] = told & 255
                own = _unpacked(x)
                inside = _shared_units(own, center)
                n, o = len(own), int(inside.sum())
                other = own[~inside]
                if levels is not None:
                    other = other[np.argsort(levels[_places(other, center)[0]], kind="stable")]
                partner = least_partner(n, known)
                fewest = int(np.ceil(share * (n + partner) - 1e-9))  # shingles in common with any partner
                needed = max(1, fewest - o)
                found = []
                if len(other) >= needed:
                    prefix = other[: len(other) - needed + 1]
                    found.append((1, prefix.view(np.int64), len(other) - np.arange(len(prefix))))
                if o >= fewest:
                    found.append((3, size_class(np.array([n])), np.zeros(1, np.int64)))
                    most = min(n / least, o / share - n)
                    if asks and most >= partner - 1e-9:
                        low, high = size_class(np.array([partner, np.floor(most + 1e-9)]))
                        found.append((2, np.arange(low, high + 1), np.zeros(high - low + 1, np.int64)))
                for k, values, rest in found:
                    take.append(np.full(len(values), i))
                    kinds.append(np.full(len(values), k, np.int32))
                    keys.append(values)
                    numbers.append(np.column_stack([np.tile([n, o], (len(values), 1)), rest]))
            if take:
                number = np.concatenate(numbers)
                some = batch.select(["c", "d", "root"]).take(pa.array(np.concatenate(take)))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.concatenate(kinds)), pa.array(np.concatenate(keys)), *(pa.array(number[:, j]) for j in range(3))], ["c", "d", "root", "kind", "key", "n", "o", "rest"])

    own = sets.select(F.col("_id").alias("d"), F.col("_set").alias("_x"))
    centers = _table(sets.select(F.col("_id").alias("c"), F.col("_set").alias("_y")).join(members.select("c").distinct(), "c"))
    centers = _table(centers.join(_frequencies(members, centers, sets), "c", "left"))
    # dealt anew by both, as many documents may share a center and a document may have many
    rows = members.join(centers, "c").join(own, "d").select("c", "d", "root", "asks", "sizes", "_x", "_y", "frequencies").repartition("c", "d")
    return rows.mapInArrow(run, f"c {kind}, d {kind}, root {kind}, kind int, key bigint, n bigint, o bigint, rest bigint")


def _across(keyed: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different classes that the keys of ``_around`` bring together."""
    share = least / (1 + least)
    shared = keyed.where("kind = 1")
    mixed = shared.groupBy("c", "key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("c", "key")
    shared = shared.join(mixed, ["c", "key"], "left_semi")
    side = lambda df, e: df.select("c", "key", F.col("d").alias(e), *[F.col(c).alias(c[:1] + e if c != "rest" else f"left{e}") for c in ("root", "n", "o", "rest")])
    fit = (F.col("na") >= least * F.col("nb") - 1e-9) & (F.col("nb") >= least * F.col("na") - 1e-9)
    common = share * (F.col("na") + F.col("nb")) - 1e-9
    # what the center lacks must make up for what it has of one of them at most; from the shared shingle on, enough must be left
    enough = F.least("lefta", "leftb") + F.least("oa", "ob") >= common
    by_token = side(shared, "a").join(side(shared, "b"), ["c", "key"]).where((F.col("ra") != F.col("rb")) & (F.col("a") < F.col("b")) & fit & enough)
    asked, owned = side(keyed.where("kind = 2"), "a"), side(keyed.where("kind = 3"), "b")
    by_size = asked.join(owned, ["c", "key"]).where((F.col("ra") != F.col("rb")) & fit & (F.col("oa") >= common) & (F.col("ob") >= common))
    return by_token.select("a", "b").union(by_size.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def _joined(rows: DataFrame, groups: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` with the columns of ``groups`` (a row for each key, ``n`` rows belong to it), large groups by broadcast."""
    found = groups.agg(F.sum(n).alias("n"), F.max(n).alias("most")).first()
    bound = max(SMALL_GROUP, (found["n"] or 0) // LARGE_GROUPS)
    if (found["most"] or 0) <= bound:
        return rows.join(groups, key)
    heavy = F.broadcast(groups.where(F.col(n) > bound))
    return rows.join(heavy, key).unionByName(rows.join(heavy, key, "left_anti").join(groups.where(F.col(n) <= bound), key))


def _linked(docs: DataFrame, id_column: str, text_column: str, least: float, tied: bool) -> tuple[DataFrame, DataFrame]:
    """Documents (_id, _v, _rows) and vertices: _v, _first (least id), _docs, _root (of the class), _named (the class' least id), _lead (of its class).

    Texts are read twice: for the sketches, and, of vertices with a promising
    partner, for the exact test.  Sketches, bands and links are small against the
    texts.  ``tied``: an id that has several texts ties their vertices together.
    """
    sketch = cut(_sketch(docs, id_column, text_column))
    members = _table(sketch.groupBy("_id", "_v").agg(F.count(F.lit(1)).alias("_rows")))
    first = _table(sketch.groupBy("_v").agg(F.min("_id").alias("_first"), F.max("_n").alias("_n"), F.first("_bands").alias("_bands"), F.first("_sig").alias("_sig"), F.count(F.lit(1)).alias("_docs")))
    links = []
    if tied:
        several = members.groupBy("_id").agg(F.min("_v").alias("a"), F.max("_v").alias("_last")).where("a <> _last").select("_id", "a")
        links.append(members.join(several, "_id").where("a <> _v").select("a", F.col("_v").alias("b")))

    exploded = first.select(F.col("_v").alias("d"), F.explode("_bands").alias("band"))
    shared = exploded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    together = _table(exploded.join(shared, "band"))
    central = together.groupBy("d").agg(F.sum("n").alias("weight"))
    bands = _table(together.join(central, "d"))
    centers = bands.groupBy("band").agg(F.max_by("d", F.struct(F.col("weight"), F.col("d"))).alias("c"))
    bands = _table(bands.join(centers, "band"))
    star = _table(bands.where("d <> c").groupBy(F.col("c").alias("a"), F.col("d").alias("b")).agg(F.max("weight").alias("weight")))
    sigs = first.select(F.col("_v").alias("_id"), "_sig")
    trials = _table(_agreeing(star.select("a", "b"), sigs))
    wanted = trials.select(F.explode(F.array("a", "b")).alias("_id")).union(bands.where(F.col("n") > SMALL_BAND).select("d")).distinct()
    sets = cut(_shingle_sets(docs, wanted, first, id_column, text_column))
    close = _table(_verified(trials, sets, least))

    # what the links to centers connect is settled: only vertices of different roots are held against each other
    up = components(reduce(DataFrame.union, [close, *links]))
    rooted = lambda df, c, name: df.join(up.select(F.col("v").alias(c), F.col("root").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))

    # bands whose members have different roots
    of = rooted(bands, "d", "root")
    mixed = of.groupBy("band").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("band")
    left = _table(of.join(mixed, "band", "left_semi"))
    small = left.where(F.col("n") <= SMALL_BAND)
    x, y = small.select("band", F.col("d").alias("a"), F.col("root").alias("ra")), small.select("band", F.col("d").alias("b"), F.col("root").alias("rb"))
    few = x.join(y, "band").where("ra <> rb AND a < b").select("a", "b")
    inside = left.where(F.col("n") > SMALL_BAND).select("c", "d", "root").distinct()
    inside = _table(inside.join(first.select(F.col("_v").alias("d"), F.floor(F.log(F.col("_n").cast("double")) / F.log(F.lit(SIZE_STEP))).alias("_size")), "d"))
    sizes = inside.groupBy("c").agg(F.collect_set("_size").alias("sizes"), F.count(F.lit(1)).alias("n"))
    around = rooted(inside.join(sizes, "c"), "c", "_rc").select("c", "d", "root", (F.col("root") != F.col("_rc")).alias("asks"), "sizes", "n")
    keyed = cut(_around(around, sets, least))
    few = few.union(_across(keyed, least)).distinct()
    few = _table(_agreeing(few.join(trials.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), sigs))
    more = few.select(F.explode(F.array("a", "b")).alias("_id")).distinct().join(sets.select("_id"), "_id", "left_anti")
    bridges = _table(_verified(few, sets.unionByName(_shingle_sets(docs, _table(more), first, id_column, text_column).join(sets.select("_id"), "_id", "left_anti")), least))

    # what remains is a graph of roots: links between vertices that have different ones
    between = rooted(rooted(bridges, "a", "ra"), "b", "rb").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    top = components(between)
    hung = up.select("v", "root").join(top.select(F.col("v").alias("root"), F.col("root").alias("_top")), "root", "left").select("v", F.coalesce("_top", "root").alias("root"))
    alone = top.join(up.select("v"), "v", "left_anti")
    tree = hung.union(alone.select("v", "root"))

    # classes of several vertices get their least id; every other vertex is a class of its own
    vertices = _table(tree.distinct().select(F.col("v").alias("_v"), F.col("root").alias("_root")).join(first.select("_v", "_first", "_docs"), "_v"))
    classes = vertices.groupBy("_root").agg(F.min(F.struct("_first", "_v")).alias("_least"), F.count(F.lit(1)).alias("_vertices"))
    named = _joined(vertices, _table(classes), "_root", "_vertices").select("_v", "_root", F.col("_least")["_first"].alias("_named"), (F.col("_least")["_v"] == F.col("_v")).alias("_lead"))
    out = first.select("_v", "_first", "_docs").join(named, "_v", "left").select("_v", "_first", "_docs", F.coalesce("_root", "_v").alias("_root"), F.coalesce("_named", "_first").alias("_named"), F.coalesce("_lead", F.lit(True)).alias("_lead"))
    return members, _table(out)


def find_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = SIMILARITY) -> DataFrame:
    """Per id among the rows with an id and a word: id, class_id, class_size (documents) and copy_of (first with the same words)."""
    with scope(docs.sparkSession) as keep:
        members, vertices = _linked(docs, id_column, text_column, least, True)
        each = _joined(members, vertices, "_v", "_docs").groupBy("_id").agg(F.min("_named").alias("class_id"), F.min("_first").alias("copy_of"), F.min("_root").alias("_root"))
        each = _table(each)
        sizes = _table(each.groupBy("_root").agg(F.count(F.lit(1)).alias("class_size"), F.min("class_id").alias("_named")))
        found = keep(_joined(each, sizes, "_root", "class_size").select("_id", F.col("_named").alias("class_id"), "class_size", "copy_of"))
    return found.select(F.col("_id").alias(id_column), "class_id", "class_size", "copy_of")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = SIMILARITY) -> DataFrame:
    """Per id of ``docs``: id, class_id, class_size, copy_of and kept (it names its class); documents without words are their own class."""
    ids = docs.where(F.col(id_column).isNotNull()).select(id_column).distinct()
    found = find_classes(docs, id_column, text_column, least)
    out = ids.join(found, id_column, "left")
    return out.select(
        id_column, F.coalesce("class_id", id_column).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"), F.coalesce("copy_of", id_column).alias("copy_of"), (F.coalesce("class_id", id_column) == F.col(id_column)).alias("kept")
    )


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class of texts: that with the least id.

    Rows that repeat an id are told apart by their words; of rows with the same id
    and words one stays.  Rows without an id or without a word all stay.  Only
    rows whose id occurs more than once have their texts shuffled.
    """
    spark = docs.sparkSession
    with scope(spark) as keep:
        members, vertices = _linked(docs, id_column, text_column, least, False)
        judged = _joined(members, vertices, "_v", "_docs").select("_id", "_v", (F.col("_lead") & (F.col("_id") == F.col("_first"))).alias("_stays"))
        repeated = _table(docs.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id"))
        again = repeated.count()
        judged = _table(judged.where("NOT _stays").join(repeated.withColumn("_again", F.lit(True)), "_id", "left")) if again else judged.where("NOT _stays")
        out = keep(judged.where("_again IS NULL").select("_id") if again else judged.select("_id"))
        gone_again = keep(judged.where("_again").select("_id", "_v")) if again else None
        repeated = keep(repeated) if again else None
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_IDS else df
    named, who, what = free_names(docs.columns, ["_gone", "_who", "_what"])
    gone = out.select(F.col("_id").alias(named))
    kept = docs.join(few(gone), docs[id_column] == gone[named], "left_anti")
    if not again:
        return kept
    twice = few(repeated.select(F.col("_id").alias(named)))
    once = kept.join(twice, kept[id_column] == twice[named], "left_anti")
    rows = _with_words(kept.join(twice, kept[id_column] == twice[named], "left_semi"), text_column, what)
    lost = gone_again.select(F.col("_id").alias(who), F.col("_v").alias(f"{what}_lost"))
    rows = rows.join(lost, (rows[id_column] == lost[who]) & (rows[what] == lost[f"{what}_lost"]), "left_anti")
    wordy = rows.where(F.col(what).isNotNull()).dropDuplicates([id_column, what])
    return once.unionByName(wordy.drop(what)).unionByName(rows.where(F.col(what).isNull()).drop(what))


def _with_words(docs: DataFrame, text_column: str, name: str) -> DataFrame:
    """``docs`` with the hash of the words of each text, null where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, text_column, 1 << 20):
            texts = batch.column(text_column).cast(pa.binary()).to_pylist()
            hashes, sizes = word_hashes([t or b"" for t in texts])
            found = fingerprints(hashes, sizes).view(np.int64)
            yield batch.append_column(name, pa.array(found, pa.int64(), mask=sizes == 0))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))
