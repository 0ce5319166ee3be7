"""Language identification by prediction by partial matching.

Each language has a context tree of bytes up to ORDER deep.  A byte costs the
bits of its prediction in the longest context that has been followed by it, and
of an escape from every longer known context (method C, no exclusion).  The
trees are frozen after training, so a byte's cost depends on itself and the
ORDER bytes before it alone: the costs of all byte strings seen in training are
tabulated for all languages at once, and texts are scored by table look-ups on
whole batches.  A text belongs to the language with the shortest code, counting
the bits of the language's own probability.

Training reads every labelled row for the languages' frequencies and a bounded
sample of pieces of texts for the trees: of each language the distinct pieces
whose hashes are the least, SAMPLE_BYTES of them, whatever the input.  A piece is
PIECE characters of a text; copies of a text have the same pieces, which count
once.  Languages are put into blocks of BLOCK, each with tables of its own, so
that no language is left out, however many there are.

Defined cases: null text, text without a letter, or nothing to learn from give
"und" with score 0; null languages, null and empty texts are not learned from;
ties go to the language that sorts first; texts are scored whole; repeated rows
count each for a language's frequency and give a row each; an empty table gives
an empty result; kept columns that bear names of results give way to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, free_names

#: Bytes of context.  Four bytes make a 32-bit key.
ORDER = 3
#: Training text for each language's tree, characters of the pieces it is made of, and languages whose tables are one block.
SAMPLE_BYTES, PIECE, BLOCK = 400_000, 4_000, 64
UNDETERMINED = "und"
#: Bins of hashes to each halving.
STEPS = 8
#: Costs (bytes times languages) held at once.
CELLS = 1 << 22

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32


class Rows:
    """Look-up of 32-bit keys: levels of hashed slots; keys that lost their slot go to the next level."""

    def __init__(self, keys: np.ndarray):
        self.levels = []
        left, rows = keys.astype(np.uint32), np.arange(len(keys), dtype=np.int32)
        multiplier = 0x9E3779B1
        while len(left):
            bits = max(4, int(len(left) * 3).bit_length())
            slot = self._slot(left, multiplier, bits)
            at = np.full(1 << bits, -1, np.int32)
            at[slot] = rows
            held = np.zeros(1 << bits, np.uint32)
            held[slot] = left
            self.levels.append((multiplier, bits, held, at))
            lost = at[slot] != rows
            left, rows = left[lost], rows[lost]
            multiplier = (multiplier * 5 + 0x6D2B79F6) & 0xFFFFFFFF | 1

    @staticmethod
    def _slot(keys: np.ndarray, multiplier: int, bits: int) -> np.ndarray:
        return (keys * np.uint32(multiplier)) >> np.uint32(32 - bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        todo = None
        for multiplier, bits, held, at in self.levels:
            some = keys if todo is None else keys[todo]
            slot = self._slot(some, multiplier, bits)
            found = np.where(held[slot] == some, at[slot], -1)
            if todo is None:
                out = found.astype(np.int32)
                todo = np.flatnonzero(found < 0)
            else:
                out[todo] = found
                todo = todo[found < 0]
            if not len(todo):
                break
        return out


def grams(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each byte of texts laid end to end, the key of it and the ORDER bytes before it (line ends before a text)."""
    x = _FOLD[data]
    key = x.copy()
    for back in range(1, ORDER + 1):
        shifted = np.full(len(x), 10, np.uint32)
        shifted[back:] = x[:-back]
        for i in range(back):  # bytes of the text before do not count
            at = starts + i
            shifted[at[at < len(x)]] = 10
        key |= shifted << np.uint32(8 * back)
    return key


@dataclass
class Block:
    """Costs in bits, one column for each language of a block, of the strings seen in training."""

    langs: list[str]
    keys: list[np.ndarray]  # the strings seen, by length 1 to ORDER + 1, sorted
    cost: list[np.ndarray]  # of each key's last byte, given the others
    contexts: list[np.ndarray]  # by length 0 to ORDER, sorted
    escape: list[np.ndarray]  # cost of leaving each context, 0 where a language never saw it
    order0: np.ndarray  # a byte never seen

    def tables(self) -> tuple[list[Rows], list[Rows]]:
        return [Rows(k) for k in self.keys], [Rows(k) for k in self.contexts]


@dataclass
class Model:
    """All languages in order, their prior bits, and the blocks that hold their tables."""

    langs: list[str]
    prior: np.ndarray
    blocks: list[Block]


def train(samples: dict[str, list[bytes]], docs: dict[str, int], block: int = BLOCK) -> Model:
    """Context trees from sample texts; ``docs`` counts the labelled rows of each language."""
    langs = sorted(samples)
    total = sum(docs.get(x, 0) for x in langs)
    prior = -np.log2(np.array([(docs.get(x, 0) + 1) / (total + len(langs)) for x in langs]))
    return Model(langs, prior, [_trees({x: samples[x] for x in langs[a : a + block]}) for a in range(0, len(langs), block)])


def _trees(samples: dict[str, list[bytes]]) -> Block:
    langs = list(samples)
    n = len(langs)
    counted = []
    for lang in langs:
        texts = samples[lang]
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        key = grams(data, np.cumsum(sizes) - sizes) if len(data) else np.zeros(0, np.uint32)
        counted.append([np.unique(key & np.uint32((1 << 8 * k) - 1 if k < 4 else 0xFFFFFFFF), return_counts=True) for k in range(1, ORDER + 2)])
    keys = [np.unique(np.concatenate([c[k][0] for c in counted])) for k in range(ORDER + 1)]
    # the strings that something followed, the line ends before a text among them
    contexts = [np.unique(np.concatenate([c[k][0] >> np.uint32(8) for c in counted])) if k else np.zeros(1, np.uint32) for k in range(ORDER + 1)]
    cost: list[np.ndarray] = []
    escape: list[np.ndarray] = []
    base = np.full(n, 8.0)  # a byte never seen in a language: uniform
    for k in range(ORDER + 1):
        context_keys = contexts[k]
        esc = np.zeros((len(context_keys), n))
        own = np.zeros((len(keys[k]), n))
        seen = np.zeros((len(keys[k]), n), bool)
        for j in range(n):
            found, times = counted[j][k]
            context = found >> np.uint32(8) if k else np.zeros(len(found), np.uint32)
            where = np.searchsorted(context_keys, context)
            total = np.bincount(where, times, len(context_keys))
            kinds = np.bincount(where, minlength=len(context_keys))
            known = total > 0
            esc[known, j] = -np.log2(kinds[known] / (total[known] + kinds[known]))
            at = np.searchsorted(keys[k], found)
            own[at, j] = -np.log2(times / (total[where] + kinds[where]))
            seen[at, j] = True
        where = np.searchsorted(context_keys, keys[k] >> np.uint32(8)) if k else np.zeros(len(keys[k]), np.int64)
        out = esc[where]
        if k:
            shorter = keys[k] & np.uint32((1 << 8 * k) - 1)
            out = out + cost[k - 1][np.searchsorted(keys[k - 1], shorter)]
        else:
            out = out + base
        cost.append(np.where(seen, own, out))
        escape.append(esc)
    return Block(langs, keys, [c.astype(np.float32) for c in cost], contexts, [e.astype(np.float32) for e in escape], base)


class Scorer:
    """Code lengths of texts; one for each worker process."""

    def __init__(self, model: Model):
        self.model, self.tables = model, [b.tables() for b in model.blocks]

    def costs(self, key: np.ndarray, block: int) -> np.ndarray:
        """Bits of each byte in each language of a block: look up the whole string, then shorter ones behind escapes."""
        m, (rows, contexts) = self.model.blocks[block], self.tables[block]
        out = np.zeros((len(key), len(m.langs)), np.float32)
        todo = np.arange(len(key))
        for k in range(ORDER, -1, -1):
            some = key[todo] & np.uint32((1 << 8 * (k + 1)) - 1 if k < 3 else 0xFFFFFFFF)
            row = rows[k].find(some)
            hit = row >= 0
            if len(todo) == len(key) and hit.all():
                return m.cost[k][row]
            out[todo[hit]] += m.cost[k][row[hit]]
            todo, some = todo[~hit], some[~hit]
            if not len(todo):
                break
            if k:
                context = contexts[k].find(some >> np.uint32(8))
                known = context >= 0
                out[todo[known]] += m.escape[k][context[known]]
            else:
                out[todo] += m.escape[0][0] + m.order0
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text (rows) in each language."""
        sizes = np.array([len(t) for t in texts], np.int64)
        out = np.tile(self.model.prior, (len(texts), 1))
        full = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[full]
        data = np.frombuffer(b"".join(texts), np.uint8)
        step = max(1, CELLS // max(1, len(self.model.langs[:BLOCK])))
        for a in range(0, len(data), step):  # bounded memory, however long a text and many the languages
            b, low = min(len(data), a + step), max(0, a - ORDER)
            first = np.searchsorted(starts, a, "right") - 1
            last = np.searchsorted(starts, b, "left")
            inside = starts[(starts >= low) & (starts < b)] - low
            key, at, upto = grams(data[low:b], inside)[a - low :], np.maximum(starts[first:last] - a, 0), 0
            for i, block in enumerate(self.model.blocks):
                mine = slice(upto, upto + len(block.langs))
                out[full[first:last], mine] += np.add.reduceat(self.costs(key, i), at, axis=0, dtype=np.float64)
                upto = mine.stop
        return out


def learnable(id_column: str = "doc_id") -> Column:
    """Rows whose crc32 of the id as text leaves another remainder than 1 by 3; a null id counts as 0."""
    return F.pmod(F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(0)), F.lit(3)) != 1


def fit(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang", sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from all rows of ``labelled`` that have a text and a language.

    One aggregation gives each language's rows.  A second one, over distinct pieces
    (a hash and a size each, no text), gives the sizes by the pieces' hashes, from
    which follows up to which hash a language's pieces make up the sample.  Only
    those pieces reach the driver.
    """
    text = F.col(text_column)
    rows = labelled.where(text.isNotNull() & F.col(lang_column).isNotNull() & (text != "")).select(text.alias("text"), F.col(lang_column).alias("lang"))
    totals = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not totals:
        return train({}, {})
    pieces = F.ceil(F.char_length("text") / PIECE).cast("int")
    sized = rows.select("lang", F.xxhash64("text").alias("t"), F.char_length("text").alias("chars"), F.octet_length("text").alias("octets"), pieces.alias("n"))
    size = F.least(F.lit(PIECE), F.col("chars") - F.col("i") * PIECE) * F.col("octets") / F.col("chars")
    hashed = sized.select("lang", "t", "chars", "octets", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select("lang", "t", "i", _chance("t", "i").alias("u"), size.alias("bytes"))
    # the least hashes first; STEPS bins to each halving of the hash
    distinct = hashed.groupBy("lang", "t", "i", "u").agg(F.max("bytes").alias("bytes"))
    bins = distinct.groupBy("lang", F.floor(-F.log2(F.greatest("u", F.lit(2.0**-60))) * STEPS).alias("b")).agg(F.sum("bytes").alias("bytes")).collect()
    upto: dict[str, int] = {}
    got: dict[str, float] = dict.fromkeys((r["lang"] for r in totals), 0.0)
    for r in sorted(bins, key=lambda r: (r["lang"], -r["b"])):
        if got[r["lang"]] < sample_bytes:
            got[r["lang"]] += r["bytes"]
            upto[r["lang"]] = r["b"]
    bound = F.create_map(*(F.lit(x) for lang, b in sorted(upto.items()) for x in (lang, b)))
    chosen = rows.select("lang", F.xxhash64("text").alias("t"), "text", pieces.alias("n"), bound[F.col("lang")].alias("least"))
    # which pieces, by hash alone; only a row that has one is cut
    wanted = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.floor(-F.log2(F.greatest(_chance(F.col("t"), i), F.lit(2.0**-60))) * STEPS) >= F.col("least"))
    chosen = chosen.withColumn("which", wanted).where(F.size("which") > 0).select("lang", "t", "text", F.explode("which").alias("i"))
    found = chosen.select("lang", "t", "i", F.encode(F.substring("text", F.col("i") * PIECE + 1, F.lit(PIECE)), "UTF-8").alias("piece"))
    # first() under an aggregation on the piece's name: copies of a text are combined before the shuffle
    found = found.groupBy("lang", "t", "i").agg(F.first("piece").alias("piece")).select("lang", _chance("t", "i").alias("u"), "piece")
    samples: dict[str, list[bytes]] = {r["lang"]: [] for r in totals}
    room = dict.fromkeys(samples, sample_bytes)
    # in order of the hash, so that the bound cuts alike whatever the partitions
    for r in found.orderBy("lang", "u", "piece").toLocalIterator():
        if room[r["lang"]] > 0:
            samples[r["lang"]].append(bytes(r["piece"]))
            room[r["lang"]] -= len(r["piece"])
    return train(samples, {r["lang"]: r["n"] for r in totals})


def _chance(t: Column | str, i: Column | str) -> Column:
    """A number from 0 to 1 for a piece of a text."""
    return F.pmod(F.xxhash64(t, i), F.lit(1 << 50)) / float(1 << 50)


def predict(docs: DataFrame, model: Model, keep: list[str], text_column: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred, score (probability of the language under the code lengths) and bits_per_byte."""
    keep = [c for c in dict.fromkeys(keep) if c not in ("lang_pred", "score", "bits_per_byte")]
    text_name, letters_name = free_names(keep, ["_text", "_letters"])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches_of(batches, text_name, 1 << 20):
            scorer = scorer or Scorer(shared.value)
            letters = batch.column(letters_name).to_pylist()
            # view as bytes: nothing is decoded
            texts = [t if ok else b"" for t, ok in zip(batch.column(text_name).cast(pa.binary()).to_pylist(), letters, strict=True)]
            langs, scores, rates = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            if scorer.model.langs:
                bits = scorer.score(texts)
                best = bits.argmin(1)
                least = bits[np.arange(len(texts)), best]
                chance = 1 / np.exp2(np.minimum(least[:, None] - bits, 0)).sum(1)
                for i, ok in enumerate(letters):
                    if ok:
                        langs[i], scores[i] = scorer.model.langs[best[i]], chance[i]
                        rates[i] = (least[i] - scorer.model.prior[best[i]]) / max(1, len(texts[i]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores), pa.array(rates)], [*keep, "lang_pred", "score", "bits_per_byte"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string, score double, bits_per_byte double"])
    text = F.col(text_column)
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return docs.select(*keep, F.coalesce(text, F.lit("")).alias(text_name), letters.alias(letters_name)).mapInArrow(run, schema)
