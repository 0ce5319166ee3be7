"""Brown class bigrams: a language model whose words are put into classes by exchange clustering.

Training counts every word.  The CLUSTERED most frequent ones, the core, are
dealt into CLASSES classes; each is moved in turn to the class that raises the
likelihood of the class bigrams most, until none moves.  Every other word that
occurs FLOOR times or more joins the class its neighbours in the core speak for
(``assign``), in a distributed pass.  Words below FLOOR and unknown ones make up
one open class; the end of a text is a class of its own.  A token costs the
transition from the class of the token before it (the end class at the start) to
its own class and the emission of the word from it:

    log10 P(class | state) + log10 P(word | class)

Transitions are smoothed towards the class frequencies; the open class emits a
word seen c times with (c + 0.1) / (N + 0.1 (V + 1)), N and V being its tokens
and words.

Counts of words and transitions of classes cover all training texts.  What
reaches the driver is bounded by the model's size: FREQUENT words with their
classes, the bigrams of the core (sparse) and a matrix of the classes.  Classes
of words beyond the frequent ones are joined by a shuffle.

Defined cases: a null text counts as empty and still has its end token; a null
id has remainder 0 and is held out; without training texts every count is 0; of
words that occur equally often the first in byte order is the more frequent;
repeated rows count each and are scored each; an empty table gives an empty
result; further columns are left out unless they are kept, and those that bear
names of the results give way to them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, cut

#: Words of the core, classes, and words whose classes every task holds.
CLUSTERED, CLASSES, FREQUENT = 2000, 64, 200_000
#: Occurrences that a word needs for a class; a vocabulary that every task holds whole.
FLOOR, FEW = 2, 10_000
#: Weight of the class frequencies in a transition, and the count added to a word.
PRIOR, ADDED = 20.0, 0.1
#: A byte that no word holds stands for the end of a text.
END = b"\n"
#: Different words that a task counts before it passes them on.
HELD_WORDS = 300_000
#: A class beside a word (before it, or behind it after all those before) and how often it was seen there.
SEEN = np.dtype([("cell", "u2"), ("n", "<u4")])


def remainder(n: int, id_column: str = "doc_id") -> Column:
    """crc32 of the id as text modulo n; 0 for a null id."""
    return F.pmod(F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(0)), F.lit(n))


def tokens_of(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """All tokens of the texts, each text closed by END, and the number of tokens of each text."""
    tokens: list[bytes] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        before = len(tokens)
        if text:
            tokens += text.encode().lower().split()
        tokens.append(END)
        sizes[i] = len(tokens) - before
    return tokens, sizes


def count_words(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Every word (END too) and how often it occurs: combined in each task, then by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches_of(batches, text_column):
            counts.update(tokens_of(batch.column(text_column).to_pylist())[0])
            if len(counts) >= HELD_WORDS:
                yield out()
                counts.clear()
        if counts:
            yield out()

    return docs.select(text_column).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def least_frequent(counts: DataFrame, most: int) -> int:
    """The least count that ``most`` words at most reach, up to the width of a histogram of logarithms; no word may reach it."""
    width = 64.0
    rows = counts.groupBy(F.floor(F.log2("n") * width).alias("b")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).orderBy(F.desc("b")).collect()
    words, least = 0, 1 << 62
    for r in rows:
        words += r["words"]
        if words > most:
            break
        least = r["least"]
    return least


@dataclass
class Bigrams:
    """Counts of (word before, word) over the core words, the end being word 0, and, as the last, all others: sorted cells."""

    side: int
    cell: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, matrix: np.ndarray) -> Bigrams:
        """From a square matrix, or one without the row of all others."""
        at = np.flatnonzero(matrix)
        return cls(matrix.shape[1], at, matrix.reshape(-1)[at].astype(np.float64))

    def lines(self, down: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By word before (or, ``down``, by word): where each one's entries start, the other words, the counts."""
        own, other = self.cell // self.side, self.cell % self.side
        if down:
            own, other = other, own
        by = np.argsort(own, kind="stable")
        return np.searchsorted(own[by], np.arange(self.side + 1)), other[by].astype(np.int32), self.n[by]


def count_bigrams(docs: DataFrame, vocabulary: list[bytes], text_column: str = "text") -> Bigrams:
    """The bigrams of all training texts; a task holds a table of them, the driver those that occur."""
    m = len(vocabulary)
    side = m + 1
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, total = shared.value.get, np.zeros(side * side, np.int64)
        for batch in batches_of(batches, text_column):
            tokens, _ = tokens_of(batch.column(text_column).to_pylist())
            ids = np.fromiter(map(get, tokens, repeat(m)), np.int64, len(tokens))
            cells, times = np.unique(before(ids, 0) * side + ids, return_counts=True)
            total[cells] += times
        yield from _cells(total)

    found = docs.select(text_column).mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell = found["cell"].to_numpy()
    by = np.argsort(cell)
    return Bigrams(side, cell[by], found["n"].to_numpy()[by].astype(np.float64))


def _cells(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(total)
    for a in range(0, len(at), 100_000):
        some = at[a : a + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])


def _summed(cells: DataFrame, side: int) -> np.ndarray:
    found = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(side * side, np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(side, side)


def before(ids: np.ndarray, end: int) -> np.ndarray:
    """For each token the one before it.  Texts are laid end to end and closed by ``end``."""
    return np.append(np.array([end], ids.dtype), ids[:-1])[: len(ids)]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: Bigrams | np.ndarray, classes: int, rounds: int = 10) -> np.ndarray:
    """Class of each clustered word; class ``classes`` is the end's.  Words start dealt out by frequency.

    All other words are a class that no word joins or leaves.  A move costs the classes
    times those of them that the word meets.
    """
    found = bigrams if isinstance(bigrams, Bigrams) else Bigrams.of(bigrams)
    m = found.side - 1
    k = min(classes, max(1, m - 1))
    end, other = k, k + 1
    of = np.concatenate([[end], np.arange(max(0, m - 1)) % k, [other]]).astype(np.int64)
    (out_at, out_to, out_n), (in_at, in_of, in_n) = found.lines(False), found.lines(True)
    # between words and classes: o[w, h] w followed by class h; i[w, g] w behind class g
    size = k + 2
    left, right = found.cell // found.side, found.cell % found.side
    o = np.bincount(left * size + of[right], found.n, found.side * size).reshape(-1, size)
    i = np.bincount(right * size + of[left], found.n, found.side * size).reshape(-1, size)
    n = np.bincount(of[left] * size + of[right], found.n, size * size).reshape(size, size)
    f, diagonal = _xlogx(n), np.arange(k)
    for _ in range(rounds):
        moved = 0
        for w in range(1, m):
            a = of[w]
            some = slice(out_at[w], out_at[w + 1])
            own = float(out_n[some][out_to[some] == w].sum())
            ow, iw = o[w].copy(), i[w].copy()
            ow[a] -= own
            iw[a] -= own
            n[a] -= ow
            n[:, a] -= iw
            n[a, a] -= own
            f[a], f[:, a] = _xlogx(n[a]), _xlogx(n[:, a])
            rows, cols = n.sum(1)[:k], n.sum(0)[:k]
            behind, ahead = np.flatnonzero(ow), np.flatnonzero(iw)
            gain = (_xlogx(n[:k, behind] + ow[behind]) - f[:k, behind]).sum(1) + (_xlogx(n[ahead, :k] + iw[ahead, None]) - f[ahead, :k]).sum(0)
            corner, old = n[diagonal, diagonal], f[diagonal, diagonal]
            gain += _xlogx(corner + ow[:k] + iw[:k] + own) - _xlogx(corner + ow[:k]) - _xlogx(corner + iw[:k]) + old
            gain -= _xlogx(rows + ow.sum() + own) - _xlogx(rows)
            gain -= _xlogx(cols + iw.sum() + own) - _xlogx(cols)
            to = int(gain.argmax())
            if gain[to] <= gain[a] + 1e-9:
                to = a
            n[to] += ow
            n[:, to] += iw
            n[to, to] += own
            f[to], f[:, to] = _xlogx(n[to]), _xlogx(n[:, to])
            if to != a:
                moved += 1
                of[w] = to
                which, times = in_of[in_at[w] : in_at[w + 1]], in_n[in_at[w] : in_at[w + 1]]
                o[which, a] -= times
                o[which, to] += times
                which, times = out_to[some], out_n[some]
                i[which, a] -= times
                i[which, to] += times
        if not moved:
            break
    return of[:m]


def class_bigrams(bigrams: Bigrams, of: np.ndarray) -> np.ndarray:
    """The bigrams by class; words outside the core make up the last one."""
    to = np.append(of, of[0] + 1)
    size = int(to[-1]) + 1
    return np.bincount(to[bigrams.cell // bigrams.side] * size + to[bigrams.cell % bigrams.side], bigrams.n, size * size).reshape(size, size)


def context_weights(n: np.ndarray) -> np.ndarray:
    """Row for each class before a word, then for each class behind it; column for each class the word may join.

    A word's counts by these rows times the matrix is, in the first order, what
    the likelihood of the class bigrams gains as the word joins the class.
    """
    k = len(n) - 2
    share = lambda x: (x + ADDED) / (x.sum() + ADDED * len(x))
    back = (n + PRIOR * share(n.sum(1))[:, None]) / (n.sum(0) + PRIOR)
    ahead = (n.T + PRIOR * share(n.sum(0))[:, None]) / (n.sum(1) + PRIOR)
    return np.log(np.concatenate([back, ahead]))[:, :k]


def assign(docs: DataFrame, vocabulary: list[bytes], of: np.ndarray, n: np.ndarray, text_column: str = "text") -> DataFrame:
    """Every word outside the core: word, n and the class that its neighbours speak for; words below FLOOR are open."""
    m, size = len(vocabulary), len(n)
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})
    klass, weights = np.append(of, size - 1), context_weights(n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, index = shared.value.get, {}
        cells, times, parts, waiting = np.zeros(0, np.int64), np.zeros(0), [], 0

        def merge() -> None:
            nonlocal cells, times, waiting
            every = np.concatenate([cells, *parts])
            cells, at = np.unique(every, return_inverse=True)
            times = np.bincount(at, np.append(times, np.ones(len(every) - len(times))), len(cells))
            parts.clear()
            waiting = 0

        def out() -> pa.RecordBatch:
            merge()
            starts = np.flatnonzero(np.diff(cells // (2 * size), prepend=-1))
            seen = np.zeros(len(cells), SEEN)
            seen["cell"], seen["n"] = cells % (2 * size), times
            return pa.RecordBatch.from_arrays([pa.array(list(index), pa.binary()), _binary(seen.tobytes(), np.append(starts, len(cells)) * SEEN.itemsize)], ["word", "seen"])

        for batch in batches_of(batches, text_column):
            tokens, _ = tokens_of(batch.column(text_column).to_pylist())
            ids = np.fromiter(map(get, tokens, repeat(m)), np.int64, len(tokens))
            at = np.flatnonzero(ids == m)
            c = klass[ids]
            word = np.fromiter((index.setdefault(tokens[i], len(index)) for i in at.tolist()), np.int64, len(at)) * (2 * size)
            # an end closes every text, so that a word outside the core has a token behind it
            parts += [word + before(c, klass[0])[at], word + size + c[at + 1]]
            waiting += 2 * len(at)
            if len(index) >= HELD_WORDS:
                yield out()
                index.clear()
                cells, times = cells[:0], times[:0]
            elif waiting > 2_000_000:
                merge()
        if index:
            yield out()

    def settle(part: pa.RecordBatch) -> pa.RecordBatch:
        word, seen = part.column(0), part.column(1)
        first = _changes(word)
        offsets = np.frombuffer(seen.buffers()[1], np.int32)[seen.offset : seen.offset + len(seen) + 1]
        pairs = np.frombuffer(seen.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(SEEN)
        at = np.repeat(np.cumsum(first) - 1, np.diff(offsets) // SEEN.itemsize)
        x = np.bincount(at * (2 * size) + pairs["cell"], pairs["n"], first.sum() * 2 * size).reshape(-1, 2 * size)
        total = x[:, :size].sum(1).astype(np.int64)
        joined = np.where(total < FLOOR, size - 1, np.round(x @ weights, 9).argmax(1))
        return pa.RecordBatch.from_arrays([word.take(pa.array(np.flatnonzero(first))), pa.array(total), pa.array(joined.astype(np.int32))], ["word", "n", "class"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            last = int(np.flatnonzero(_changes(batch.column(0)))[-1])
            if last:
                yield settle(batch.slice(0, last))
            rest = batch.slice(last)
        if rest is not None:
            yield settle(rest)

    seen = docs.select(text_column).mapInArrow(count, "word binary, seen binary")
    return seen.repartition("word").sortWithinPartitions("word").mapInArrow(join, "word binary, n bigint, class int")


def _changes(words: pa.Array) -> np.ndarray:
    """True where a word differs from the one before it."""
    return np.append(True, pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False))


def _binary(data: bytes, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


@dataclass
class Model:
    """Held words: rows of ``id`` to ``klass``.  Classes: 0 to k-1, the end's, the open one (last)."""

    id: dict[bytes, int]
    base: np.ndarray  # log10 of the unigram probability, by word
    emission: np.ndarray  # log10 P(word | class), by word
    klass: np.ndarray  # by word
    transition: np.ndarray  # log10 P(class | class)
    mass: np.ndarray  # tokens, by class
    tokens: int  # N
    words: int  # V
    open_tokens: float
    open_words: float

    @property
    def open(self) -> int:
        return len(self.transition) - 1

    def base_of(self, c: Column) -> Column:
        return F.log10((c + ADDED) / F.lit(self.tokens + ADDED * (self.words + 1)))

    def emission_of(self, c: Column, klass: Column) -> Column:
        of_open = F.log10((c + ADDED) / F.lit(self.open_tokens + ADDED * (self.open_words + 1)))
        return F.when(klass == self.open, of_open).otherwise(F.log10(c / F.get(F.lit(self.mass.tolist()), klass)))


def learn(docs: DataFrame, text_column: str = "text", clustered: int = CLUSTERED, classes: int = CLASSES, frequent: int = FREQUENT, few: int = FEW) -> tuple[Model, DataFrame]:
    """The model, but for its transitions, and the table of all words (word, n, class)."""
    counts = cut(count_words(docs, text_column))
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, words = total["n"] or 0, total["v"]
    if not words:
        return Model({}, np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros((2, 2)), np.zeros(2), 0, 0, 0.0, 0.0), counts.withColumn("class", F.lit(1))
    least = 1 if words <= few else least_frequent(counts, frequent)
    first = lambda x: (x[0] != END, -x[1], x[0])
    ends = F.col("word") == F.lit(bytearray(END))
    core = counts.where(~ends & (F.col("n") >= FLOOR)).orderBy(F.desc("n"), "word").limit(clustered).collect()
    top = [(END, counts.where(ends).first()["n"]), *((bytes(r["word"]), r["n"]) for r in core)]
    vocabulary = [w for w, _ in top]
    bigrams = count_bigrams(docs, vocabulary, text_column)
    of = exchange(bigrams, classes)
    n = class_bigrams(bigrams, of)
    core = docs.sparkSession.createDataFrame([(bytearray(w), c, int(g)) for (w, c), g in zip(top, of, strict=True)], "word binary, n bigint, class int")
    table = cut(assign(docs, vocabulary, of, n, text_column).union(core))
    size = len(n)
    mass, members = np.zeros(size), np.zeros(size)
    for r in table.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        mass[r["class"]], members[r["class"]] = r["n"], r["words"]
    held = sorted(((bytes(r["word"]), r["n"], r["class"]) for r in table.where((F.col("n") >= least) | (F.col("class") == size - 2)).toLocalIterator()), key=first)
    c, klass = np.array([x[1] for x in held], np.float64), np.array([x[2] for x in held], np.int64)
    emission = np.where(klass == size - 1, np.log10((c + ADDED) / (mass[-1] + ADDED * (members[-1] + 1))), np.log10(c / np.maximum(mass[klass], 1)))
    base = np.log10((c + ADDED) / (tokens + ADDED * (words + 1)))
    return Model({x[0]: i for i, x in enumerate(held)}, base, emission, klass, np.zeros((size, size)), mass, tokens, words, float(mass[-1]), float(members[-1])), table


def with_transitions(model: Model, coded: DataFrame) -> Model:
    """The model with the transitions between neighbouring tokens of ``coded`` texts."""
    size, end = len(model.transition), model.open - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            c = _codes(batch.column(0))[0].astype(np.int64)
            total += np.bincount(before(c, end) * size + c, minlength=len(total))
        yield from _cells(total)

    n = _summed(coded.select("__lm_classes").mapInArrow(run, "cell bigint, n bigint"), size)
    share = (model.mass + ADDED) / (model.tokens + ADDED * size)
    return replace(model, transition=np.log10((n + PRIOR * share) / (n.sum(1, keepdims=True) + PRIOR)))


def fit(docs: DataFrame, text_column: str = "text", clustered: int = CLUSTERED, classes: int = CLASSES, frequent: int = FREQUENT, few: int = FEW) -> tuple[Model, DataFrame]:
    """The model and the table of all words (word, n, class), learned from all rows of ``docs``."""
    model, counts = learn(docs, text_column, clustered, classes, frequent, few)
    return (with_transitions(model, code(docs, model, counts, [], text_column)) if model.words else model), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """``keep`` columns, n_tokens, n_known, train_tokens, base_score, score and perplexity, for every row."""
    return rate(code(docs, model, counts, keep, text_column), model, keep)


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and where each row starts, the end of the last one included."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def kept_columns(keep: list[str]) -> list[str]:
    """The kept columns, each once, but for those that bear names of results."""
    return [c for c in dict.fromkeys(keep) if c not in ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")]


def code(docs: DataFrame, model: Model, counts: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """``keep`` columns, n_tokens, n_known, base_score, the sum of emissions and a byte for the class of each token, for every row.

    Texts are read once, in place.  Words that tasks do not hold leave with their
    place and meet their counts and classes in a shuffle.
    """
    keep = kept_columns(keep)
    shared = docs.sparkSession.sparkContext.broadcast((model.id, model.base, model.emission, model.klass))
    kinds = dict(docs.dtypes)
    sums = ["n_tokens", "n_known", "base_score", "__lm_emission"]
    kept = [f"`{c}` {kinds[c]}" for c in keep]
    numbers = "n_tokens bigint, n_known bigint, base_score double, __lm_emission double, __lm_classes binary"
    schema = ", ".join(["__lm_row bigint", "__lm_word binary", "__lm_at bigint", *kept, numbers])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of, base, emission, klass = shared.value
        get, row = id_of.get, TaskContext.get().partitionId() << 40
        base, emission = np.append(base, 0.0), np.append(emission, 0.0)
        known, klass = np.append(np.ones(len(klass), np.int64), 0), np.append(klass, 0).astype(np.uint8)
        for batch in batches_of(batches, text_column):
            tokens, sizes = tokens_of(batch.column(text_column).to_pylist())
            ends = np.cumsum(sizes)
            starts = ends - sizes
            ids = np.fromiter(map(get, tokens, repeat(-1)), np.int64, len(tokens))
            rows = np.arange(row, row + len(sizes))
            row += len(sizes)
            whole = lambda x: np.add.reduceat(x, starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.int64()), *(batch.column(k) for k in keep), pa.array(sizes), pa.array(whole(known[ids])), pa.array(whole(base[ids])), pa.array(whole(emission[ids])), _binary(klass[ids].tobytes(), np.append(starts, ends[-1]))],
                ["__lm_row", "__lm_word", "__lm_at", *keep, *sums, "__lm_classes"],
            )
            rare = np.flatnonzero(ids < 0)
            if n := len(rare):
                who = np.searchsorted(starts, rare, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[who]), pa.array([tokens[i] for i in rare.tolist()], pa.binary()), pa.array(rare - starts[who]), *(pa.nulls(n, batch.column(k).type) for k in keep), *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()))],
                    ["__lm_row", "__lm_word", "__lm_at", *keep, *sums, "__lm_classes"],
                )

    found = cut(docs.select(*dict.fromkeys([*keep, text_column])).mapInArrow(run, schema))
    rare = found.where(F.col("__lm_word").isNotNull()).select("__lm_row", F.col("__lm_word").alias("word"), "__lm_at")
    c, g = F.coalesce(F.col("n"), F.lit(0)), F.coalesce(F.col("class"), F.lit(model.open))
    late = rare.join(counts, "word", "left").groupBy("__lm_row").agg(
        F.sum((c > 0).cast("bigint")).alias("__lm_known"), F.sum(model.base_of(c)).alias("__lm_base"), F.sum(model.emission_of(c, g)).alias("__lm_late"), F.collect_list(F.col("__lm_at") * 256 + g).alias("__lm_places")
    )
    zero = F.lit(0)
    both = found.where(F.col("__lm_word").isNull()).join(late, "__lm_row", "left").select(
        *keep,
        "n_tokens",
        (F.col("n_known") + F.coalesce("__lm_known", zero)).alias("n_known"),
        (F.col("base_score") + F.coalesce("__lm_base", zero)).alias("base_score"),
        (F.col("__lm_emission") + F.coalesce("__lm_late", zero)).alias("__lm_emission"),
        "__lm_classes",
        "__lm_places",
    )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, offsets = _codes(batch.column("__lm_classes"))
            codes, places = codes.copy(), batch.column("__lm_places")
            n = np.nan_to_num(pc.list_value_length(places).to_numpy(zero_copy_only=False)).astype(np.int64)
            flat = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            codes[np.repeat(offsets[:-1], n) + flat // 256] = flat % 256
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in [*keep, *sums]), _binary(codes.tobytes(), offsets)], [*keep, *sums, "__lm_classes"])

    return cut(both.mapInArrow(fill, ", ".join([*kept, numbers])))


def rate(coded: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Scores of ``coded`` texts."""
    transition, end, keep = model.transition, model.open - 1, kept_columns(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, offsets = _codes(batch.column("__lm_classes"))
            state = before(codes, end)
            state[offsets[:-1]] = end
            steps = np.add.reduceat(transition[state, codes], offsets[:-1])
            score = steps + batch.column("__lm_emission").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in [*keep, "n_tokens", "n_known", "base_score"]), pa.array(score)], [*keep, "n_tokens", "n_known", "base_score", "score"])

    kinds = dict(coded.dtypes)
    out = coded.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens bigint, n_known bigint, base_score double, score double"]))
    out = out.select(*keep, "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), F.least(F.lit(300.0), -F.col("score") / F.col("n_tokens"))))
