"""Quality rules with host verdicts.

Every document is measured and fails or passes a set of rules.  Failures of each
rule are summed by domain; each rule's rates are shrunk towards a beta prior
whose mean is the rate of the whole corpus and whose weight is fitted to the
spread of the domains' rates beyond sampling noise (moments).  A domain is
rejected if, for any rule, its rate exceeds that rule's ceiling with some
certainty: the shrunk rate less CERTAINTY posterior standard deviations.  The
ceiling is LIFT times the corpus' rate, within CEILING.  The verdict is joined
back to the domain's documents.  A document goes if it fails a rule itself or if
its domain is rejected.

Only one row for each document, without its text, is ever shuffled, and the
sums by domain are combined before the shuffle; a domain with a third of all
rows adds one partial row for each task.

Defined cases: a null text has no words and fails; a null domain is a domain of
its own; an empty table gives an empty result; repeated rows count each; a rate
that equals the ceiling is not rejected; columns of any name may be kept, also
those that bear names used here (the results' names win in ``judge``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, cut, free_names

#: Base rules: least words, greatest percentage of words in repeated windows.
LEAST_WORDS, REPEAT_PERCENT = 50, 50
#: Further rules: symbols a hundred words, duplicate lines a hundred words, bounds of the mean word length.
SYMBOL_PERCENT, DUP_LINE_PERCENT, WORD_LENGTHS = 10, 20, (2, 20)
#: Least and greatest ceiling of a domain's failure rate; the ceiling in units of the corpus' rate; standard deviations below the shrunk rate.
CEILING, LIFT, CERTAINTY = (0.3, 0.75), 3.0, 2.0
#: Hosts that are broadcast.
BROADCAST_HOSTS = 200_000
#: The prior weighs as much as so many documents at least and at most.
PRIOR_WEIGHT = (2.0, 1000.0)

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL_BYTES = bytes(i for i in range(256) if chr(i) not in SYMBOLS)
_CONTINUATION = bytes(i for i in range(256) if i & 0xC0 != 0x80)


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    inside = sum(map(len, words))
    chars = inside if len(text or "") == len(data) else inside - len(data.translate(None, _CONTINUATION))
    symbols = len(data.translate(None, _SYMBOL_BYTES))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts, upto = Counter(windows), 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure_documents(docs: DataFrame, keep: list[str], text_column: str = "text", names: dict[str, str] | None = None) -> DataFrame:
    """``keep`` columns of every row with its measures, which may take other ``names``."""
    called = [(names or {}).get(m, m) for m in MEASURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, text_column):
            rows = [measure(t) for t in batch.column(text_column).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(called)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, pa.int64()) for c in columns)], [*keep, *called])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{n}` bigint" for n in called)])
    return docs.select(*dict.fromkeys([*keep, text_column])).mapInArrow(run, schema)


#: The rules, in order; the first two are the base ones.
RULES = ("few_words", "repetition", "symbols", "duplicate_lines", "word_length")


def failures(at: Callable[[str], Column] = F.col) -> list[Column]:
    """For each of RULES whether the document fails it; whole numbers only, so every engine agrees.  ``at`` finds a measure."""
    n, chars, symbols, lines, repeated = (at(c) for c in MEASURES)
    return [
        n < LEAST_WORDS,
        100 * repeated > REPEAT_PERCENT * n,
        100 * symbols > SYMBOL_PERCENT * n,
        100 * lines > DUP_LINE_PERCENT * n,
        (chars < WORD_LENGTHS[0] * n) | (chars > WORD_LENGTHS[1] * n),
    ]


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def host_verdicts(judged: DataFrame) -> DataFrame:
    """Per host: n_docs, host_risk and host_rejected, from rows (host, failed: an array of one boolean for each rule).

    ``host_risk`` is the greatest ratio of a rule's lower bound to its ceiling;
    above 1 the host is rejected.  A few sums for each rule reach the driver.
    """
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *(F.sum(F.col("failed")[i].cast("bigint")).alias(f"k{i}") for i in range(len(RULES))))
    rate = lambda i: F.col(f"k{i}") / F.col("n_docs")
    sums = hosts.agg(
        F.sum("n_docs").alias("d"), F.avg(1 / F.col("n_docs")).alias("noise"), *(f(e).alias(f"{c}{i}") for i in range(len(RULES)) for c, f, e in (("f", F.sum, F.col(f"k{i}")), ("v", F.var_samp, rate(i))))
    ).first()
    risks = [_risk(F.col(f"k{i}"), F.col("n_docs"), *prior(sums[f"f{i}"] or 0, sums["d"] or 0, sums[f"v{i}"] or 0.0, sums["noise"] or 0.0)) for i in range(len(RULES))]
    risk = F.greatest(*risks)
    return hosts.select("host", "n_docs", F.round(risk, 6).alias("host_risk"), (risk > 1).alias("host_rejected"))


def prior(failed: int, docs: int, variance: float, noise: float) -> tuple[float, float]:
    """Mean and weight (in documents) of a rule's beta prior; ``noise`` is the mean of 1 / documents over the hosts."""
    mean = failed / docs if docs else 0.0
    least, most = PRIOR_WEIGHT
    between = variance - mean * (1 - mean) * noise
    return mean, min(most, max(least, mean * (1 - mean) / between - 1)) if between > 0 else most


def _risk(k: Column, n: Column, mean: float, weight: float) -> Column:
    low, high = CEILING
    shrunk = (k + F.lit(mean * weight)) / (n + F.lit(weight))
    below = shrunk - CERTAINTY * F.sqrt(shrunk * (1 - shrunk) / (n + F.lit(weight + 1)))
    return below / F.lit(min(high, max(low, LIFT * mean)))


def _rejected(judged: DataFrame, host: str, failed: list[Column]) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """All verdicts; the rejected hosts, to broadcast; and, if they are many, the large ones among them apart from the rest.

    A host may hold a third of all texts.  If the rejected hosts are too many to
    broadcast, the heaviest BROADCAST_HOSTS of them still are, so that what meets
    the documents in a shuffle are hosts with fewer documents than each of those.
    """
    verdicts = cut(host_verdicts(judged.select(F.col(host).alias("host"), F.array(*failed).alias("failed"))), gather=True)
    bad = verdicts.where("host_rejected").select(F.col("host").alias("_bad_host"), "n_docs")
    if bad.count() <= BROADCAST_HOSTS:
        return verdicts, bad.drop("n_docs"), None
    ranked = cut(bad.orderBy(F.desc("n_docs"), "_bad_host").limit(BROADCAST_HOSTS), gather=True).drop("n_docs")
    large = ranked.withColumnRenamed("_bad_host", "_large")
    return verdicts, ranked, bad.drop("n_docs").join(large, F.col("_bad_host").eqNullSafe(F.col("_large")), "left_anti")


def judge(docs: DataFrame, keep: list[str], host_column: str = "source", text_column: str = "text") -> DataFrame:
    """``keep`` columns, measures, base_failed, doc_failed, host_rejected, host_risk and kept, for every row.

    The measured rows, which hold no text, are written once and used twice: summed and joined.
    """
    names = dict(zip(MEASURES, free_names(docs.columns, MEASURES), strict=True))
    host = free_names([*docs.columns, *names.values()], ["_host"])[0]
    measured = cut(measure_documents(docs.withColumn(host, F.col(host_column)), [*dict.fromkeys(keep), host], text_column, names))
    failed = failures(lambda m: F.col(names[m]))
    verdicts, _, _ = _rejected(measured, host, failed)
    verdicts = verdicts.select(F.col("host").alias("_verdict_of"), F.col("host_rejected").alias("_rejected"), F.col("host_risk").alias("_risk"))
    small = verdicts.count() <= BROADCAST_HOSTS
    joined = measured.join(F.broadcast(verdicts) if small else verdicts, measured[host].eqNullSafe(verdicts["_verdict_of"]), "left")
    rejected = F.coalesce(verdicts["_rejected"], F.lit(False))
    own = _any(failed)
    added = [
        *(F.col(names[m]).alias(m) for m in MEASURES),
        _any(failed[:2]).alias("base_failed"),
        own.alias("doc_failed"),
        rejected.alias("host_rejected"),
        verdicts["_risk"].alias("host_risk"),
        (~own & ~rejected).alias("kept"),
    ]
    taken = {*MEASURES, "base_failed", "doc_failed", "host_rejected", "host_risk", "kept"}
    return joined.select(*(measured[c] for c in dict.fromkeys(keep) if c not in taken), *added)


def filter_documents(docs: DataFrame, host_column: str = "source", text_column: str = "text") -> DataFrame:
    """``docs`` without the rows that ``judge`` would not keep.  Texts are measured twice rather than shuffled."""
    measured = cut(measure_documents(docs, [host_column], text_column))
    _, bad, more = _rejected(measured, host_column, failures())
    names = dict(zip(MEASURES, free_names(docs.columns, MEASURES), strict=True))
    passed = measure_documents(docs, docs.columns, text_column, names).where(~_any(failures(lambda m: F.col(names[m]))))
    for hosts in (F.broadcast(bad), more):
        if hosts is not None:
            of = free_names(passed.columns, ["_bad_host"])[0]
            hosts = hosts.withColumnRenamed("_bad_host", of)
            passed = passed.join(hosts, passed[host_column].eqNullSafe(hosts[of]), "left_anti")
    return passed.select(*(F.col(f"`{c}`") for c in docs.columns))
