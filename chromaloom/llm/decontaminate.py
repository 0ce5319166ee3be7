"""Benchmark decontamination with DataFrame expressions only.

A broadcast hash set of normalised benchmark word windows is probed with every
word window of every document; a hit counts only if the window's words are
equal too.  Hits are then merged into spans, and spans or documents removed.

A set of windows too large to broadcast is first cut down, by a join of hashes,
to those that occur in the documents at all; should these still be too many,
they are dealt into blocks, a pass over the documents each.

Defined cases: a null or wordless document has no words and stays clean; a
benchmark row with a null id, a null text or no word yields no window; repeated
benchmark rows count once; repeated documents are judged row by row; of hits
that overlap each word counts once; an empty table on either side gives no hit;
further columns may bear any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_names, words_of

#: Words in a window.
WINDOW = 10
#: Windows are broadcast while they take up to so many bytes.
BROADCAST_BYTES = 64 << 20
#: Contaminated documents whose ids are broadcast; more of them meet the documents in a shuffle.
BROADCAST_HITS = 1_000_000


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Distinct windows: gram (words), n_gram (their number), gram_key (hash), items (sorted ids as strings)."""
    words = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words"))
    size = F.size("words")
    starts = words.where(size > 0).select(
        "item", "words", F.least(size, F.lit(n)).alias("n_gram"), F.explode(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))).alias("start")
    )
    grams = starts.select("item", "n_gram", F.slice("words", F.col("start"), F.col("n_gram")).alias("gram"))
    return grams.groupBy("n_gram", "gram").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("gram_key", F.xxhash64("gram"))


def _blocks(windows: DataFrame, limit: int) -> tuple[list[int], int]:
    """Window lengths that occur (n at most), and into how many blocks the windows must be dealt."""
    size = F.octet_length(F.concat_ws(" ", "gram")) + F.octet_length(F.concat_ws(" ", "items")) + 64
    found = windows.groupBy("n_gram").agg(F.sum(size).alias("bytes")).collect()
    return sorted(r["n_gram"] for r in found), max(1, -(-sum(r["bytes"] for r in found) // limit))


def _places(words: DataFrame, lengths: list[int]) -> tuple[DataFrame, Column, Column]:
    """Every window of every document (pos, len, key), and a row without words for a document that has none; the window; which row marks a document."""
    first = lengths[0] if lengths else WINDOW
    at = words.select("*", F.posexplode_outer("words").alias("pos", "word")).drop("word")
    at = at.withColumn("len", F.lit(first) if len(lengths) < 2 else F.explode(F.array(*map(F.lit, lengths))))
    mark = F.col("pos").isNull() | ((F.col("pos") == 0) & (F.col("len") == first))
    gram = F.slice("words", F.col("pos") + 1, F.col("len"))
    return at.where(mark | (F.col("pos") + F.col("len") <= F.size("words"))).withColumn("key", F.xxhash64(gram)), gram, mark


def _probe(words: DataFrame, windows: DataFrame, lengths: list[int], marks: bool) -> DataFrame:
    """One row for each window of a document that is in ``windows`` and, if ``marks``, one for each document (one_row 1)."""
    at, gram, mark = _places(words, lengths)
    joined = at.join(F.broadcast(windows), (F.col("key") == F.col("gram_key")) & (gram == F.col("gram")), "left")
    hit, row = F.col("gram_key").isNotNull(), mark if marks else F.lit(False)
    return joined.where(hit | row).select("doc_id", "text_key", F.size("words").alias("n_words"), row.cast("bigint").alias("one_row"), F.when(hit, F.struct("pos", "len")).alias("span"), "items")


def _occurring(words: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """The windows whose hash occurs in the documents, written to the shared folder."""
    keys = _places(words, lengths)[0].select("key").distinct()
    return cut(windows.join(keys, F.col("gram_key") == F.col("key"), "left_semi"), gather=True)


def _covered(spans: Column) -> Column:
    """Words inside any of the spans (pos, len)."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto"))

    def add(a: Column, x: Column) -> Column:
        end = x["pos"] + x["len"]
        return F.struct((a["n"] + F.greatest(F.lit(0), end - F.greatest(a["upto"], x["pos"]))).cast("bigint").alias("n"), F.greatest(a["upto"], end).alias("upto"))

    return F.aggregate(F.array_sort(spans), start, add, lambda a: a["n"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_key, n_words, n_hit, n_items, items, spans, contaminated.

    ``spans`` lists the hit windows as (pos, len) in words; ``text_key`` is a hash of the text.
    Only hits and one row for each document are shuffled, whatever the size of the texts.
    Rows with the same id and text are judged together and counted.
    """
    windows = benchmark_windows(benchmark, n)
    lengths, blocks = _blocks(windows, broadcast_bytes)
    words = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))
    if blocks > 1:
        windows = _occurring(words, windows, lengths)
        blocks = _blocks(windows, broadcast_bytes)[1]
    parts = [windows] if blocks == 1 else [windows.where(F.pmod("gram_key", F.lit(blocks)) == i) for i in range(blocks)]
    rows = reduce(DataFrame.unionByName, (_probe(words, part, lengths, i == 0) for i, part in enumerate(parts)))
    merged = rows.groupBy("doc_id", "text_key").agg(
        F.max("n_words").cast("bigint").alias("n_words"),
        F.sum("one_row").cast("int").alias("rows"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    merged = merged.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return merged.select(
        "doc_id", "text_key", "n_words", _covered(F.col("spans")).alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", "spans", (F.size("spans") > 0).alias("contaminated")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, mode: str = "documents", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without contaminated documents (mode "documents") or without the words hit (mode "spans").

    Columns stay as they are, whatever else they hold; ``n_chars`` is not recounted.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode must be documents or spans, not {mode!r}")
    doc, text, spans = free_names(docs.columns, ["_hit_doc", "_hit_text", "_hit_spans"])
    hits = find_contamination(docs, benchmark, n, broadcast_bytes).where("contaminated").select(F.col("doc_id").alias(doc), F.col("text_key").alias(text), F.col("spans").alias(spans))
    hits = hits.dropDuplicates([doc, text])
    if mode == "documents":
        hits = cut(hits.drop(spans), gather=True)
        hits = F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits
    same = docs["doc_id"].eqNullSafe(hits[doc]) & (F.xxhash64(docs["text"]) == hits[text])
    if mode == "documents":
        return docs.join(hits, same, "left_anti")
    joined = docs.join(hits, same, "left")
    lead = F.regexp_extract(docs["text"], "^[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*", 0)
    pieces = F.regexp_extract_all(docs["text"], F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*"), F.lit(0))
    left = F.filter(pieces, lambda p, i: ~F.exists(F.col(spans), lambda s: (s["pos"] <= i) & (i < s["pos"] + s["len"])))
    cleaned = F.when(F.col(spans).isNull(), docs["text"]).otherwise(F.concat(lead, F.array_join(left, "")))
    return joined.select(*[cleaned.alias("text") if c == "text" else docs[c] for c in docs.columns])
