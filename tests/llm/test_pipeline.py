"""The pipeline: every stage against brute force, on its own input."""

from __future__ import annotations

import corpus_pipeline
from test_operators import brute_classes, brute_contamination, brute_measure, codec

from chromaloom.llm import secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, fixture_dir, tmp_path):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{fixture_dir}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "decontamination", "secret scans", "byte-level BPE"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, fixture_dir)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns[:5] == COLUMNS and (k == 4 or docs.columns == COLUMNS) and docs.count() == len(after)
        if k == 0:
            m = {d: brute_measure(t or "") for d, t in before.items()}
            assert set(after) == {d for d, (n, chars, symbols, lines, repeated) in m.items() if n >= 50 and 100 * repeated <= 50 * n and 100 * symbols <= 10 * n and 100 * lines <= 20 * n and 2 * n <= chars <= 20 * n}
        elif k == 1:
            assert set(after) == {d for d, c in brute_classes(list(before.items())).items() if c == d}
        elif k == 2:
            assert set(after) == {d for d, r in brute_contamination(list(before.items()), items).items() if not r[4]}
        elif k == 3:
            scan = secrets.scanner().scan
            assert after == {d: secrets.mask(t, scan(t)) for d, t in before.items()} and any("[SECRET]" in t for t in after.values())
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        else:
            c = codec()
            assert {r["doc_id"]: r["token_ids"] for r in docs.collect()} == {d: c.encode(t) for d, t in before.items()}
    whole = corpus_pipeline.run(spark, fixture_dir)
    assert {r["doc_id"] for r in whole.collect()} == set(after)


def test_empty_and_null_input(spark, fixture_dir):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("extra", __import__("pyspark").sql.functions.lit(1))
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, fixture_dir)
            assert "extra" in out.columns
            out.collect()
