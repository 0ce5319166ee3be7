"""Helpers for the corpus operators' tests."""

from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table out of (doc_id, text) or longer rows."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def fixture_dir(spark, tmp_path_factory):
    """A small folder of tables, with the driver's layout."""
    import random

    random.seed(7)
    base = tmp_path_factory.mktemp("tables")
    words = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu", "ra", "te", "so") for b in ("n", "rt", "lin", "so", "ved", "ka", "po")]
    text = lambda n: " ".join(random.choice(words) for _ in range(n))
    items = [(i, text(14)) for i in range(6)] + [(6, "solo"), (None, text(12)), (8, None), (9, "!!")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(base / "benchmark.parquet"))
    docs = [(i, text(80)) for i in range(30)]
    docs += [(100, docs[0][1]), (101, docs[1][1] + " extra"), (102, None), (103, ""), (104, "one two"), (105, text(30) + " " + items[0][1] + " " + text(30)), (106, "hello " + " ".join(items[1][1].split()[2:13]) + " " + text(60)), (107, "A solo word. " + text(70))]
    docs += [(108, text(60) + ' token = "abcdefgh1234567890" ' + text(10)), (109, "### " * 60 + text(60)), (110, (text(4) + "\n") * 20)]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, DOCS).write.parquet(str(base / "documents.parquet"))
    return str(base)
