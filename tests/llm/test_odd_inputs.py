"""Nulls, repeated rows, very long and hostile texts, clashing columns; and that the learned parts decide."""

from __future__ import annotations

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaloom.llm import bpe, classlm, decontaminate, dedup, html_extract, langid, ordering, pii, quality, secrets
from chromaloom.llm.queries import vocabulary

GOOD = " ".join(f"word{i}" for i in range(60))


def rows(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple(map(str, t)))


OPERATORS = {
    "langid": lambda d: langid.predict(d, langid.fit(d), ["doc_id"]),
    "pii": pii.find_personal_data,
    "quality": lambda d: quality.judge(d, ["doc_id"]).drop("host_risk"),
    "secrets": secrets.find_secrets,
    "bpe": lambda d: bpe.encode_documents(d, *vocabulary()),
    "classlm": lambda d: classlm.score(d, *classlm.fit(d), ["doc_id"]),
    "decontaminate": lambda d: decontaminate.find_contamination(d, d.select(F.col("doc_id").alias("item_id"), "text").where("doc_id = 1")).drop("spans", "items"),
}

#: Names that operators use for their own columns, among the results and within.
CLASHES = ["n_words", "word_chars", "kept", "_host", "_bad_host", "_text", "_letters", "lang_pred", "score", "spans", "_hit_spans", "_hit_doc", "n_tokens", "_row", "__lm_row", "word", "n", "_id", "_v", "_gone", "class_id", "row", "text_key", "_candidates", "pos", "id", "payload"]


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_null_and_empty_rows(documents, name):
    run = OPERATORS[name]
    base = [(1, GOOD + " mail a@b.org token = abcdefgh1234", "en"), (2, "der Hund und die Katze " * 20, "de"), (3, None, None), (4, "", "en"), (None, "no id at all " * 20, "en")]
    once = documents(*base)
    twice = documents(*base, *base)
    got, want = rows(run(twice)), rows(run(once))
    if name not in ("langid", "classlm", "pii"):  # these learn from the rows, so numbers may move a little
        assert got == sorted([*want, *want], key=lambda t: tuple(map(str, t)))
    assert len(got) == 2 * len(want) == 10
    assert run(once.limit(0)).count() == 0


@pytest.mark.parametrize("name", [*OPERATORS, "quality_filter", "dedup", "redact", "with_tokens", "decontaminated", "spans"])
def test_columns_may_bear_any_name(documents, spark, name):
    items = spark.createDataFrame([(5, "zz yy xx")], "item_id bigint, text string")
    whole = {
        "quality_filter": quality.filter_documents,
        "dedup": dedup.deduplicate,
        "redact": secrets.redact,
        "with_tokens": lambda d: bpe.with_tokens(d, *vocabulary()),
        "decontaminated": lambda d: decontaminate.decontaminate(d, items),
        "spans": lambda d: decontaminate.decontaminate(d, items, mode="spans"),
    }
    docs = documents((1, GOOD), (1, GOOD), (2, GOOD + " zz yy xx"), (3, None)).withColumns({c: F.lit(7) for c in CLASHES})
    out = (OPERATORS | whole)[name](docs)
    assert out.count() >= 1
    if name in whole and name != "with_tokens":
        assert out.columns == docs.columns and {r["_gone"] for r in out.collect()} == {7}


def test_very_long_texts_are_linear():
    letters, digits, words = "a" * 1_000_000 + " dot x", "9" * 300_000 + " . 1", "alpha beta, " * 90_000
    jwt, ats = "eyJ" * 300_000, "a@b" * 100_000
    began = time.perf_counter()
    for text in (letters, digits, words, jwt, ats, "QUJD" * 250_000 + " (at) y", "1." * 200_000, "é" + "0123456789abcdef" * 60_000):
        pii.candidates(text)
        secrets.scanner().scan(text)
        quality.measure(text)
    assert time.perf_counter() - began < 60
    assert [s[0] for s in secrets.scanner().scan("é " + ("é" + "a" * 32) * 2000)] == ["hex"] * 2000
    assert secrets.scanner().scan("é" * 5 + "a" * 32 + "é" + "b" * 40) == [("hex", 5, 37), ("hex", 38, 78)]


def test_long_documents_through_every_operator(documents):
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    docs = documents((1, long, "en"), (2, long + " tail", "en"), (3, GOOD, "de"))
    for name, run in OPERATORS.items():
        assert run(docs).count() == 3, name
    assert dedup.deduplicate(docs).count() == 2


def test_learned_parts_decide_on_personal_data(documents, monkeypatch):
    """Replace the label model or the classifier by a constant and the added spans change."""
    docs = documents(*((i, f"mail me{i}@host{i}.org or joe{i} (at) host dot com, card 4111111111111111 5500005555555559") for i in range(20)), (30, "serial 4111111111111111 4012888888881881 9"))
    added = lambda: sum(r["n_added"] for r in pii.find_personal_data(docs).collect())
    whole = added()
    assert whole >= 40
    with monkeypatch.context() as m:
        m.setattr(pii, "estimate", lambda kinds, combos, counts, rounds=50: (np.zeros(len(combos)), None))
        assert added() == 0
    with monkeypatch.context() as m:
        m.setattr(pii, "train", lambda *a, **k: pii.Classifier({"": -20.0}))
        assert added() == 0
        assert all(r["n_doubtful"] == r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in pii.find_personal_data(docs).collect())


def test_adjoining_numbers_and_wide_addresses_are_added(documents):
    docs = documents((1, "pay 4111111111111111 5500005555555559 now"), (2, "an jürgen.müßig@mail.example.com schreiben"), (3, "at +1 (212) 555-0147 190.137.2.7"))
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    assert got[1]["n_card"] == 0 and got[1]["spans"] == "card:4:20,card:21:37"
    assert got[2]["n_email"] == 1 and got[2]["spans"].split(",")[0] == "email:3:32"
    assert got[3]["n_phone"] == 0 and "phone:3:20" in got[3]["spans"]


def test_the_prior_decides_on_hosts(documents, monkeypatch):
    """A small host's two failures are shrunk away, a large bad one is rejected; another prior, another verdict."""
    junk = "# " * 60 + GOOD
    docs = [(i, GOOD + f" x{i}", "en", f"good{i % 10}") for i in range(200)]
    docs += [(1000 + i, junk, "en", "bad") for i in range(30)] + [(1100 + i, GOOD + f" y{i}", "en", "bad") for i in range(20)]
    docs += [(2000 + i, junk, "en", "tiny") for i in range(2)] + [(2100, GOOD + " z", "en", "tiny")]
    verdicts = lambda: {r["source"]: r["host_rejected"] for r in quality.judge(documents(*docs), ["source"]).select("source", "host_rejected").distinct().collect()}
    got = verdicts()
    assert got.pop("bad") and not any(got.values())
    kept = {r["doc_id"] for r in quality.filter_documents(documents(*docs)).collect()}
    assert kept == {*range(200), 2100}
    with monkeypatch.context() as m:
        m.setattr(quality, "prior", lambda failed, docs, variance, noise: (0.05, 1000.0))
        assert not any(verdicts().values())
    with monkeypatch.context() as m:
        m.setattr(quality, "prior", lambda failed, docs, variance, noise: (0.9, 1000.0))
        assert all(verdicts().values())


def test_many_rejected_hosts_meet_in_two_ways(documents, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_HOSTS", 1)
    junk = "# " * 60 + GOOD
    docs = [(i, GOOD, "en", "good") for i in range(40)] + [(100 + 40 * h + i, junk if i else GOOD, "en", f"bad{h}") for h in range(3) for i in range(30)] + [(900, junk, "en", None), (901, GOOD, "en", None)]
    assert {r["doc_id"] for r in quality.filter_documents(documents(*docs)).collect()} == {*range(40), 901}
    assert {r["source"] for r in quality.judge(documents(*docs), ["source"]).where("host_rejected").collect()} == {"bad0", "bad1", "bad2"}


def test_intermediates_need_a_shared_folder(spark, monkeypatch):
    from chromaloom.llm import common
    from chromaloom.sources import shared

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    for module in (common, shared):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            module.shared_dir(Cluster)


def test_pages_of_every_kind(spark):
    pages = spark.createDataFrame([(1, "u", "<p>" + "x, " * 200_000), (2, None, None), (3, "u", "<" * 1000), (3, "u", "<" * 1000)], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["n_chars"] for r in html_extract.extract(pages).collect()}
    assert got[1] == 3 * 200_000 - 1 and got[2] == 0 and got[3] == 1000


def test_ids_of_any_kind_in_shards(documents, tmp_path):
    docs = documents((1, "a b"), (None, None)).selectExpr("cast(doc_id AS string) AS doc_id", "text", "7 AS range", "8 AS blob")
    ids, width = ordering.encoded(docs, *vocabulary())
    out = ordering.materialise(ids, str(tmp_path / "o"), F.col("payload"), width, "id").collect()
    assert len(out) == 2 and sum(r["id"] is None for r in out) == 1
    assert {i for _, i, _, _ in ordering.read(str(tmp_path / "o"))} == {None, *(r["id"] for r in out if r["id"] is not None)}


def test_digest_of_nothing(documents):
    assert pii.find_personal_data(documents((1, None))).first()["base_sha256"] == hashlib.sha256(b"").hexdigest()
