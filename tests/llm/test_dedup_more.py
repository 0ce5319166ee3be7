"""Near-duplicates: ids of other types, ids that repeat, weighted sets, large groups."""

from __future__ import annotations

import numpy as np
import pytest

from chromaloom.llm import dedup


def text(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{i}" for i in rng.integers(0, 10_000, n))


def test_different_texts_with_one_id_all_stay(spark):
    rows = [(1, text(1)), (1, text(2)), (1, text(2)), (2, text(1).upper()), (3, text(3)), (3, text(1)), (3, None), (3, ""), (None, text(1)), (4, text(4))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in dedup.deduplicate(docs).collect())
    assert got == sorted([(1, text(1)), (1, text(2)), (3, text(3)), (3, ""), (3, ""), (0, text(1)), (4, text(4))])
    # as documents, the ids that share a text are one class
    classes = {r["doc_id"]: r["class_id"] for r in dedup.near_duplicates(docs).collect()}
    assert classes == {1: 1, 2: 1, 3: 1, 4: 4}


@pytest.mark.parametrize("small", [1, 16])
def test_ids_may_be_strings(spark, monkeypatch, small):
    monkeypatch.setattr(dedup, "SMALL_BAND", small)
    base = text(5, 100).split()
    rows = [(f"id-{i:02d}", " ".join([*base[:i], "x", *base[i + 1 :]])) for i in range(12)] + [("z", text(6)), ("y", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumnRenamed("text", "_gone").selectExpr("doc_id", "_gone as text", "1 as _gone", "2 as _id")
    assert {r["doc_id"]: r["class_id"] for r in dedup.near_duplicates(docs).collect()} == {**{f"id-{i:02d}": "id-00" for i in range(12)}, "z": "z", "y": "y"}
    kept = dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == ["id-00", "y", "z"]


def test_large_groups_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(dedup, "SMALL_GROUP", 3)
    monkeypatch.setattr(dedup, "LARGE_GROUPS", 1 << 40)
    rows = [(i, text(i % 3 if i < 30 else i)) for i in range(40)]
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: (i % 3, 10) if i < 30 else (i, 1) for i in range(40)}


def test_families_around_a_center_are_not_paired_in_full(spark, monkeypatch):
    """Texts of a passage, one of four further ones and words of their own: alike below the threshold, but for one pair in each family."""
    words = (f"w{i}" for i in range(1_000_000))
    fresh = lambda n: [next(words) for _ in range(n)]
    common, rows = fresh(100), []
    for _ in range(4):
        family = fresh(40)
        rows += [common + family + fresh(25) for _ in range(80)]
        rows.append([*rows[-1][:-1], "other"])
    made, across = [], dedup._across
    monkeypatch.setattr(dedup, "_across", lambda *args: made.append(across(*args).count()) or across(*args))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in dedup.near_duplicates(docs).collect()}
    assert got == {i: i - 1 if i % 81 == 80 else i for i in range(len(rows))}
    assert made[0] <= len(rows)  # 3,861 when the order of the prefix was that of hashes


def test_what_centers_connect_is_not_searched_again(spark, monkeypatch):
    """A chain of texts, each like its neighbours only: one class by the links to centers, nothing left to search."""
    words = [f"w{i}" for i in range(400)]
    rows = [words[a : a + 100] for a in range(0, 300, 2)]
    monkeypatch.setattr(dedup, "SMALL_BAND", 1)
    left, around = [], dedup._around
    monkeypatch.setattr(dedup, "_around", lambda members, *args: left.append(members.count()) or around(members, *args))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id bigint, text string")
    assert {r["class_id"] for r in dedup.near_duplicates(docs).collect()} == {0}
    assert left == [0]  # 571 when a vertex hung from one center only


def test_weighted_sets_agree_like_their_similarity(spark):
    rng = np.random.default_rng(1)
    names = [f"e{i}" for i in range(60)]
    a, b = rng.gamma(1.0, 3.0, 60), rng.gamma(1.0, 3.0, 60)
    b[:40] = a[:40] * rng.uniform(0.7, 1.3, 40)
    hashes, _ = dedup.word_hashes([n.encode() for n in names])
    sig = dedup.weighted_signatures(np.concatenate([hashes, hashes, hashes[:3]]), np.concatenate([a, b, [0, 0, 0]]), np.array([60, 60, 3, 0]), 4000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03 and not sig[2:].any()
    # whole weights: the same as repeating the element
    sets = spark.createDataFrame([(1, names, a.tolist()), (2, names[::-1], a[::-1].tolist()), (3, None, None), (4, ["x"], [-1.0])], "id int, e array<string>, w array<double>")
    got = {r["id"]: r for r in dedup.sketch_sets(sets, "id", "e", "w").collect()}
    assert got[1]["signature"] == got[2]["signature"] and len(got[1]["bands"]) == dedup.BANDS and got[3]["bands"] is None and got[4]["signature"] is None


def test_nothing_is_left_behind(spark):
    import os

    from chromaloom.llm.common import shared_dir

    base = shared_dir(spark).removeprefix("file:")
    docs = spark.createDataFrame([(i, text(i % 5)) for i in range(20)], "doc_id bigint, text string")
    before = set(os.listdir(base))
    assert dedup.deduplicate(docs).count() == 5
    assert len(set(os.listdir(base)) - before) == 1
