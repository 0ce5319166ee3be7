"""The corpus operators against brute force, and their defined cases."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaloom.llm import bpe, classlm, decontaminate, dedup, html_extract, langid, ordering, pii, quality, queries, secrets
from chromaloom.llm.queries import vocabulary

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def rows(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


# 1 -----------------------------------------------------------------------------------


def brute_contamination(docs, items, n=10):
    grams = defaultdict(set)
    for i, t in items:
        w = WORD.findall(fold(t))
        if i is not None and w:
            for s in range(max(1, len(w) - n + 1)):
                grams[tuple(w[s : s + n])].add(str(i))
    out = {}
    for d, t in docs:
        w, hit, names = WORD.findall(fold(t)), set(), set()
        for k in {len(g) for g in grams}:
            for s in range(len(w) - k + 1):
                if found := grams.get(tuple(w[s : s + k])):
                    hit |= set(range(s, s + k))
                    names |= found
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("limit", [1 << 26, 300])
def test_decontamination_equals_brute_force(spark, fixture_dir, limit):
    docs, items = spark.read.parquet(f"{fixture_dir}/documents.parquet"), spark.read.parquet(f"{fixture_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(docs, items, broadcast_bytes=limit)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["contaminated"]) for r in found.collect()}
    assert got == brute_contamination([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])


def test_decontamination_modes(documents, spark):
    docs = documents((1, "Keep THIS. a b c d e f g h i j!! and this"), (2, "clean"), (2, "clean"), (None, None)).withColumn("items", F.lit(1)).withColumn("_hit_spans", F.lit(2)).withColumn("_HIT_DOC", F.lit(3)).withColumn("pos", F.lit(4))
    items = spark.createDataFrame([(5, "A b c d e f g h i j")], "item_id bigint, text string")
    assert sorted((r["doc_id"] or 0) for r in decontaminate.decontaminate(docs, items).collect()) == [0, 2, 2]
    spans = decontaminate.decontaminate(docs, items, mode="spans")
    assert {r["text"] for r in spans.collect()} == {"Keep THIS. and this", "clean", None} and spans.columns == docs.columns
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == 4
    assert decontaminate.find_contamination(docs.limit(0), items).count() == 0


def test_decontamination_is_native(spark, fixture_dir):
    plan = queries.op1_decontaminate(spark, fixture_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 2 -----------------------------------------------------------------------------------


def brute_classes(docs, least=0.8):
    sets = {}
    for d, t in docs:
        w = WORD.findall(fold(t))
        if w:
            sets[d] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            same = sum((sets[a] & sets[b]).values())
            if same >= least * sum((sets[a] | sets[b]).values()):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in docs}


@pytest.mark.parametrize("small", [1, 16])
def test_near_duplicates_equal_brute_force(spark, documents, monkeypatch, small):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(500)]
    docs = []
    for family in range(2):
        base = [rng.choice(vocab) for _ in range(70 + 30 * family)]
        for _ in range(25):
            rate = rng.choice([0, 0.01, 0.03])
            w = [rng.choice(vocab) if rng.random() < rate else x for x in base]
            docs.append(" ".join(w[: rng.randrange(len(w) * 3 // 4, len(w) + 1)]))
    docs += ["short one", "Short, one!", "", "?!", "a a a a a a a a"]
    rng.shuffle(docs)
    docs = [(i * 2 + 1, t) for i, t in enumerate(docs)]
    monkeypatch.setattr(dedup, "SMALL_BAND", small)
    got = {d: r["class_id"] for d, r in rows(dedup.near_duplicates(documents(*docs))).items()}
    assert got == brute_classes(docs)


def test_signatures_agree_like_the_weighted_similarity():
    rng = np.random.default_rng(0)
    a = [f"w{i}" for i in rng.integers(0, 40, 300)]
    b = a[:230] + [f"v{i}" for i in rng.integers(0, 40, 70)]
    hashes, sizes = dedup.word_hashes([" ".join(a).encode(), " ".join(b).encode(), b""])
    sets, counts = dedup.shingles(hashes, sizes)
    sig = dedup.signatures(sets, counts, 2000)
    true = dedup.similarity(sets[: counts[0]], sets[counts[0] : counts[0] + counts[1]])
    assert abs((sig[0] == sig[1]).mean() - true) < 0.05 and not sig[2].any()


def test_deduplicate_keeps_one_of_each(documents):
    text = " ".join(f"x{i}" for i in range(30))
    docs = documents((5, text), (3, text.upper()), (3, text.upper()), (None, text), (7, None), (8, ""), (9, "other words here")).withColumn("class_id", F.lit(0))
    kept = dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 7, 8, 9]
    assert dedup.deduplicate(docs.limit(0)).count() == 0


# 3 -----------------------------------------------------------------------------------


def codec():
    path, pattern = vocabulary()
    return bpe.Codec(bpe.read_ranks(path), pattern)


def test_bpe_equals_the_reference_tokenizer():
    import tiktoken

    c = codec()
    ranks = {t: i for i, t in enumerate(c.tokens)}
    other = tiktoken.Encoding("own", pat_str=vocabulary()[1], mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(0)
    letters = "aeé \n\t\x1c\x85 　'stre12½²ñ漢字🙂\x00!.,ſK<|endoftext|>"
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        assert c.encode(s) == other.encode_ordinary(s) and c.decode(c.encode(s)) == s.encode()
    assert c.encode("z" * 20_000) == other.encode_ordinary("z" * 20_000)


def test_every_code_point_is_cut_alike():
    """Letters, numbers and spaces are those of the reference tokenizer's tables."""
    import tiktoken

    c = codec()
    other = tiktoken.Encoding("own", pat_str=vocabulary()[1], mergeable_ranks=c.whole, special_tokens={})
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    for a in range(0, len(points), 4096):
        text = "".join(f"a{chr(p)}1 " for p in points[a : a + 4096])
        assert c.encode(text) == other.encode_ordinary(text), hex(points[a])


def test_bpe_forgets_what_it_needs_not(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    c = codec()
    texts = ["one two three", None, "", "zqxj zqxk " * 3, "x" * 200, "one two"]
    want = [codec().encode(t) for t in texts]
    for part in (texts[:3], texts[3:5], texts[5:], texts):
        got = c.encode_batch(part)
        assert got == [want[texts.index(t)] for t in part]


def test_bpe_columns(documents):
    docs = documents((1, "Hello wörld"), (2, None), (3, ""), (3, "")).withColumn("n_tokens", F.lit("x"))
    out = bpe.with_tokens(docs, *vocabulary())
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
    got = [r for r in out.collect() if r["doc_id"] == 1][0]
    assert got["token_ids"] == codec().encode("Hello wörld") and got["decoded_sha256"] == hashlib.sha256("Hello wörld".encode()).hexdigest()
    assert {r["n_tokens"] for r in out.where("doc_id > 1").collect()} == {0}
    assert bpe.encode_documents(docs.limit(0), *vocabulary()).count() == 0


# 4 -----------------------------------------------------------------------------------


def brute_bits(train, text, order=langid.ORDER):
    low = lambda b: bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    tree = defaultdict(Counter)
    for t in train:
        t = b"\n" * order + low(t)
        for i in range(order, len(t)):
            for k in range(order + 1):
                tree[t[i - k : i]][t[i]] += 1
    bits, t = 0.0, b"\n" * order + low(text)
    for i in range(order, len(t)):
        for k in range(order, -1, -1):
            seen = tree.get(t[i - k : i])
            if seen:
                total = sum(seen.values()) + len(seen)
                if t[i] in seen:
                    bits -= math.log2(seen[t[i]] / total)
                    break
                bits -= math.log2(len(seen) / total)
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact(monkeypatch):
    train = {"aa": [b"the cat sat on the mat", b"THE hat"], "bb": ["der Hut saß auf".encode(), b"die Matte"]}
    model = langid.train(train, {"aa": 2, "bb": 2})
    for cells in (1 << 22, 14):
        monkeypatch.setattr(langid, "CELLS", cells)
        texts = [b"the hut", "Straße zq\x01".encode(), b"", b"x"]
        got = langid.Scorer(model).score(texts) - model.prior
        want = [[brute_bits(train[x], t) for x in ("aa", "bb")] for t in texts]
        assert np.allclose(got, want, rtol=1e-6)


def test_every_language_is_learned(spark, documents):
    # many languages; one that is mostly copies; one that is a single very long text
    letters = [chr(0x4E00 + 40 * i + j) for i in range(90) for j in range(40)]
    rng = random.Random(6)
    text = lambda i, n: "".join(rng.choice(letters[40 * i : 40 * i + 40]) for _ in range(n))
    docs = [(i, text(i, 60), f"l{i:02d}") for i in range(70)]
    copy = text(80, 500)
    docs += [(1000 + i, copy, "copies") for i in range(300)] + [(2000, text(81, 30_000), "long"), (2001, text(82, 50), None)]
    model = langid.fit(documents(*docs), sample_bytes=20_000)
    assert len(model.langs) == 72 and [len(b.langs) for b in model.blocks] == [64, 8]
    tests = [(i, text(i, 30), "x") for i in range(70)] + [(80, text(80, 30)), (81, text(81, 30))]
    got = rows(langid.predict(documents(*tests).withColumn("lang_pred", F.lit(1)).withColumn("_text", F.lit(2)), model, ["doc_id", "lang_pred", "_text"]))
    assert all(got[i]["lang_pred"] == f"l{i:02d}" for i in range(70)) and got[80]["lang_pred"] == "copies" and got[81]["lang_pred"] == "long"


def test_language_of_odd_texts(documents):
    docs = documents((1, "the cat and the hat " * 5, "en"), (2, "der hund und die katze " * 5, "de"), (3, None, "en"), (4, "123 !", "en"), (5, "and the cat", None), (6, "", "de"))
    got = rows(langid.predict(docs, langid.fit(docs), ["doc_id"]))
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["en", "de", "und", "und", "en", "und"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(docs.limit(0)), ["doc_id"]).collect()} == {"und"}


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.001"
    labels = rows(spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "lang"))
    got = [r for r in queries.op4_language_id(spark, base).collect() if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([labels[r["doc_id"]]["lang"] == r["lang_pred"] for r in got]) > 0.95


# 5 -----------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation(n):
    p = ordering.Permutation(n, 99)
    slots = p.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and (p.number(slots) == np.arange(n)).all()


def test_shards_hold_every_sequence(spark, documents, tmp_path):
    docs = documents(*((i, "é" * (i * 37 % 400)) for i in range(60)), (60, None), (-1, "minus one"), (7, "again"), (None, "no id"))
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    out = str(tmp_path / "shards")
    payload = F.encode("text", "UTF-8")
    result = ordering.materialise(docs, out, payload, 1, key=5, stride=128, range_bytes=4096).collect()
    layout = ordering.read_layout(out)
    found = defaultdict(list)
    for slot, who, part, ids in ordering.read(out):
        found[who].append((part, slot, bytes(ids)))
    assert sorted(r["slot"] for r in result) == list(range(layout.sequences))
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append((r["text"] or "").encode())
    for who, want in texts.items():
        if len(want) == 1:
            assert b"".join(x[2] for x in sorted(found[who])) == want[0]
    assert [x[0] for x in ordering.read(out, 11, 14)] == [11, 12, 13]
    assert all(r["offset"] == r["slot"] % layout.per_shard * 128 and r["shard"] == r["slot"] // layout.per_shard for r in result)
    again = ordering.materialise(docs, out, payload, 1, key=5, stride=128, range_bytes=4096).collect()
    assert {(r["slot"], r["crc32"]) for r in again} == {(r["slot"], r["crc32"]) for r in result}
    assert ordering.materialise(docs.limit(0), str(tmp_path / "none"), payload, 1).count() == 0


def test_shards_hold_token_ids(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(ordering, "LONG", 200)
    texts = {"a": "Hello wörld, 12 times. " * 3, "b": "longer " * 300, "c": None}
    docs = documents(*((i, t) for i, t in enumerate(texts.values()))).selectExpr("element_at(array('a', 'b', 'c'), int(doc_id + 1)) AS doc_id", "text", "1 AS payload", "2 AS id")
    ids, width = ordering.encoded(docs, *vocabulary())
    found = defaultdict(list)
    out = str(tmp_path / "ids")
    names = {r["id"] for r in ordering.materialise(ids, out, F.col("payload"), width, "id", stride=64).collect()}
    for _, who, part, got in ordering.read(out):
        found[who] += [(part, x) for x in got.tolist()]
    c = codec()
    hashes = {r["h"]: r["doc_id"] for r in docs.selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    assert names == set(hashes) and width == 2
    for h, name in hashes.items():
        assert [x for _, x in sorted(found[h], key=lambda p: p[0])] == c.encode(texts[name])


# 6 -----------------------------------------------------------------------------------


def test_exchange_separates_two_languages():
    rng = np.random.default_rng(0)
    m, n = 21, np.zeros((21, 22), np.int64)
    of = np.array([0] + [1] * 10 + [2] * 10)
    for _ in range(4000):
        a = rng.integers(1, m)
        b = rng.choice(np.flatnonzero(of == of[a]))
        n[a, b] += 1
    classes = classlm.exchange(n, 2)
    assert classes[0] == 2 and len(set(classes[1:11])) == 1 and len(set(classes[11:])) == 1 and classes[1] != classes[11]


def test_class_model(spark, documents):
    rng = random.Random(1)
    langs = [[f"{c}{i}" for i in range(20)] for c in "ab"]
    docs = documents(*((i, " ".join(rng.choice(langs[i % 2]) for _ in range(30))) for i in range(60)), (60, None), (61, "a1 NEW a2"), (62, "")).withColumn("held", F.col("doc_id") >= 50)
    model, counts = classlm.fit(docs.where("NOT held"), clustered=20, classes=4, frequent=25)
    got = rows(classlm.score(docs, model, counts, ["doc_id"]))
    c = Counter()
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b"\n"] for r in docs.collect()}
    for i, t in texts.items():
        if i < 50:
            c.update(t)
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert got[i]["base_score"] == pytest.approx(base) and got[i]["n_tokens"] == len(t) and got[i]["n_known"] == sum(c[w] > 0 for w in t) and got[i]["train_tokens"] == n
    assert sum(got[i]["score"] for i in range(50, 60)) > sum(got[i]["base_score"] for i in range(50, 60)) + 20
    # probabilities of all words from one state sum to one, with the unknown word counted once
    k = model.open
    words = [w for w in c if model.id.get(w) is None or model.klass[model.id[w]] == k]
    emission = sum((c[w] + 0.1) / (model.open_tokens + 0.1 * (model.open_words + 1)) for w in words) + 0.1 / (model.open_tokens + 0.1 * (model.open_words + 1))
    assert emission == pytest.approx(1) and np.allclose((10**model.transition).sum(1), 1)
    empty, none = classlm.fit(docs.limit(0))
    assert all(r["n_known"] == 0 and r["base_score"] == pytest.approx(0) for r in classlm.score(docs, empty, none, ["doc_id"]).collect())


def plain_likelihood(n, of):
    """Sum over class bigrams of n log n, less those of rows and columns."""
    size = max(of) + 2
    c = np.zeros((size, size))
    to = [*of, size - 1]
    for (a, b), v in np.ndenumerate(n):
        c[to[a], to[b]] += v
    f = lambda x: sum(v * math.log(v) for v in np.ravel(x) if v > 0)
    return f(c) - f(c.sum(0)) - f(c.sum(1))


def test_exchange_ends_where_no_single_move_gains():
    rng = np.random.default_rng(5)
    n = rng.poisson(0.7, (13, 13))
    of = classlm.exchange(n, 3, 100).tolist()
    best = plain_likelihood(n, of)
    for w in range(1, 12):
        for c in range(3):
            # totals of the fixed last class are the same before and after
            assert plain_likelihood(n, [*of[:w], c, *of[w + 1 :]]) <= best + 1e-6


def test_many_words_of_equal_count(documents):
    docs = documents((1, "a b c d e"), (2, "a b c d e f"))
    model, counts = classlm.fit(docs, frequent=3, few=0)
    assert (model.tokens, model.words) == (13, 7) and len(set(r["class"] for r in counts.collect())) > 2
    got = rows(classlm.score(docs, model, counts, ["doc_id"]))
    for i, t in ((1, "abcde"), (2, "abcdef")):
        c = Counter("abcdeabcdef")
        c["\n"] = 2
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (13 + 0.1 * 8)) for w in [*t, "\n"])) and got[i]["n_known"] == len(t) + 1
    # what is kept may bear any name; an empty table has no scores
    odd = docs.withColumn("score", F.lit("x")).withColumn("word", F.lit(1))
    assert classlm.score(odd, model, counts, ["doc_id", "word"]).columns[:2] == ["doc_id", "word"]
    assert classlm.score(docs.limit(0), model, counts, ["doc_id"]).count() == 0


@pytest.mark.parametrize("few", [0, 10_000])
def test_words_outside_the_core_have_classes(spark, documents, few):
    rng = random.Random(2)
    # x and y words alternate; two of each are frequent, the others are rare
    kinds = [[f"{c}{i}" for i in range(40)] for c in "xy"]
    pick = lambda k: kinds[k][rng.randrange(2) if rng.random() < 0.5 else rng.randrange(2, 40)]
    docs = documents(*((i, " ".join(pick(j % 2) for j in range(40))) for i in range(60)), (60, "x5 once y7"), (61, "x30 y31 x32 y33"), (62, "x30 x31 x32 x33"))
    model, counts = classlm.fit(docs.where("doc_id <= 60"), clustered=4, classes=2, frequent=10, few=few)
    table = {bytes(r["word"]).decode(): (r["n"], r["class"]) for r in counts.collect()}
    assert (len(model.id) == 82) if few else (len(model.id) <= 10)
    assert len({table[w][1] for w in kinds[0]}) == len({table[w][1] for w in kinds[1]}) == 1 and table["x9"][1] != table["y9"][1]
    assert table["once"] == (1, model.open) and [w for w, (_, g) in table.items() if g == model.open] == ["once"]
    got = rows(classlm.score(docs, model, counts, ["doc_id"]))
    mass, pairs = Counter(), Counter()
    texts = {r["doc_id"]: (r["text"] or "").lower().split() + ["\n"] for r in docs.collect()}
    of = lambda w: table[w][1]
    for i, t in texts.items():
        if i <= 60:
            mass.update(map(of, t))
            pairs.update(zip(map(of, ["\n", *t]), map(of, t)))
    n, size = sum(mass.values()), model.open + 1
    for i, t in texts.items():
        want = 0.0
        for a, b in zip(["\n", *t], t):
            row = sum(v for (s, _), v in pairs.items() if s == of(a))
            want += math.log10((pairs[of(a), of(b)] + 20 * (mass[of(b)] + 0.1) / (n + 0.1 * size)) / (row + 20))
            want += math.log10(1.1 / 1.2 if b == "once" else table[b][0] / mass[of(b)])
        assert got[i]["score"] == pytest.approx(want)
    assert got[61]["score"] > got[62]["score"] + 2  # the order of rare words counts


# 7 -----------------------------------------------------------------------------------

PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_pii(t):
    out = []
    for k, p in PII.items():
        for m in p.finditer(t):
            d = re.sub("[^0-9]", "", m[0])
            good = k == "email" or (k == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (k == "card" and 13 <= len(d) <= 19 and pii.luhn(d)) or (k == "phone" and 9 <= len(d) <= 15)
            if good:
                out.append((k, *m.span()))
    return sorted(out, key=lambda s: (pii.RANK[s[0]], s[1]))


def test_base_spans_equal_brute_force():
    rng = random.Random(3)
    bits = ["a", "@", "b.c", ".", "com", "+", " ", "-", "(", ")", "4111111111111111", "1", "23", "255", "256", "192.168.1.1", "é", "\n", "x.y", "5105 1051 0510 5100", "+1 (555) 555-1234", "%", "٣"]
    for _ in range(20_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(16)))
        assert sorted(pii.base_spans(t), key=lambda s: (pii.RANK[s[0]], s[1])) == brute_pii(t)
    assert pii.base_spans("9" * 6000 + ".1.1.1") == []


def test_weak_supervision_adds_spans(documents):
    docs = documents((1, "mail a.b@c.org now"), (2, "write to joe (at) host dot com please"), (3, None), (4, ""), (5, "call (555) 123-4567 today, +1 (212) 555-0100"), (6, "pages 12-34"))
    got = rows(pii.find_personal_data(docs))
    assert got[1]["spans"] == "email:5:14" and got[1]["n_email"] == 1
    assert got[2]["n_email"] == 0 and got[2]["spans"].startswith("email:9:") and got[2]["n_added"] == 1
    assert got[3]["spans"] == got[4]["spans"] == got[6]["spans"] == "" and got[5]["n_phone"] == 1
    assert got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_reliabilities_are_learned():
    p, table = pii.estimate(["email"] * 2, ["++++0", "0-0-0"], np.array([90.0, 10.0]))
    assert p[0] > 0.9 > 0.5 > p[1] and (table[1, :3] > table[0, :3]).all()


# 8 -----------------------------------------------------------------------------------


def brute_measure(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    repeated = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)


def test_measures_equal_brute_force():
    rng = random.Random(5)
    bits = ["a", "bé", " ", " ", "\n", "\t", "\x0b", " ", "#", "|", "<x>", "a b c ", "\n\n", "\x1c"]
    for _ in range(5000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(30)))
        assert quality.measure(t) == brute_measure(t)
    assert quality.measure(None) == (0, 0, 0, 0, 0)


def test_hosts(documents):
    good = " ".join(f"word{i}" for i in range(60))
    docs = documents(*((i, good + f" x{i}", "en", "fine") for i in range(20)), *((100 + i, "bad", "en", "junk") for i in range(40)), (200, good, "en", "junk"), (201, good, "en", None), (202, None, "en", "fine")).withColumn("n_words", F.lit("clash"))
    got = rows(quality.judge(docs.drop("n_words"), ["doc_id"]))
    assert got[0]["kept"] and got[201]["kept"] and not got[200]["kept"] and got[200]["host_rejected"] and not got[202]["kept"]
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {*range(20), 201}
    assert quality.judge(docs.drop("n_words").limit(0), ["doc_id"]).count() == 0


# 9 -----------------------------------------------------------------------------------


def test_secret_spans_equal_brute_force():
    base = {"assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    least = {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}
    rng = random.Random(2)
    bits = ["token", "TOKEN", "Secret", "api_key", "apikey", "passwd", "AKIA", "akia", "=", " = ", ":", '"', "abcdefgh12", "é", "ſecret", "K", " ", "\n", "0123456789abcdef", "a" * 33, "ABCDEFGHIJKLMNOP", "İ", "漢", "."]
    scan = secrets.scanner().scan
    for _ in range(10_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        want = sorted(((k, *m.span()) for k, p in base.items() for m in p.finditer(t) if least[k](m)), key=lambda s: (s[1], secrets.RANK[s[0]], s[2]))
        assert [s for s in scan(t) if s[0] in secrets.BASE] == want


def test_checksums_decide():
    body = "abcdefghijklmnopqrstuvwxyz0123"
    right = f"ghp_{body}{secrets._base62_crc(body)}"
    assert secrets.scanner().scan(f"x {right} y") == [("github", 2, 2 + len(right))]
    assert secrets.scanner().scan(f"x ghp_{body}000000 y") == []
    import base64

    part = lambda d: base64.urlsafe_b64encode(json.dumps(d, separators=(",", ":")).encode()).decode().rstrip("=")
    assert secrets.scanner().scan(f"{part({'alg': 'HS256'})}.{part({'sub': '1'})}.sig")[0][0] == "jwt"


def test_redaction(documents):
    docs = documents((1, 'é token = "abcdefgh12345" end'), (2, None), (3, "nothing")).withColumn("spans", F.lit(1))
    out = secrets.redact(docs)
    assert out.columns == docs.columns and {r["text"] for r in out.collect()} == {'é [SECRET]" end', None, "nothing"}
    got = rows(secrets.find_secrets(docs))
    assert got[1]["spans"] == "assign:2:24" and got[2]["spans"] == "" and secrets.find_secrets(docs.limit(0)).count() == 0


# 10 ----------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav>{before}<article><h1>Head &eacute;</h1><p>First, with <b>bold</b>
 text.<br>More<p>Second, <a href=x>link</a> &#x27;q&#39; &lt;tag&gt;.</p><script>var a="</p>";</script><aside>Side, bar, text.</aside><ul><li>One<li>Two</ul></article>{after}<footer>&copy; foot, note, end</footer>"""


@pytest.mark.parametrize("around", [("", ""), ("<div class='ad'>Buy, now, cheap, things, all of them, today.</div>", "<div id=comments><p>Great, post, really, well done, thanks a lot.</p></div><form><input>Send</form>"), ("<div class=\"cookie-notice\"><p>We use cookies, many, many, many of them, for, you.</p></div>", "<!-- gone <p>no</p> -->")])
def test_article(around):
    want = "Head é\n\nFirst, with bold text. More\n\nSecond, link 'q' <tag>.\n\nOne\n\nTwo"
    assert html_extract.main_text(PAGE.replace("{before}", around[0]).replace("{after}", around[1])) == want


def test_pages_without_marked_articles():
    text = "Long enough sentence, with commas, and words, so that it scores well. " * 3
    page = f"<body><div id=menu><a href=1>one</a><a href=2>two</a></div><div><div class=x><p>{text}</p></div><div class=x><p>{text}</p></div></div><div class=sidebar><p>{text}</p></div>"
    assert html_extract.main_text(page) == "\n\n".join([text.strip()] * 2)
    assert html_extract.main_text("just text") == "just text" and html_extract.main_text(None) == html_extract.main_text("<p></p>") == ""
    deep = "<div>" * 5000 + "<p>deep, text</p>"
    assert html_extract.main_text(deep) == "deep, text"


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é</p>"), (2, None, None), (2, None, None)], "page_id bigint, url string, html string").withColumn("text", F.lit(3))
    got = html_extract.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted((r["text"], r["n_chars"]) for r in got.collect()) == [("", 0), ("", 0), ("é", 1)]
    assert html_extract.extract(pages.limit(0)).count() == 0
