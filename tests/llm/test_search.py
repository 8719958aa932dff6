"""Operators 11 to 13 against plain versions, on the given tables and on hard cases."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lexiforge.llm import decontam, lexsearch, whitening, words

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def drawn_text(rng, n, of="abAB9éñß .,-\n\x7f"):
    return "".join(rng.choice(of) for _ in range(n))


def test_words_are_those_of_the_pattern():
    rng = random.Random(3)
    texts = [drawn_text(rng, rng.randint(0, 80)) if rng.random() > 0.1 else None for _ in range(400)] + ["x" * 200_000, "", "a" * 40_000 + " b", "ends", "Starts"]
    column = pa.array(texts).slice(2)
    hashes, counts = words.hashed(column)
    want = [plain_words(t) for t in texts[2:]]
    assert counts.tolist() == [len(w) for w in want]
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip([w for ws in want for w in ws], hashes.tolist()))
    assert len(set(seen.values())) == len(seen)
    assert words.hashed(pa.array([], pa.string()))[1].tolist() == [] and words.hashed(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0]


def test_suffix_array_orders_all_suffixes():
    rng = np.random.default_rng(5)
    for kinds in (1, 3, 500):
        text = rng.integers(1, kinds + 1, 700).astype(np.uint64)
        order = decontam.suffix_array(text, 10)
        assert sorted(order.tolist()) == list(range(700))
        keys = [tuple(text[i : i + 10].tolist()) for i in order]
        assert keys == sorted(keys)


# 11 benchmark decontamination


def plain_hits(docs, items, window=10):
    """n_words, n_hit, n_items, sha256 of each document."""
    windows = {}
    for item_id, text in items:
        w = plain_words(text)
        k = min(window, len(w))
        for p in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[p : p + k]), set()).add(item_id)
    out = []
    for text in docs:
        w, hit, ids = plain_words(text), set(), set()
        for k in {len(t) for t in windows}:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in windows:
                    hit |= set(range(p, p + k))
                    ids |= windows[tuple(w[p : p + k])]
        ids = sorted(str(i) for i in ids if i is not None)
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("shard_words", [11, 40, 1 << 19])
def test_matches_in_shards_of_any_size(shard_words):
    rng = random.Random(7)
    text = lambda n, kinds: " ".join(rng.choice("abcdefghij"[:kinds]) for _ in range(n))
    items = [(i, text(rng.randint(0, 30), 2)) for i in range(6)] + [(7, "a " * 25), (8, "only four words here"), (None, text(14, 3))]
    docs = [text(rng.randint(0, 120), rng.choice([1, 2, 3])) for _ in range(30)] + [None, "", "x only four words here y", "a " * 200]
    suffixes = decontam.Suffixes([str(i) if i is not None else None for i, _ in items], [t for _, t in items], 0)
    hashes, counts = words.hashed(pa.array(docs))
    rows = decontam.matches_of(hashes, counts, suffixes, shard_words)
    hit = decontam._covered(counts, rows[:, 0], rows[:, 1], rows[:, 2])
    want = plain_hits(docs, items)
    assert hit.tolist() == [w[1] for w in want]
    ids = [sorted({suffixes.ids[i] for d, _, _, i, _ in rows if d == n} - {None}) for n in range(len(docs))]
    assert [len(i) for i in ids] == [w[2] for w in want]
    # Matches are verbatim and as long as can be.
    for d, start, length, item, item_start in rows.tolist():
        doc, own = plain_words(docs[d]), plain_words(items[item][1])
        assert doc[start : start + length] == own[item_start : item_start + length]
        assert len(own) < 10 or start == 0 or item_start == 0 or doc[start - 1] != own[item_start - 1]
        assert len(own) < 10 or start + length == len(doc) or item_start + length == len(own) or doc[start + length] != own[item_start + length]


ITEM = "One two three four five six seven eight nine ten eleven twelve"


@pytest.fixture(scope="module")
def hard_docs(spark):
    rows = [(1, None, 0, "a"), (2, "", 0, "b"), (3, f"before {ITEM.upper()} after", 0, "c"), (3, f"before {ITEM.upper()} after", 0, "c"), (None, ITEM.replace(" ", "--"), 0, "d"), (5, " ".join(ITEM.split()[:9]), 0, "e"), (6, "word " * 100_000 + ITEM, 0, "f"), (7, "short item", 0, None), (8, "été ßtraße " * 30, 0, "g")]
    return spark.createDataFrame(rows, "doc_id long, text string, N_Hit int, matches string")


@pytest.fixture(scope="module")
def hard_items(spark):
    return spark.createDataFrame([(1, ITEM), (10, ITEM + " thirteen"), (2, "Short-Item"), (2, "Short-Item"), (3, None), (4, " . "), (None, "word word")], "item_id long, text string")


def test_hard_documents(spark, hard_docs, hard_items):
    items = [(r.item_id, r.text) for r in hard_items.collect()]
    for size in (1 << 22, 60):  # a block of all items, or several
        rows = decontam.found(hard_docs, hard_items, ["doc_id", "text", "N_Hit"], block_bytes=size)
        assert sorted(rows.columns) == ["doc_id", "matches", "n_hit", "n_words", "text"]
        rows = rows.withColumn("ids", decontam.items_hit(rows.matches)).collect()
        for r, w in zip(rows, plain_hits([r.text for r in rows], items)):
            assert (r.n_words, r.n_hit, len(r.ids), hashlib.sha256(",".join(r.ids).encode()).hexdigest()) == w
        assert len(rows) == 9
    left = decontam.clean(hard_docs, hard_items)
    assert left.columns == hard_docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 5, 8]
    assert decontam.found(hard_docs.where("false"), hard_items).collect() == []
    assert {r.n_hit for r in decontam.found(hard_docs, hard_items.where("false")).collect()} == {0}


def test_op11(spark, sf):
    rows = decontam.op11_decontaminate(spark, sf).orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = plain_hits([d.text for d in docs], items)
    assert [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows] == [(d.doc_id, *w, w[1] > 0) for d, w in zip(docs, want)]
    assert any(w[1] for w in want)


# 12 ranked lexical search


def plain_search(docs, items, k=50):
    held = []
    for doc_id, text in docs:
        w = plain_words(text)
        if w:
            counts = {}
            for x in w:
                counts[x] = counts.get(x, 0) + 1
            held.append((doc_id, len(w), counts))
    total, df, out = sum(n for _, n, _ in held), {}, []
    for _, _, counts in held:
        for x in counts:
            df[x] = df.get(x, 0) + 1
    asked = {}
    for item_id, text in items:
        asked.setdefault(item_id, set()).update(plain_words(text))
    for item_id, terms in asked.items():
        rows = []
        for doc_id, n, counts in held:
            m = 50 + (50 * n * len(held)) // total
            score = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 20 * m)) for t in terms if t in counts)
            if score > 0:
                rows.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, row[3], -row[0]) for rank, row in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()], key=str)


def test_radix_order():
    keys = np.random.default_rng(1).integers(0, 1 << 45, 5000).astype(np.uint64)
    keys[100:200] = keys[0]
    assert lexsearch.radix_order(keys, 45).tolist() == np.argsort(keys, kind="stable").tolist()


@pytest.mark.parametrize("together", [1, 50, 1 << 21])
def test_search_hard_cases(spark, hard_docs, hard_items, together, monkeypatch):
    monkeypatch.setattr(lexsearch, "TOGETHER", together)
    docs = [(r.doc_id, r.text) for r in hard_docs.collect()]
    items = [(r.item_id, r.text) for r in hard_items.collect()]
    assert found(lexsearch.search(hard_docs, hard_items, k=3)) == plain_search(docs, items, 3)
    assert found(lexsearch.search(hard_docs, hard_items, block_bytes=40)) == plain_search(docs, items)
    assert lexsearch.search(hard_docs.where("false"), hard_items).collect() == []
    assert lexsearch.search(hard_docs, hard_items.where("false")).collect() == []


def test_ties_go_by_doc_id(spark):
    docs = spark.createDataFrame([(i % 40, "same words here") for i in range(120)] + [(None, "same words here"), (50, "others")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "same"), ("y", "Words, same!"), ("z", "nowhere")], "item_id string, text string")
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 7)
    assert found(lexsearch.search(docs.repartition(9), items, k=7)) == want


def test_op12(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert found(lexsearch.op12_search(spark, sf)) == plain_search(docs, items)


# 13 embedding whitening


def plain_whitening(rows, most=16):
    """vec_id, component, n, deviation, |whitened|, explained of each row; the sign of a component is free."""
    fine = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for length in sorted({len(x) for _, x in fine}):
        space = [(i, x) for i, x in fine if len(x) == length]
        fit = sorted({tuple(x) for _, x in space})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        away = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
        cov = away.T @ away / n
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1], vectors[:, ::-1]
        k = min(most, int((values > max(values[0], 0) * length * 1e-13).sum()))
        for i, x in space:
            dev = [n * c - s for c, s in zip(x, sums)]
            white = (np.array([d / n for d in dev]) @ vectors[:, :k]) / np.sqrt(values[:k])
            out += [(i, j + 1, n, sum(d * d for d in dev), abs(white[j]), values[j] / np.trace(cov)) for j in range(k)]
    return out


def same_whitening(df, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], round(r[4], 4))
    got = sorted([(r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in df.collect()], key=key)
    want = sorted(plain_whitening(rows), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    np.testing.assert_allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-6, atol=1e-7)
    assert all(r.identity_error <= 1e-4 for r in df.collect())


def test_whitening_hard_cases(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, j + 1) for j in range(5)]) for i in range(60)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (70, None), (71, []), (72, [1.0, None, 1.0, 1.0, 1.0]), (73, [float("nan")] + [0.0] * 4), (74, [float("inf")] + [0.0] * 4), (75, [0.0] * 5)]
    rows += [(80 + i, [float(i), 1.0, float(-i)]) for i in range(4)] + [(99, [1.0] * 7)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, Component string")
    same_whitening(whitening.whiten(df), rows)
    assert whitening.whiten(df.where("false")).collect() == []
    assert len(whitening.whiten(df.where("vec_id < 60"), most=2).collect()) == 122
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, -1e300]), (3, [5.0, 5.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {None}


def test_op13(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    df = whitening.op13_whitening(spark, sf)
    same_whitening(df, rows)
    assert df.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
