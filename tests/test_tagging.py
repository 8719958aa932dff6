"""The chunk tagger, paragraph differences and definition pairs by site."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.functions import pages as P
from lexiforge.operators import alignment, chunker
from lexiforge.plans import tagging


def _made(n, seed):
    """Sentences whose capitalised words are chunks of at most two, so that a tag hangs on the one before it."""
    draw, rows = random.Random(seed), []
    for s in range(n):
        words, tags, run = [], [], 0
        for _ in range(draw.randint(1, 14)):
            capital = draw.random() < 0.6
            words.append(("Ab" if capital else "ab") + "".join(draw.choices("cdefgh", k=3)))
            run = (run % 2) + 1 if capital else 0
            tags.append("O" if not run else "B" if run == 1 else "I")
        rows.append((s, words, tags))
    return rows


def test_history_decides(spark):
    rows = spark.createDataFrame(_made(1500, 1), "s int, w array<string>, t array<string>")
    tagger = chunker.fit(rows, "w", "t", width=1 << 14)
    held = _made(200, 2)
    got = {r.s: r.t for r in spark.createDataFrame(held, "s int, w array<string>, t array<string>").select("s", tagger.tag(F.col("w")).alias("t")).collect()}
    right = sum(a == b for s, _, t in held for a, b in zip(t, got[s]))
    assert right / sum(len(t) for _, _, t in held) > 0.97


def test_decode_is_greedy_one_by_one():
    rng = np.random.default_rng(3)
    sizes = np.array([3, 0, 7, 1, 7])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    own, past = rng.normal(size=(18, 4)), rng.normal(size=(3, 5, 4))
    want = []
    for a, n in zip(starts, sizes):
        seen = [4, 4, 4]
        for i in range(n):
            tag = int(np.argmax(own[a + i] + sum(past[d][seen[-1 - d]] for d in range(3))))
            want.append(tag)
            seen.append(tag)
    assert chunker.decode(own, starts, sizes, past).tolist() == want


def test_tagger_edges(spark):
    schema = "w array<string>, t array<string>, c array<string>"
    none = chunker.fit(spark.createDataFrame([], schema), "w", "t", width=64)
    rows = spark.createDataFrame([(["a", None], ["B", "O"], ["X"]), ([], [], None), (None, None, None), (["x"], ["O", "O"], None), (["b", "a"], ["O", "B"], ["Y", None])], schema)
    assert [r[0] for r in rows.select(none.tag(F.col("w"))).collect()] == [["O", "O"], [], None, ["O"], ["O", "O"]]
    tagger = chunker.fit(rows, "w", "t", classes="c", width=256)
    assert tagger.tags == ["B", "O"]
    got = [r[0] for r in rows.select(tagger.tag(F.col("w"), F.col("c"))).collect()]
    assert got == [["B", "O"], [], None, got[3], ["O", "B"]] and len(got[3]) == 1
    with pytest.raises(ValueError):
        chunker.fit(spark.createDataFrame([(["a"] * 101, [str(i) for i in range(101)], None)], schema), "w", "t", width=64)


def test_all_sentences_teach(spark, monkeypatch):
    """What only one of many sentences shows is learnt; no sentence is left out by a draw. Its parts are several."""
    plain = [(f"w{i}", ["a", f"w{i}", "b"], ["O", "O", "O"]) for i in range(24_000)]
    rows = spark.createDataFrame(plain + [(f"r{i}", [f"q{i}", "q", "q"], ["B", "I", "I"]) for i in range(4)], "s string, w array<string>, t array<string>")
    monkeypatch.setattr(chunker, "SHARE", 24_000, raising=False)
    seen, own = spark.sparkContext.accumulator(0), chunker._own
    monkeypatch.setattr(chunker, "_own", lambda words, *a: (seen.add(len(words)), own(words, *a))[1])
    tagger = chunker.fit(rows, "w", "t", width=1 << 12, rounds=1)
    assert seen.value == 24_004 and tagger.tags == ["B", "I", "O"]


def test_taught_chunks(spark, sf):
    score = tagging.chunk_tagger_scores(spark, sf).first()
    assert score.f1 > 0.9
    rows = tagging.chunk_tags(spark, sf)
    held = tagging._sentences(spark, sf).where("crc32(cast(doc_id as string)) % 5 = 0")
    assert rows.count() == held.count()
    own = tagging._sentences(spark, sf).where("sent_no = 0").limit(50).collect()
    for r in own:
        left, want = 0, []
        for w in r["words"]:
            left, tag = (left - 1, "I") if left else (2, "B") if w.lower() in tagging._HEADS else (0, "O")
            want.append(tag)
        assert r["tags"] == want


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row
        row = [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
    return row[-1]


def test_common_is_longest():
    draw = random.Random(5)
    for _ in range(300):
        a, b = ([draw.randint(0, 5) for _ in range(draw.randint(0, 25))] for _ in "ab")
        got = alignment.common(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))
        assert len(got) == _lcs(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        rows = alignment.aligned(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))
        assert [i for i, _ in rows if i is not None] == list(range(len(a)))
        assert [j for _, j in rows if j is not None] == list(range(len(b)))
    long = np.arange(30_000) % 7_000
    assert len(alignment.common(long, long[::3])) == 10_000


def test_paragraph_diff(spark):
    left = spark.createDataFrame([("d", 0, "a"), ("d", 1, "b"), ("d", 2, None), ("d", 9, "c"), ("e", 0, "x"), (None, 0, "n")], "k string, i int, p string")
    right = spark.createDataFrame([("d", 4, "a"), ("d", 5, "B"), ("d", 6, None), ("d", 7, "new"), ("d", 8, "c"), ("f", 0, "y"), (None, 0, "n")], "k string, i int, p string")
    got = {(r.k, r.left_at, r.right_at, r.op, r.left_text, r.right_text) for r in alignment.paragraph_diff(left, right, "k", "i", "p").collect()}
    assert got == {
        ("d", 0, 0, "same", "a", "a"), ("d", 1, 1, "changed", "b", "B"), ("d", 2, 2, "same", None, None), ("d", None, 3, "new", None, "new"), ("d", 3, 4, "same", "c", "c"),
        ("e", 0, None, "gone", "x", None), ("f", None, 0, "new", None, "y"), (None, 0, 0, "same", "n", "n"),
    }
    assert alignment.paragraph_diff(left.limit(0), right.limit(0), "k", "i", "p").count() == 0


def test_diff_agrees_with_a_plain_one(spark, sf):
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null and length(text) < 3000").limit(20).collect()]
    pairs = [(i, x.text.split("\n"), y.text.split("\n")) for i, (x, y) in enumerate(zip(docs, docs[1:]))]
    table = lambda side: spark.createDataFrame([(p[0], i, t) for p in pairs for i, t in enumerate(p[side])], "k int, i int, p string")
    got = {r.k: r.n for r in alignment.paragraph_diff(table(1), table(2), "k", "i", "p").groupBy("k").agg(F.count_if(F.col("op") == "same").alias("n")).collect()}
    for k, a, b in pairs:
        assert got[k] == _lcs(a, b) >= sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_site_pairs(spark):
    wiki, sub, stacks = "https://en.wikipedia.org/wiki/X", "https://groupprops.subwiki.org/wiki/X", "https://stacks.math.columbia.edu/tag/0"
    head = '<h1 id="firstHeading">Simple <i>Group</i> (mathematics)</h1>'
    rows = [
        ("1", wiki, head + '<p>A simple group is no definition.</p><h2><span id="DEFINITIONS">d</span></h2><div><p>A <b>simple group</b> is <p>next'),
        ("2", sub, head + '<span id="Definition"></span><p>Another thing'),
        ("3", wiki, head + '<p>A simple group'),
        ("4", wiki, '<span id="Definition"></span><p>text'),
        ("5", wiki, head + '<span id="Definition"></span>no paragraph'),
        ("6", stacks, '<h2 class="a tex-section"><span>54.9</span> Presheaves</h2><p>x</p><div class="env-definition"><p>Presheaves of sets</p></div>'),
        ("7", "https://example.org/wikipedia", head), ("8", None, head), ("9", wiki, None), ("10", wiki, ""),
    ]
    got = {r.addr: (r.title, r.definition, r.status) for r in P.site_pairs(spark.createDataFrame(rows, "addr string, url string, raw string")).collect()}
    assert got == {
        "1": ("simple group", "A simple group is ", "pair"), "2": ("simple group", "Another thing", "no match"), "3": ("simple group", None, "no definition"),
        "4": (None, None, "no title"), "5": ("simple group", None, "no paragraph"), "6": ("presheaves", "Presheaves of sets", "pair"),
        "7": (None, None, "no style"), "8": (None, None, "no style"), "9": (None, None, "empty"), "10": (None, None, "empty"),
    }
