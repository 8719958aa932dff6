"""Each operator against a plain Python version, on a small table with hard cases."""

import hashlib
import io
import math
import random
import re
import wave
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexiforge.llm import common, hnsw, htmltext, langid, licenses, linededup, media, mixing, packing, pii, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, extra int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t) if t is not None else None, "x", 1) for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def hard(spark):
    word = "the quick brown fox jumps over the lazy dog near the old river bank"
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (None, word, None, "b"), (5, word, "en", "b"), (5, word, "en", "b"), (6, "x" * 150000, "de", None), (7, "été " * 30000, "fr", "c"), (8, word.upper(), "en", "c"), (9, "a", None, "a"), (10, "Mail a@b.co_x@y.org, 10.0.0.256 1.2.3.4 and 4111 1111 1111 1111; call +49 (30) 1234-5678.", "en", "a")]
    return table(spark, rows)


def empty(docs):
    return docs.where("false")


# 1 mixing


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            out.update(share)
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize("which", ["docs", "hard"])
def test_mixing(which, request):
    df = request.getfixturevalue(which)
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count()
    plain = df.select("source", "text").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in plain:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    targets = plain_targets(sizes)
    assert sorted(round(r.target, 6) for r in rows) == sorted(round(targets[r.source], 6) for r in plain)
    assert sorted(r["size"] for r in rows) == sorted(size(r.text) for r in plain)
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    if which == "docs":
        taken, want = sum(r.taken for r in rows), sum(targets.values())
        assert abs(taken - want) < 0.03 * want
    assert sorted(map(str, mixing.mix(df.repartition(5)).collect())) == sorted(map(str, rows))


def test_repeat(docs, hard):
    for df in (docs, hard):
        mixed = mixing.repeat(df)
        assert mixed.columns == df.columns
        assert mixed.count() == sum(r.copies for r in mixing.mix(df).collect())
    assert mixing.repeat(empty(hard)).count() == 0 and mixing.mix(empty(hard)).count() == 0


def test_fractional_cap(spark):
    """A cap of 1.5 is reached on average: copies are one or two."""
    rows = mixing.mix(table(spark, [(i, "word " * (i % 40 + 1), "en", "abc"[i % 3]) for i in range(1200)]), share=1.5, cap=1.5).collect()
    taken, want = sum(r.taken for r in rows), 1.5 * sum(r["size"] for r in rows)
    assert {r.copies for r in rows} == {1, 2} and abs(taken - want) < 0.03 * want


CLASHES = "_id int, _hash string, _row_hash string, _doc_key string, _key int, _drop int, _nth int, _t string, _text string, row string, t int, copies int, spans string, size int, doc_key int, kept int, c0 int"


def test_clashing_columns(spark):
    """No name of a user's column meets one of an operator's."""
    extra = (1, "a", "b", "c", 2, 3, 4, "d", "e", "f", 5, 6, "g", 7, 8, 9, 10)
    rows = [(1, "mail a@b.co now", "s", *extra), (2, "mail a@b.co now", "s", *extra), (3, None, None, *extra), (4, "other words are in this", "s", *extra)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, source string, {CLASHES}")
    assert {tuple(r) for r in mixing.repeat(df).collect()} <= set(rows)
    assert sorted(tuple(r) for r in simhash.deduplicate(df).collect()) == [rows[0], rows[2], rows[3]]
    assert sorted(tuple(r) for r in pii.redact(df).collect()) == [(i, t and t.replace("a@b.co", "<email>"), *more) for i, t, *more in rows]
    found = pii.find(df).collect()
    assert [r[:-1] for r in sorted(found, key=lambda r: r.doc_id)] == [tuple(v for k, v in zip(df.columns, r) if k != "spans") for r in rows]
    assert sorted(tuple(r)[: len(df.columns)] for r in langid.predict(df, ([], np.zeros((langid.COLUMNS, 0)))).collect()) == rows
    assert sorted(tuple(r)[: len(df.columns)] for r in media.media_columns(df, columns=["media_bytes"]).collect()) == rows
    pages = df.withColumnsRenamed({"text": "html"})
    assert sorted(tuple(r)[: len(df.columns)] for r in htmltext.extract(pages).collect()) == rows
    assert licenses.scan(df).count() == 0 and len(linededup.apply(df).columns) == len(df.columns)


# 2 licences


def plain_licenses(text, threshold=licenses.THRESHOLD):
    out = set()
    if not text:
        return out
    lines, paragraphs = text.split("\n"), re.split(r"\n[ \t\r]*\n", text)
    units = [("line", i, u) for i, u in enumerate(lines)]
    units += [("paragraph", i, u) for i, u in enumerate(paragraphs)] if 1 < len(paragraphs) < len(lines) else []
    units += [("text", 0, text)] if len(lines) > 1 else []
    for kind, i, unit in units:
        a = licenses.bigrams(unit)
        for name, texts in licenses.TEMPLATES.items():
            best = max((2 * len(a & b) / (len(a) + len(b)) for b in map(licenses.bigrams, texts)), default=0)
            if a and best >= threshold:
                out.add((kind, i, name, round(best, 9)))
    return out


def test_licenses(spark, docs, hard):
    apache = licenses.TEMPLATES["Apache-2.0"][1]
    more = table(spark, [(20, f"{apache}\n\nmore text here", None, None), (21, apache.replace(" ", "\n", 3), None, None), (22, "released under the the MIT license", None, None), (23, "Licensed under CC BY NC 4.0", None, None)])
    for df in (docs, hard, more):
        got = {(r.doc_id, r.unit, r.unit_no, r.license, round(r.score, 9)) for r in licenses.scan(df).collect()}
        assert got == {(r.doc_id, *x) for r in df.collect() for x in plain_licenses(r.text)}
    assert licenses.scan(empty(hard)).count() == 0


def test_notices_within_longer_texts(spark):
    """Notices of several lines or paragraphs before, after and between other lines."""
    gpl = licenses.TEMPLATES["GPL-3.0"][1].replace(" This program is distributed", "\n\nThis program is distributed").replace(" without even", "\nwithout even")
    gpl += "\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see the site of the foundation."
    bsd = licenses.TEMPLATES["BSD-2-Clause"][-1].replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. ").replace(" THIS SOFTWARE IS", "\n\nTHIS SOFTWARE IS")
    code = "\n".join(f"x{i} = f{i}(y{i}, z{i}) + {i}" for i in range(100))
    apache = licenses.TEMPLATES["Apache-2.0"][1].replace(" you may", "\nyou may").replace(" Unless", "\nUnless")
    rows = [f"{gpl}\n{code}", f"{bsd}\n{code}", bsd, f"{code}\n{apache}\n{code}", f"{code}\n{bsd}\n{code}\n{bsd}", code]
    got, best = {}, {}
    for r in licenses.scan(table(spark, [(i, t, None, None) for i, t in enumerate(rows)])).collect():
        got.setdefault(r.doc_id, set()).add((r.unit, r.unit_no, r.license))
        best[r.doc_id] = max(best.get(r.doc_id, (0, "")), (r.score, r.license))
    # The notices of the three GNU licences differ by a word or two: all match, the right one best.
    assert got[0] == {("lines", 0, n) for n in ("GPL-3.0", "LGPL-2.1", "AGPL-3.0")} and best[0][1] == "GPL-3.0"
    assert ("lines", 0, "BSD-2-Clause") in got[1] and ("text", 0, "BSD-2-Clause") in got[2]
    assert got[3] == {("line", 100, "Apache-2.0"), ("lines", 100, "Apache-2.0")}
    assert {("lines", 100, "BSD-2-Clause"), ("lines", 207, "BSD-2-Clause")} <= got[4] and 5 not in got


def test_licenses_keep_rows_apart(spark):
    mit = "Released under the MIT License."
    rows = table(spark, [(5, mit, None, None), (5, mit, None, None), (None, mit, None, None), (None, f"{mit}\nx", None, None)])
    got = sorted((str(r.doc_id), r.unit, r.unit_no, r.license) for r in licenses.scan(rows).collect())
    assert got == [("5", "line", 0, "MIT")] * 2 + [("None", "line", 0, "MIT")] * 2 + [("None", "text", 0, "MIT")] * (len(got) - 4)
    names = ["AGPL-3.0", "LGPL-2.1", "Unlicense", "EPL-2.0"]
    best = {}
    for r in licenses.scan(table(spark, [(i, licenses.TEMPLATES[n][0], None, None) for i, n in enumerate(names)])).collect():
        best[r.doc_id] = max(best.get(r.doc_id, (0, "")), (r.score, r.license))
    assert [best[i] for i in range(4)] == [(1.0, n) for n in names]


def test_telling_words():
    """No match can lack all telling words."""
    words = set(licenses.telling_words(licenses.TEMPLATES, 0.8))
    for texts in licenses.TEMPLATES.values():
        for grams in map(licenses.bigrams, texts):
            without = [g for g in grams if not words & set(g.split())]
            assert len(without) < 0.8 / 1.2 * len(grams)


# 3 line dedup


def plain_shingles(line):
    return {line[i : i + linededup.SPAN] for i in range(max(len(line) - linededup.SPAN, 0) + 1)}


def plain_normal(line):
    return re.sub(r"[\x20\x09-\x0D\xa0]+", " ", line.lower()).strip(" ")


def plain_components(df):
    lines = sorted({plain_normal(x) for r in df.collect() for x in (r.text or "").split("\n")} - {""})
    sets, root = [plain_shingles(x) for x in lines], list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        near = {}
        for x in s:
            for j in by[x]:
                if j < i:
                    near[j] = near.get(j, 0) + 1
        for j, n in near.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9:
                root[find(i)] = find(j)
    return {x: lines[find(i)] for i, x in enumerate(lines)}


def test_line_dedup(spark, docs, hard):
    base = "all the lines of this paragraph are nearly the same but for a word in it somewhere and they go on for so long that this one change is small, as what follows it has many other terms, each equal in every one of them"
    made = table(spark, [(i, "\n".join([base.replace("word", f"w{i}rd"), f"own line number {i} alone here", "", base]), "en", "s") for i in range(40)])
    for df in (docs, hard, made):
        plain = plain_components(df)
        first = {}
        rows = sorted({(r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.collect()})
        for i, text in rows:
            for n, line in enumerate(text.split("\n")):
                if plain_normal(line):
                    first.setdefault(plain[plain_normal(line)], (i, n))
        want = {(i, n) for i, text in rows for n, line in enumerate(text.split("\n")) if plain_normal(line) and first[plain[plain_normal(line)]] != (i, n)}
        got = {(r.doc_id if r.doc_id is not None else -1, r.line_no) for r in linededup.dropped_lines(df).collect()}
        assert len(want ^ got) <= 0.01 * len(want)
    left = {r.doc_id: r.text for r in linededup.apply(made).collect()}
    assert left[0] == base.replace("word", "w0rd") + "\nown line number 0 alone here\n" and len(left) == 40
    assert all(left[i] in (f"own line number {i} alone here\n", "") for i in range(1, 40))
    assert linededup.apply(made).columns == made.columns
    assert linededup.apply(empty(hard)).count() == 0


def test_short_lines_with_one_word_changed(spark):
    """Lines of 12 to 23 words, one of them replaced: what reaches 0.8 on runs of five characters is found."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 10)))
    runs = lambda x: {x[i : i + 5] for i in range(len(x) - 4)}
    rows, near = [], []
    for i in range(400):
        words = [word() for _ in range(rng.randrange(12, 24))]
        other = list(words)
        other[rng.randrange(len(words))] = word()
        a, b = " ".join(words), " ".join(other)
        rows += [(2 * i, a, "en", "s"), (2 * i + 1, b, "en", "s")]
        if len(runs(a) & runs(b)) >= 0.8 * len(runs(a) | runs(b)):
            near.append(2 * i + 1)
    got = {r.doc_id for r in linededup.dropped_lines(table(spark, rows)).collect()}
    assert len(near) > 150 and got <= set(near) and len(got) >= 0.98 * len(near)


def test_lines_without_blanks(spark):
    """Near copies in scripts that set no blanks: a character put in front, one changed in the middle."""
    rng = random.Random(8)
    rows = []
    for i in range(60):
        line = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(120))
        rows += [(3 * i, line, "zh", "s"), (3 * i + 1, "x" + line, "zh", "s"), (3 * i + 2, line[:60] + "y" + line[61:], "zh", "s")]
    got = {r.doc_id for r in linededup.dropped_lines(table(spark, rows)).collect()}
    assert got <= {i for i, *_ in rows if i % 3} and len(got) >= 118


def test_bucket_size_does_not_matter(spark):
    """Families of lines that share most of their text: written-out pairs and the prefix filter link the same lines."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(300)]
    rows = []
    for i in range(12):
        base = [rng.choice(words) for _ in range(40)]
        for j in range(25):
            line = list(base)
            for _ in range(rng.choice([1, 2, 6, 9])):
                line[rng.randrange(40)] = rng.choice(words)
            rows.append((100 * i + j, " ".join(line), "en", "s"))
    df = table(spark, rows)
    one, two = (sorted((r.doc_id, r.line_no, r.kept.doc_id) for r in linededup.dropped_lines(df, small=n).collect()) for n in (0, 1000))
    assert one == two and 100 < len(one) < 300


def test_lines_that_share_a_passage_make_few_pairs(spark, monkeypatch):
    """Lines that share a passage and some words: few of their pairs pass the prefix filter, and the near copies among them are found."""
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage, words = some(100).strip(), ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40)]
    lines = [f"{passage} {' '.join(rng.choice(words) for _ in range(6))}" for _ in range(300)]
    copies = [x + "." for x in lines[:20]]
    made, verified = [], linededup._verified
    monkeypatch.setattr(linededup, "_verified", lambda pairs, *a: (made.append(pairs.count()), verified(pairs, *a))[1])
    got = {r.doc_id for r in linededup.dropped_lines(table(spark, [(i, x, "en", "s") for i, x in enumerate(lines + copies)])).collect()}
    assert set(range(300, 320)) <= got
    assert made[-1] < 5000, made


def test_likely_pairs_that_parity_bits_rule_out_are_not_verified(spark, monkeypatch):
    """Families of lines at a coefficient of about 0.7, whose minima agree: few pairs need their texts, and near copies are found."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    rows = []
    for i in range(12):
        shared = " ".join(word() for _ in range(40))
        rows += [(100 * i + j, f"{shared} {' '.join(word() for _ in range(9))}", "en", "s") for j in range(25)]
        rows.append((100 * i + 50, rows[-1][1] + ".", "en", "s"))
    made, verified = [], linededup._verified
    monkeypatch.setattr(linededup, "_verified", lambda pairs, *a: (made.append(pairs.count()), verified(pairs, *a))[1])
    got = {r.doc_id for r in linededup.dropped_lines(table(spark, rows)).collect()}
    assert got == {100 * i + 50 for i in range(12)}
    assert sum(made) < 200, made


def test_lines_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a line of words\nand more", 7, "i", "k"), (2, "a line of words", 8, "j", "l"), (2, "a line of words", 8, "j", "l"), (None, None, 9, None, None)], "doc_id long, text string, _id int, drop string, `row` string")
    got = sorted(map(tuple, linededup.apply(df).collect()), key=str)
    assert got == [(1, "a line of words\nand more", 7, "i", "k"), (None, None, 9, None, None)]


# 4 neighbours


def test_nearest(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    nan = float("nan")
    odd = spark.createDataFrame([(100000, None, 0), (100100, [0.0] * 64, 0), (100200, [nan] * 64, 0), (100300, [None] + [1.0] * 63, 0), (100400, [1.0, 2.0], 0), (None, [1.0] * 64, 0), (100500, [], 0), (100600, [float("inf")] * 64, 0)], rows.schema)
    copies = rows.where("vec_id = 3").drop("vec_id").crossJoin(spark.range(200001, 200031).withColumnRenamed("id", "vec_id")).select(rows.columns)
    data = rows.union(odd).union(copies).union(rows.where("vec_id = 100"))
    got = hnsw.nearest(data, data.where("vec_id % 100 = 0"), 10).collect()
    points = {r.vec_id: np.array(r.embedding, float) for r in rows.union(copies).collect()}
    ids = np.array(sorted(points))
    x = np.array([points[i] for i in ids])
    hits = total = 0
    for q in [i for i in ids if i % 100 == 0]:
        d = np.sqrt(((x - points[q]) ** 2).sum(axis=1))
        want = [int(i) for _, i in sorted((a, i) for a, i in zip(d, ids) if i != q)[:10]]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
        assert all(math.isclose(m[2], np.sqrt(((points[m[1]] - points[q]) ** 2).sum()), rel_tol=1e-12) for m in mine)
        hits += len({m[1] for m in mine} & set(want))
        total += 10
    assert hits >= 0.95 * total
    assert {r.query_id for r in got} == {int(i) for i in ids if i % 100 == 0} | set()
    assert hnsw.nearest(rows.where("false"), rows.where("false")).count() == 0


def test_recall_in_shards():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 64))
    graph = hnsw.build(x)
    hits = sum(len({n for _, n in graph.search(q, 10, hnsw.EF_SEARCH)[:10]} & set(np.argsort(((x - q) ** 2).sum(axis=1))[:10].tolist())) for q in rng.normal(size=(50, 64)))
    assert hits >= 0.9 * 500


# 5 simhash


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_links(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for flip in [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i in range(64) for j in range(i))]:
            if a ^ flip in root:
                root[find(a)] = find(a ^ flip)
    return {f: find(f) for f in fps}


def test_simhash(docs, hard):
    for df in (docs, hard):
        rows = df.select("doc_id", "text").collect()
        fps = [plain_fingerprint(r.text) for r in rows]
        root = plain_links(set(fps))
        least = {}
        for r, f in zip(rows, fps):
            if r.doc_id is not None:
                least[root[f]] = min(least.get(root[f], 1 << 60), r.doc_id)
        got = simhash.groups(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
        assert sorted(map(str, got)) == sorted(str(r) for r in df.sparkSession.createDataFrame([(r.doc_id, f"{f:016x}", least.get(root[f])) for r, f in zip(rows, fps)], "doc_id long, f string, component_id long").toDF(*got[0].__fields__).collect())
    assert simhash.deduplicate(hard).columns == hard.columns
    assert simhash.groups(empty(hard)).count() == 0


def test_golay_keys_lose_no_pair(spark):
    table_ = simhash.golay_table()
    assert table_.min() == 0 and table_.max() == 4095 and (np.bincount(table_) == 2048).all()
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    dense = [base[0] ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]
    fps = list({*base, *dense, *(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    roots = {r.node: r.root for r in simhash.fingerprint_roots(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    plain = plain_links(set(fps))
    groups = {}
    for f, s in zip(fps, signed):
        groups.setdefault(plain[f], set()).add(roots.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({min(g) for g in groups.values()})


# 6 language


def test_langid(spark, docs, hard):
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.predict(docs.withColumn("held", langid.held_out()), model).where("held").collect()
    assert len(found) > 20 and sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(hard, model).collect()}
    assert odd[1] == odd[2] == odd[3] == ("und", 0.0) and odd[7][0] == "fr" and all(0 <= s <= 1 for _, s in odd.values())
    assert langid.predict(hard, model).columns == hard.columns + ["lang_pred", "score"]
    none = langid.train(empty(docs))
    assert {r.lang_pred for r in langid.predict(hard, none).collect()} == {"und"}
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.h for r in docs.select("doc_id", langid.held_out().alias("h")).collect())


def plain_grams(text):
    """Counts of hash columns of every n-gram of characters, one by one."""
    counts = {}
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    for n in langid.ORDERS:
        for i in range(len(points) - n + 1):
            column = int(langid.gram_columns(points[i : i + n])[n - 1][0])
            counts[column] = counts.get(column, 0) + 1
    return counts


def test_langid_against_plain(monkeypatch):
    monkeypatch.setattr(langid, "CHUNK", 50)
    texts = ["Ab été 汉字很多", "a", "xyz " * 40, "ñ"]
    rng = np.random.default_rng(1)
    logs = np.log(rng.random((langid.COLUMNS, 3))).astype(np.float32)
    sums, grams = langid.scores(texts, logs)
    for text, got, n in zip(texts, sums, grams):
        want = plain_grams(text)
        assert n == sum(want.values())
        assert np.allclose(got, sum(k * logs[c].astype(float) for c, k in want.items()), rtol=1e-5)
    assert langid.gram_columns(np.array([ord("汉")], np.uint32))[0].shape == (1,)


def test_langid_repeated_rows(spark):
    """A language made of one text a great many times is learnt, and so is a rare one beside it."""
    german = spark.range(60000).select(F.col("id").alias("doc_id"), F.lit("der Hund und die Katze sind auf dem Haus").alias("text"), F.lit("de").alias("lang"))
    english = spark.createDataFrame([(i, f"the dog and the cat number {i} are on the house", "en") for i in range(50)], "doc_id long, text string, lang string")
    same = spark.range(2000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("le chien et le chat sont sur la maison").alias("text"), F.lit("fr").alias("lang"))
    langs, logs = langid.train(german.union(english).union(same))
    assert langs == ["de", "en", "fr"]
    texts = ["und die Katze auf dem Haus", "the cat and the house", "et le chat sur la maison", None, "12"]
    assert langid.classify(texts, langs, logs)[0] == ["de", "en", "fr", "und", "und"]
    clash = spark.createDataFrame([(texts[0], "x", 1.0, 2)], "text string, lang_pred string, score double, t int")
    assert [tuple(r)[:3] for r in langid.predict(clash, (langs, logs)).collect()] == [(texts[0], 2, "de")]


# 7 pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home page of everything we have to say about the world</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this site better for all of our visitors and you agree to that.</div>
<article><header><h1>The   title &amp; more</h1></header><p>First <b>bold words that never end<p>Second paragraph that is long enough to be decided by
 the rules, with some &lt;markup&gt; &eacute; in it.</p>Short.<ul><li>item one</li></ul><form><p>Your name<input></p></form>
<aside>Read also this very long text about other things that we wrote in the past and that you may like a lot.</aside>
<div class="comments"><p>I think that this is the best article that I have read in a long time, thank you for it.</p></div>
<p>End.</p></article><footer>&copy; 2020 by the people who made it and all of their friends in the world of pages.</footer></body></html>"""


def test_main_text(spark):
    want = "The title & more\nFirst bold words that never end\nSecond paragraph that is long enough to be decided by the rules, with some <markup> é in it.\nShort.\nitem one\nEnd."
    assert htmltext.main_text(PAGE) == want
    plain = "<body><div id=menu><a href=1>one</a> <a href=2>two</a></div><div>" + "".join(f"<p>{'This is the text of the page and it has all the words that we need in it for sure. ' * 3}</p><p>Yes.</p>" for _ in range(3)) + "</div><div><a href=x>More of this</a></div>"
    assert htmltext.main_text(plain).count("Yes.") == 2 and "one" not in htmltext.main_text(plain) and "More" not in htmltext.main_text(plain)
    assert [htmltext.main_text(x) for x in (None, "", "<", "<!--", "<script>x", "<p", "a < b")] == ["", "", "", "", "", "", ""]
    rows = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.extract(rows).collect()}
    assert got == {1: (want, len(want)), 2: ("", 0)}
    assert len(htmltext.main_text("<article>" + "<p>word and more of it</p>" * 20000)) > 300000


def test_main_text_of_odd_markup():
    text = htmltext.main_text
    long = "This is the text of the page and it has all the words that we need in it for sure, as it goes on."
    assert text(f"<article><p title=it's>{long}</p><p>Don't go.</p></article>") == f"{long}\nDon't go."
    assert text(f'<article><p title="a > b" data-x=\'<p>\'>{long}</p></article>') == long
    for name in ("form", "select", "button", "map", "dialog"):
        assert text(f"<body><article><p>{long}</p><{name}><p>{long}</p><p>End.</p></article><footer>foot</footer></body>") == f"{long}\n{long}\nEnd."
        assert text(f"<body><article><p>{long}</p><{name}><p>{long}</p></{name}><p>End.</p></article></body>") == f"{long}\nEnd."
    assert text(f"<article><p>{long} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <svg><title>no</title></svg></p></article>") == f"{long} x=2 and"
    assert text(f"<article><p>{long} <span hidden>not <b>this</b></span>but this</p></article>") == f"{long} but this"
    assert text(f"<head><title>no</title></head><body><article><p>{long}</p><title>Named</title></article>") == f"{long}\nNamed"
    links = "<li><a href=x>Read more of what we have to say about the world</a></li>"
    # Within an article lists of links and a paragraph that is one link stay.
    read = "Read more of what we have to say about the world"
    assert text(f"<article><p>{long}</p><ul>{links}<li>See also</li>{links}</ul><p>{long}</p></article>") == f"{long}\n{read}\nSee also\n{read}\n{long}"
    assert text(f"<article><p>{long}</p><p><a href=x>The source of all this</a></p></article>") == f"{long}\nThe source of all this"
    assert text(f"<article><p>{long}</p><h2 class='header'>Results</h2><div id='side-effects'><p>None.</p></div><div class='share'><p>A share of it.</p></div></article>") == f"{long}\nResults\nNone.\nA share of it."
    # What readers wrote goes, as articles of their own too.
    assert text(f"<article><p>{long}</p></article><article class='reply-1'><p>{long}</p></article><div class='comments'><article><p>{long}</p></article></div>") == long
    assert text(f"<article><p>{long}</p><div class='notice'><p>{long}</p></div><div class='ad-box'><p>{long}</p></div></article>") == long
    # Running text of other languages, without an article tag.
    polish = "Rzeka płynie powoli przez dolinę, a ludzie siedzą wieczorem nad jej brzegiem i opowiadają sobie dawne historie o królach, rycerzach i zamkach. " * 2
    chinese = "河水慢慢地流过山谷，人们晚上坐在岸边，互相讲述古老的故事，关于国王、骑士和城堡的传说一直流传到今天，孩子们听得入神，久久不愿离去，直到月亮升起。" * 2
    for words in (polish.strip(), chinese):
        assert text(f"<body><div><a href=1>Menu</a> <a href=2>Dom</a></div><div><p>{words}</p><p>{words}</p></div><div><a href=x>{words[:90]}</a></div></body>") == f"{words}\n{words}"
    assert text(f"<article><h1>Title</h1><p>{long}</p><p>One.</p></article>") == f"Title\n{long}\nOne."
    assert text(f"<title>a<article><p>{long}</p></article>") in (long, f"a\n{long}")


def test_columns_that_differ_in_case_only(spark):
    rows = spark.createDataFrame([(1, "Mail a@b.org", "<p>x", 5, 6, 7, 8, 9)], "doc_id long, text string, html string, Spans int, N_Chars int, Score int, N_Bytes int, `odd ``name` int")
    for out, names in ((pii.find(rows), ["spans"]), (htmltext.extract(rows), ["text", "n_chars"]), (langid.predict(rows, (["en"], np.zeros((langid.COLUMNS, 1), np.float32))), ["lang_pred", "score"]), (media.media_columns(rows, columns=["n_bytes"]), ["n_bytes"])):
        low = [c.lower() for c in out.columns]
        assert len(set(low)) == len(low) and set(names) <= set(low) and "odd `name" in low
        assert out.count() == 1 and len(out.collect()) == 1


def test_only_the_largest_languages_are_learnt(spark):
    rows = spark.createDataFrame([(f"text number {i} of many words", lang) for lang, n in (("en", 9), ("de", 5), ("x1", 1), ("x2", 1)) for i in range(n)], "text string, lang string")
    assert langid.train(rows.withColumn("text", F.concat("lang", "text")), languages=3)[0] == ["de", "en", "x1"]


def test_recall_over_several_shards(spark):
    rows = hnsw.valid_vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    shards = hnsw.index(rows, 10, shard_rows=400)
    asked = rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    found = {}
    for r in hnsw.search(shards, asked, 10).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    x = {r.vec_id: np.array(r.x) for r in rows.collect()}
    hits = 0
    for q, ids in found.items():
        near = sorted((float(((v - x[q]) ** 2).sum()), i) for i, v in x.items() if i != q)[:10]
        hits += len(ids & {i for _, i in near})
    assert len(found) == 20 and hits >= 0.95 * 200


@pytest.mark.parametrize("page", ["<a " * 350000, "<a b=\"" * 200000, "<a b='>" * 150000, "<form>" * 150000 + "x", "<title>" * 150000, "</p>" * 250000, "<p>" * 300000, "<b>" * 200000 + "</i>" * 100000, "<" * 1000000, "<!--" * 250000, "<a =\"x\" " * 100000 + "=\">\"", "<div><p>" * 100000 + "</b>" * 50000])
def test_main_text_is_linear(page):
    import time

    began = time.process_time()
    htmltext.main_text(page)
    assert time.process_time() - began < 6


def plain_labels(blocks):
    """Both passes once more, each block on its own."""
    framed = any(b.inside and not b.frame for b in blocks)
    size = lambda t: len(t) + 2 * sum("\u2e80" <= c <= "\ud7ff" or "\uf900" <= c <= "\ufaff" or "\uff00" <= c <= "\uffef" for c in t)
    counted = lambda t: [w in htmltext.STOP_WORDS for w in re.findall(r"[^\W\d_]+", t.lower())]
    telling = [x for b in blocks if not b.frame and size(b.text) >= 70 and b.linked <= 0.2 * len(b.text) for x in [counted(b.text)]]
    known = not telling or sum(map(sum, telling)) >= 0.12 * max(1, sum(map(len, telling)))
    first = []
    for b in blocks:
        words = counted(b.text)
        stops = sum(words) / max(1, len(words))
        links, n = b.linked / len(b.text), size(b.text)
        if b.frame or links > 0.5 and not b.inside:
            first.append("bad")
        elif b.inside:
            first.append("good" if n >= 70 and (stops >= 0.12 or not known) and links <= 0.2 else "open")
        elif framed:
            first.append("bad" if n < 200 or links > 0.2 or known and stops < 0.12 else "open")
        elif n < 70:
            first.append("bad" if links > 0.2 else "open")
        elif known:
            first.append("good" if stops >= 0.3 and n > 200 else "open" if stops >= 0.12 else "bad")
        else:
            first.append("good" if links <= 0.2 and n > 200 else "open")
    out = []
    for i, b in enumerate(blocks):
        near = []
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(blocks) and blocks[j].inside == b.inside and (first[j] == "open" or blocks[j].frame):
                j += step
            beyond = not (0 <= j < len(blocks)) or blocks[j].inside != b.inside
            near.append(("good" if b.inside else "bad") if beyond else first[j])
        split = "good" if b.inside or size(b.text) >= 70 or b.heading else "bad"
        out.append(first[i] if first[i] != "open" else near[0] if near[0] == near[1] else split)
    return out


def test_both_passes_against_plain(spark, sf):
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rng = random.Random(2)
    stop, rare = sorted(htmltext.STOP_WORDS), [f"zx{i}" for i in range(50)]
    for _ in range(200):
        parts = []
        for _ in range(rng.randrange(2, 14)):
            words = " ".join(rng.choice(stop if rng.random() < rng.choice([0, 0.2, 0.5]) else rare) for _ in range(rng.choice([2, 8, 30, 80])))
            parts.append(rng.choice(["<p>{}</p>", "<p><a>{}</a></p>", "<h2>{}</h2>", "<nav>{}</nav>", "<p>{} <a>zx zx</a></p>"]).format(words))
        cut = rng.randrange(len(parts))
        parts[cut:cut] = rng.choice([[], ["<article>"], ["<div class=post>", "</div><main>"]])
        pages.append("".join(parts))
    for page in pages:
        blocks = htmltext.blocks_of(page)
        htmltext.classify(blocks)
        assert [b.label for b in blocks] == plain_labels(blocks)


def test_pages_keep_articles(spark, sf):
    import html as entities

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", " " if False else "", b.replace("<br>", "\n")))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        assert htmltext.main_text(r.html) == "\n".join(b for b in blocks if b)


# 8 packing


def test_packing(spark, docs, hard):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    odd = table(spark, [(30, "two  blanks\n\nand\tmore  ", None, None), (31, "it's 's ’quoted’ – dash   nbsp", None, None), (32, " lead\ntrail ", None, None), (33, "<|endoftext|> 汉字 и 123 ½ á", None, None), (34, "a\n b \nc", None, None)])
    for df in (docs, hard, odd):
        ids = {}
        for r in df.select("doc_id", "text").distinct().collect():
            ids[r.doc_id] = [*whole.encode(r.text or "", add_special_tokens=False).ids, 2]
        rows = packing.pack_documents(df).collect()
        places = {}
        for r in rows:
            part = ids[r.doc_id][r.start : r.start + r.length]
            assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            assert r.piece == 0 and r.start == 0 or r.length == 1024
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for spans in places.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 1024
        counts = {r.doc_id: r.n for r in df.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
        assert sum(r.length for r in rows) == sum(len(ids[i]) * n for i, n in counts.items())
    # A table this small ends before its sequences fill: what is left open counts.
    least = math.ceil(sum(r.length for r in packing.pack_documents(docs).collect()) / 1024)
    assert len({r.sequence_id for r in packing.pack_documents(docs).collect()}) <= 1.1 * least + 8
    assert packing.pack_documents(empty(hard)).count() == 0


def test_bins_best_fit():
    bins = packing.Bins(10, 2)
    assert [bins.place(s) for s in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert [bins.place(s) for s in (8, 7, 6)] == [(2, 0), (3, 0), (4, 0)]
    assert bins.place(2) == (3, 7)  # bin 2 was the fullest and has closed


def test_packing_is_dense(spark):
    """200,000 pieces as they come, in as many partitions as the operator takes."""
    pieces = spark.range(200000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.pmod(F.xxhash64("id"), F.lit(1024)) + 1).alias("length"), F.col("id").alias("ids_crc32"))
    packed = packing.pack(pieces)
    got = packed.agg(F.count_distinct("sequence_id").alias("n"), F.sum("length").alias("tokens"), F.count("*").alias("rows")).first()
    assert got["rows"] == 200000 and got.n <= 1.02 * got.tokens / 1024
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.where("n > 1024 or n <> end").count() == 0


# 9 media


def test_media(hard):
    rows = media.media_columns(hard).collect()
    texts = sorted((r.text or "" for r in hard.collect()))
    assert len(rows) == len(texts)
    seen = {}
    for r in rows:
        data = (r.text or "").encode()
        payload = data + b" " * ((-len(data)) % 192 if data else 192)
        with wave.open(io.BytesIO(bytes(r.media)), "rb") as w:
            assert w.readframes(w.getnframes()) == payload and w.getsampwidth() == 1
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(bytes(r.media)).hexdigest())
        assert len(r.fp_time) == len(r.fp_code) and r.fp_time == sorted(r.fp_time)
        assert seen.setdefault(r.text or "", r.feature) == r.feature
    assert len({f for t, f in seen.items() if len(t) > 600}) == len([t for t in seen if len(t) > 600])
    assert media.media_columns(empty(hard)).count() == 0


def test_media_finds_a_tone():
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * np.arange(8000) / 8000)).astype(np.uint8).tobytes()
    assert (media.peaks(tone)[:-1, 2] == 64).all()


# 10 personal data


def plain_base(text):
    text = text or ""
    out = []
    digits = lambda s: re.sub(r"[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(int(c) * (i % 2 + 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    for k, (kind, pattern, ok) in enumerate(rules):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if ok(m[0])]
    return sorted(out)


def test_pii(spark, docs, hard):
    random.seed(4)
    noise = ["".join(random.choice("a.@-1 2+4(0)5_%\n3é") for _ in range(400)) for _ in range(60)]
    cases = ["4111111111111111", "0004111111111111111", "1.2.3.4.5.6.7.8 001.002.003.004 1.2.3", "+1 (555) 123-4567. +123", "a@b a@b.c@d.e x..@-.- a@b.c_q@r.s", "IBAN GB82 WEST 1234 5698 7654 32 and DE00 1234", "ssn 123-45-6789 or 123-45-6789", "é" * 50 + "a@b.co", "+1" * 500, "9" * 5000, "a" * 50000 + "@"]
    made = table(spark, [(i, t, None, None) for i, t in enumerate(cases + noise)])
    for df in (docs, hard, made):
        rows = pii.find(df.drop("spans"), ["doc_id", "text"]).collect()
        for r in rows:
            base = [(s.start, s["rank"], s.kind, s.end) for s in r.spans if s["rank"] < 4]
            assert base == plain_base(r.text), r.text[:200]
    added = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s["rank"] > 3] for r in pii.find(made, ["doc_id"]).collect()}
    assert added[5] == [("iban", 5, 32)] and added[6][0] == ("ssn", 4, 15)
    assert pii.find(made).columns[-1] == "spans" and pii.find(empty(hard)).count() == 0
    clean = {r.doc_id: r.text for r in pii.redact(made).collect()}
    assert clean[7] == "é" * 49 + "<email>" or clean[7] == "é" * 50 + "<email>"
    assert pii.redact(made).columns == made.columns


def test_many_matches_in_one_text(spark):
    import time

    text = " ".join(f"u{i}@example{i % 7}.com" for i in range(20000))
    df = table(spark, [(1, text, None, None)]).drop("spans").cache()
    df.count()
    began = time.time()
    (row,) = pii.find(df, ["doc_id"]).collect()
    assert time.time() - began < 20 and [(s.start, s.end) for s in row.spans] == [m.span() for m in re.finditer(r"\S+", text)]


def test_ibans_in_running_text(spark):
    """Capitals and numbers that follow an account number are no part of it."""
    cases = ["IBAN GB29NWBK60161331926819 Barclays bank", "IBAN DE89370400440532013000 12 May", "DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "GB29NWBK60161331926819 BARCLAYS", "no number", "DE89370400440532013000 GB29NWBK60161331926819", "DE89370400440532013001 12 May", "DE893704004405320130001"]
    made = table(spark, [(i, t, None, None) for i, t in enumerate(cases)])
    got = {r.doc_id: [r.text[s.start : s.end] for s in r.spans if s.kind == "iban"] for r in pii.find(made.drop("spans"), ["doc_id", "text"]).collect()}
    assert got[0] == got[3] == ["GB29NWBK60161331926819"] and got[1] == ["DE89370400440532013000"]
    assert got[2] == ["DE89 3704 0044 0532 0130 00"] and got[6] == got[7] == []
    zz = next(f"ZZ{n:02}370400440532013000" for n in range(100) if (370400440532013000 * 10**6 + 353500 + n) % 97 == 1)
    assert got[4] == [] and got[5] == ["DE89370400440532013000", "GB29NWBK60161331926819"]
    own = table(spark, [(1, f"{zz} 12 May", None, None), (2, f"{zz} BANK", None, None)]).drop("spans")
    assert [[r.text[s.start : s.end] for s in r.spans if s.kind == "iban"] for r in pii.find(own, ["doc_id", "text"]).collect()] == [[zz], [zz]]
    assert {r.text for r in pii.redact(own).collect()} == {"<iban> 12 May", "<iban> BANK"}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "src long, dst long"), common.Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_a_save_leaves_no_shuffle_files(spark):
    """What a save shuffled goes when it has ended; halves hold every row once."""
    from lexiforge.llm.common import Scratch

    scratch = Scratch(spark, "halves")
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    rows = spark.range(-500, 500).selectExpr("id % 300 AS k", "id AS v").groupBy("k").agg(F.sum("v").alias("v"))
    for made in (scratch.save(rows, "a", by="k", halves="k"), scratch.save(rows, "b", halves="k"), scratch.save(rows, "c", by="k"), scratch.save(rows, "d")):
        assert sorted(map(tuple, made.collect())) == sorted(map(tuple, rows.collect()))
    held = tracker.shuffleStatuses().size()
    scratch.save(rows, "e", by="k", halves="k")
    assert tracker.shuffleStatuses().size() <= held
    scratch.drop()
