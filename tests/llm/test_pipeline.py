"""The pipeline as a whole, stage by stage against plain versions, on a table with hard cases."""

import random

import pytest

from lexiforge.llm import langid, mixing, packing
from tests.llm.test_operators import plain_components, plain_fingerprint, plain_links, plain_normal

pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
GERMAN, ENGLISH = "der die das und ist nicht ein eine mit von auf für den dem haus hund katze garten".split(), "the a and is not with of on for house dog cat garden river over under this that".split()


def rows():
    rng = random.Random(6)
    made = []
    for i in range(120):
        words = GERMAN if i % 3 == 0 else ENGLISH
        lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(12, 30))) for _ in range(rng.randrange(1, 6))]
        made.append((i, "\n".join(lines), "de" if i % 3 == 0 else "en", f"s{i % 4}"))
    shared = "this line stands in many documents and is one that they all have from the same place"
    made += [(200 + i, f"{made[i][1]}\n{shared}", "en", "s1") for i in range(10)]
    made += [(300 + i, made[i][1], made[i][2], made[i][3]) for i in range(10)]
    made += [(300, made[130][1], "en", "s1")] * 2 + [(None, "a text without a number is kept here as the dog and the cat are", None, None), (401, None, "en", "s0"), (402, "", "en", "s0"), (403, "12 34 !!", None, "s0"), (404, "the dog " * 20000, "en", None)]
    return [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in made]


def key(r):
    return (r.doc_id is not None, r.doc_id or 0, r.text or "")


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    table = spark.createDataFrame(rows(), SCHEMA)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    docs, at = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        at[name] = docs.collect()
        if name != "pack":
            assert docs.columns == before.columns
    gone = {r.doc_id for r in table.collect()} - {r.doc_id for r in at["language"]}
    assert gone == {401, 402, 403} and len(at["language"]) == table.count() - 3
    # Lines: of each component the first place stays.
    kept = spark.read.parquet(f"{tmp_path}/language")
    group = plain_components(kept)
    first, want = {}, {}
    for i, text in sorted({key(r)[1:] if r.doc_id is not None else (-1, r.text) for r in at["language"]}):
        for n, line in enumerate(text.split("\n")):
            if plain_normal(line):
                first.setdefault(group[plain_normal(line)], (i, n))
    for r in at["language"]:
        i = -1 if r.doc_id is None else r.doc_id
        left = [x for n, x in enumerate(r.text.split("\n")) if not plain_normal(x) or first[group[plain_normal(x)]] == (i, n)]
        want[i, "\n".join(left)] = bool("".join(left).strip())
    got = {(-1 if r.doc_id is None else r.doc_id, r.text) for r in at["lines"]}
    assert got == {k for k, some in want.items() if some}
    assert all(r.n_chars == len(r.text) for r in at["lines"])
    # Near copies: one row of each group of fingerprints, the least.
    marks = [plain_fingerprint(r.text) for r in at["lines"]]
    root, least = plain_links(set(marks)), {}
    for r, mark in zip(at["lines"], marks):
        place = (r.doc_id is None, r.doc_id or 0)
        least[root[mark]] = min(least.get(root[mark], place), place)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in at["near"]) == sorted(least.values())
    # Mixing: every row as often as the operator says; targets are met.
    taken = {(r.doc_id, r.size): r.copies for r in mixing.mix(spark.read.parquet(f"{tmp_path}/near")).collect()}
    counts = {}
    for r in at["mix"]:
        counts[r.doc_id, len(r.text.split())] = counts.get((r.doc_id, len(r.text.split())), 0) + 1
    assert counts == {k: n for k, n in taken.items() if n}
    # Packing: sequences without gaps that hold every token.
    ends = {}
    for r in at["pack"]:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in ends.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0 and sum(spans[-1]) <= packing.LENGTH
    assert sum(r.piece == 0 for r in at["pack"]) == len(at["mix"])
    whole = pipeline.run(spark, str(tmp_path))
    strip = lambda found: sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in found)
    assert strip(whole.collect()) == strip(at["pack"])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    assert langid.train(spark.createDataFrame([], SCHEMA))[0] == []
