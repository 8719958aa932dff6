"""Operators and column functions on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.operators import graph, measures, ner, references, relational, sampling, sequences, stats, tfidf, vectors


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_text_functions(spark):
    assert one(spark, "An <br/>Example, of 3 Terms (see [1])", T.normalize_text) == "an example , of terms ( see )"
    assert one(spark, "Non-commutative  'ring'", T.normalize_phrase) == "non_commutative_ring"
    assert one(spark, "let $x^2$ be", T.remove_math) == "let _inline_math_ be"
    assert one(spark, 'a "field" and a "ring"', T.quoted_terms) == ["field", "ring"]
    assert one(spark, "intro\n== Formal definition ==\nA thing is.\n\n== Other ==\nx", T.definition_section) is None
    assert one(spark, "intro\n== Definition ==\nA thing is.\n\n== Other ==\nx\n\n=== definition===\nB", T.definition_section) == ["A thing is.", "B"]
    assert one(spark, r"\pmtitle{group}\pmdefines{a}\pmdefines{b}", T.metadata_map) == {"pmtitle": ["group"], "pmdefines": ["a", "b"]}
    assert one(spark, "http://arxiv.org/abs/1708.01234v2", T.article_id).number == "01234"
    assert one(spark, "nothing here", T.article_id) is None
    assert one(spark, None, T.normalize_text) is None


def test_normal_form_of_all_documents(spark, sf):
    import re
    import unicodedata

    from lexiforge.plans import queries as Q

    assert one(spark, "Théorème, Größe – Ångström “Niño” Łódź ﬁeld", T.normalize_text) == "theoreme , grosse - angstrom nino lodz field"
    assert one(spark, "Übung_é", T.normalize_phrase) == "ubung_e"

    def plain(text):
        out = re.sub("[0-9]+", " ", re.sub(r"<br\s*/?>", " ", text)).replace("ß", "ss").replace("¿", "?").replace("¡", "!")
        out = "".join(c for c in unicodedata.normalize("NFKD", out) if not unicodedata.combining(c))
        for mark in ("``", *"'\"[]{}\\^"):
            out = out.replace(mark, "")
        for mark in "=*|~":
            out = out.replace(mark, " ")
        for mark in ".,;:()!?-/\n":
            out = out.replace(mark, f" {mark} ")
        return re.sub("[ \t]+", " ", out).lower().strip()

    texts = {r.doc_id: r.text for r in Q.read(spark, sf, "documents").collect()}
    got = {r.doc_id: r.text for r in Q.normalize_text_all(spark, sf).collect()}
    plain_letters = {i for i, t in texts.items() if t is not None and not set(re.sub(r"[\x00-\x7f]", "", t)) - set("äöüÄÖÜßéèêëàâçîïôùûñáíóúÉ¿¡")}
    assert set(got) == set(texts) and len(plain_letters) > len(texts) // 2
    assert any(not texts[i].isascii() for i in plain_letters) and all(got[i] == plain(texts[i]) for i in plain_letters)


def test_sequences(spark):
    rows = spark.createDataFrame([(1, i, w, f) for i, (w, f) in enumerate([("a", True), ("x", False), ("b", True), ("b", True)])], "g int, p int, w string, f boolean")
    tagged = sequences.bio_tags(rows, "g", "p", "f")
    assert [r.bio for r in tagged.orderBy("p").collect()] == ["B", "O", "B", "I"]
    assert {r.phrase for r in sequences.tag_runs(tagged, "g", "p", "w", "bio").collect()} == {"a", "b b"}
    words = spark.createDataFrame([(["of", "finite", "field", "ext", "field"], "Finite Field"), (None, None)], "t array<string>, n string")
    joined = sequences.join_phrases(words, "t", [("finite", "field"), ("finite", "field", "ext")])
    assert [r.joined for r in joined.collect()] == ["of finite_field_ext field", None]
    assert sequences.tag_title(words, "t", "n").first().tags == ["O", "B", "I", "O", "O"]
    with pytest.raises(ValueError):
        sequences.join_phrases(words, "t", [("one",)])
    assert sequences.merge_subtokens(["[CLS]", "ab", "##c", "d"], ["O", "B", "I", "O"]) == [("abc", "B"), ("d", "O")]


def test_every_pair_over_the_threshold_is_joined(spark, tmp_path):
    """300 pairs score over 100 here; each is joined, from the left."""
    from lexiforge.plans import queries as Q

    texts = [(i, " ".join([f"a{i} b{i}"] * 2 + ["x y z"[: 1 + 2 * (i % 3)]])) for i in range(300) for _ in range(4)] + [(900, None), (901, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.joined for r in Q.join_phrases(spark, str(tmp_path)).collect()}
    assert all(got[i].startswith(f"a{i}_b{i} a{i}_b{i}") for i in range(300)) and got[901] == "" and got[900] is None
    rows = spark.createDataFrame([(1, ["a", "b", "c", "d"])], "id int, t array<string>")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    assert sequences.join_pairs(rows, "id", "t", pairs).first().joined == "a_b c_d"


def test_measures(spark):
    rows = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 8)], "v double")
    assert [r.n for r in measures.equal_width_histogram(rows, "v", 4).orderBy("bin").collect()] == [3, 0, 0, 1]
    raters = spark.createDataFrame([(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15, "a int, b int")
    assert round(measures.kappa(raters, "a", "b").first().kappa, 6) == 0.4
    cut = measures.best_cutoff(spark.createDataFrame([(0.2, 0), (0.4, 0), (0.6, 1), (0.9, 1)], "s double, y int"), "s", "y").first()
    assert (cut.cutoff, cut.f1) == (40, 1.0)


def test_relational(spark):
    a = spark.createDataFrame([("x", 2), ("y", 1)], "term string, n int")
    b = spark.createDataFrame([("y", 3), ("z", 4)], "term string, n int")
    got = {r.term: (r.n_left, r.n_right, r.side) for r in relational.set_compare(a, b, "term").collect()}
    assert got == {"x": (2, 0, "left"), "y": (1, 3, "both"), "z": (0, 4, "right")}
    assert [r.term for r in relational.missing_from(a, b, "term").collect()] == ["x"]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    far = {(r.src, r.dst): r.dist for r in graph.distances(edges, 5).collect()}
    assert far[1, 4] == 3 and (4, 1) not in far
    assert [r.node for r in graph.sinks(edges).collect()] == [4] and graph.sources(edges).count() == 0
    assert [(r.src, r.dst) for r in graph.acyclic(edges).collect()] == [(3, 4)]
    terms = spark.createDataFrame([("ring", ["ring"]), ("finite field", ["finite", "field"])], "term string, words array<string>")
    defs = spark.createDataFrame([(1, ["a", "finite", "field", "is", "a", "ring"], ["finite field"])], "def_id int, words array<string>, defines array<string>")
    assert [tuple(r) for r in graph.containment_edges(terms, defs).collect()] == [("ring", "finite field")]


def test_samples(spark):
    rows = spark.range(1000).withColumn("g", F.col("id") % 3)
    parts = rows.select(sampling.split_label(F.col("id"), [("a", 0.8), ("b", 0.2)]).alias("p")).groupBy("p").count().collect()
    assert 750 < {r.p: r["count"] for r in parts}["a"] < 850
    assert sampling.sample_per_group(rows, "g", "id", 7).count() == 21 and sampling.sample_per_group(rows, "g", "id", 400).count() == 0


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_normal_form_in_full(spark):
    """Marks of the table, line ends and abbreviations."""
    case = "See fig. 3 of Dr.Smith's well-defined [x=y], i.e. a/b*c ``q''~«z»\nnext!"
    assert one(spark, case, T.normalize_text) == "see fig . of dr . smiths well - defined x y , i . e . a / b c q <<z>> \n next !"
    assert one(spark, case, lambda c: T.normalize_text(c, abbreviations=T.ABBREVIATIONS)) == "see fig. of dr . smiths well - defined x y , i.e. a / b c q <<z>> next !"
    assert one(spark, "well-defined <map>", T.normalize_phrase) == "well_defined_map"
    assert one(spark, "a.e.a.e. stays", lambda c: T.normalize_text(c, abbreviations=["a.e."])) == "stays"
    assert one(spark, "é naïve", lambda c: T.normalize_text(c, letters="drop")) == "nave"


def test_tagged_sentences(spark):
    pairs = lambda words, labels: F.array(*[F.struct(F.lit(w).alias("word"), F.lit(t).alias("label")) for w, t in zip(words, labels)])
    show = lambda c: [tuple(x) for x in spark.range(1).select(c.alias("x")).first().x]
    pieces = pairs(["[CLS]", "my", "na", "##me", "is", "##n't", "[SEP]"], ["O", "O", "B", "I", "I", "O", "O"])
    assert show(ner.merge_subtokens(pieces)) == [("my", "O"), ("name", "B"), ("isn't", "I")]
    assert show(ner.merge_marker(pairs(["a", "_", "inline", "_", "math", "_", "inline", "_", "math", "_"], ["O", "B"] + ["O"] * 8))) == [("a", "O"), ("_inline_math_", "B"), ("inline", "O"), ("_", "O"), ("math", "O"), ("_", "O")]
    assert show(ner.align(pairs(["na", "me", "x", "y"], ["O", "B", "I", "O"]), F.array(F.lit("name"), F.lit("xy")))) == [("name", "B"), ("xy", "I")]
    assert spark.range(1).select(ner.cropped_terms(pieces).alias("x")).first().x == ["name isn't"]
    assert spark.range(1).select(ner.runs(pairs("a b b c b b c".split(), "O B B O B I I".split())).alias("x")).first().x == ["b", "b b c"]
    words = F.array(*map(F.lit, "The banach Spaces and a Banach space".split()))
    assert "".join(spark.range(1).select(ner.title_tags(words, F.lit("Banach space")).alias("x")).first().x) == "OBIOOBI"
    assert "".join(spark.range(1).select(ner.title_tags(words, F.lit("Banach space"), True).alias("x")).first().x) == "OOOOOBI"
    assert spark.range(1).select(ner.title_tags(words, F.lit(" ")).alias("x")).first().x == ["O"] * 7
    empty = F.expr("cast(array() as array<struct<word:string,label:string>>)")
    assert show(ner.merge_subtokens(empty)) == show(ner.merge_marker(empty)) == show(ner.align(empty, F.array(F.lit("a")))) == []


def test_graphs_of_any_depth(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(9, 0), (20, 21), (21, 22), (20, 22), (5, 20)], "src long, dst long")
    assert {tuple(r) for r in graph.acyclic(edges).collect()} == {(20, 21), (21, 22), (20, 22), (5, 20)}
    assert {tuple(r) for r in graph.levels(graph.acyclic(edges)).collect()} == {(5, 0), (20, 1), (21, 2), (22, 3)}
    assert graph.closure(edges).where("src = 0").count() == 13


def test_offsets_and_spearman(spark):
    rows = spark.createDataFrame([(float(x), float(y)) for x, y in [(1, 2), (2, 1), (2, 3), (5, 9), (5, 9), (7, 4)]], "a double, b double")
    got = {(r.a, r.b): r.before_b for r in stats.offsets(rows.dropDuplicates(), "a", "b").where("a <> 2").collect()}
    assert got == {(1.0, 2.0): 0.0, (5.0, 9.0): 6.0, (7.0, 4.0): 15.0}
    import pandas as pd

    frame = pd.DataFrame([tuple(r) for r in rows.collect()], columns=["a", "b"]).rank()
    assert abs(stats.spearman(rows, "a", "b").first().spearman - frame["a"].corr(frame["b"])) < 1e-12
    same = spark.createDataFrame([(3.0,)] * 5, "a double")
    assert {r.before_n for r in stats.offsets(same.groupBy("a").agg(F.count("*").alias("n")), "a", "n").collect()} == {0}


def test_mode_needs_enough_rows(spark):
    rows = spark.createDataFrame([("a", i, "en" if i % 3 else "de") for i in range(10)] + [("b", i, "en") for i in range(8)], "g string, i int, v string")
    assert {tuple(r) for r in stats.mode_of_first(rows, "g", "i", "v", 5, 5).collect()} == {("a", "en"), ("b", None)}


def test_weights_broadcast_a_short_vocabulary(spark):
    """Counts of few terms are broadcast, however many uses there are, so these are not exchanged by term."""
    uses = spark.range(200_000).select((F.col("id") % 997).alias("d"), F.concat(F.lit("t"), F.col("id") % 50).alias("t"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        plan = tfidf.tfidf(uses, "d", "t")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_term_references(spark):
    glossary = spark.createDataFrame([("x", 1, 0), ("x", 2, 1), ("x", 2, 0), ("x", 3, 0), ("y", 1, 5)], "term string, addr long, p_index int")
    paragraphs = spark.createDataFrame([(1, 0, "p10"), (2, 0, "p20" * 10), (2, 1, "p21")], "addr long, p_index int, p_tag string")
    uses = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "z")], "addr long, term string")
    got = {(r.term, r.addr, r.p_index): (r.truid, r.p_tag, r.weight) for r in references.term_references(glossary, paragraphs, uses, most=20).collect()}
    assert got[("x", 2, 1)] == (2, "p21", 1.0) and ("x", 2, 0) not in got
    assert got[("x", 3, 0)] == (3, "", 0.0) and got[("y", 1, 5)][:2] == (0, "") and 0 < got[("y", 1, 5)][2] < 1
