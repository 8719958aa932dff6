"""HTML articles, sentences, stores and entity scores on small cases written by hand."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import pages, sentences
from lexiforge.operators import ner
from lexiforge.plans import files
from lexiforge.sources import stores


def shape(node):
    """tag(text children) and tails of a tree."""
    inner = (node.text or "").strip() + "".join(shape(c) + (c.tail or "").strip() for c in node)
    return f"{node.tag}({inner})"


TREES = [
    ("<p>one<p>two", "html(p(one)p(two))", "good"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "html(ul(li(a)li(bul(li(c)))li(d)))", "good"),
    ("<table><tr><td>1<td>2<tr><td>3</table>after", "html(table(tr(td(1)td(2))tr(td(3)))after)", "good"),
    ("<div><p>x<table><tr><td>y</td></tr></table>z</div>", "html(div(p(x)table(tr(td(y)))z))", "good"),
    ("<table>lost<tr><b>bold</b><td>in</td></tr></table>", "html(lostb(bold)table(tr(td(in))))", "recovered"),
    ("a</b>c", "html(ac)", "recovered"),
    ("<div><b>x</div>y", "html(div(b(x))y)", "recovered"),
    ("<b>open", "html(b(open))", "recovered"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "html(dl(dt(t)dd(d)dt(u)))", "good"),
    ("<p>a &lt;b&gt; &eacute;<br>c</p>", "html(p(a <b> ébr()c))", "good"),
    ("<!-- no --><p>x</p>", "html(p(x))", "good"),
    ("<select><option>1<option>2</select>", "html(select(option(1)option(2)))", "good"),
    ("<math><mi/><mo>+</mo></math>", "html(math(mi()mo(+)))", "good"),
    ("<td>cell</td>", "html(td(cell))", "good"),
]


@pytest.mark.parametrize("raw,want,status", TREES)
def test_trees(raw, want, status):
    root, got = pages.parse_html(raw)
    assert (shape(root), got) == (want, status)


def test_empty_and_odd_pages():
    for raw in (None, "", "  \n", "<!-- only -->"):
        assert pages.parse_html(raw) == (None, "empty")
    assert pages.parse_html("plain < text & more")[0].text == "plain < text & more"
    deep = pages.parse_html("<div>" * 400 + "x")
    assert deep[1] == "recovered"


def test_html_paragraphs(spark):
    theorem = "<div class='ltx_theorem ltx_theorem_definition'><h6>Def</h6><div class='ltx_para'><p>A <i>ring</i> <math display='inline'><mi>R</mi></math> is <cite>[1]</cite>.</p></div><div class='ltx_para'>Second.</div></div>"
    other = "<div class='ltx_para'>See <table class='ltx_equation ltx_eqn_table'><tr><td>x=1</td></tr></table> and <table><tr><td>gone</td></tr></table>kept<script>var x;</script></div>"
    item = "<ul><li class='ltx_item'><span class='ltx_tag'>1.</span><div class='ltx_para'>first</div></li></ul>"
    rows = [(1, theorem + other + item), (2, "<p>none"), (3, None), (None, "<div class='ltx_para'></div>")]
    got = pages.html_paragraphs(spark.createDataFrame(rows, "addr long, raw string"), "div", "ltx_para").collect()
    want = [("1", 0, "A ring _inline_math_ is _citation_.", 5, True, "good"), ("1", 1, "Second.", 1, False, "good"), ("1", 2, "See _display_math_ and kept", 4, False, "good"), ("1", 3, "first", 1, False, "good"), ("2", None, None, None, None, "good"), ("3", None, None, None, None, "empty"), (None, 0, "", 0, False, "good")]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert pages.flatten_html(pages.parse_html(item)[0]) == "_item_first"


def test_elements_and_pairs(spark):
    rows = spark.createDataFrame([(1, "<nav>skip</nav><h1>Ring (mathematics)</h1><p>A ring is <b>a</b> set.</p>"), (2, "<h1>Field</h1><p>No such word.</p>"), (3, "<p>x</p>"), (4, None)], "addr int, raw string")
    got = [(r.addr, r["index"], r.depth, r.tag, r.text) for r in pages.elements(rows.where("addr = 1"), skip=("nav",)).collect()]
    assert got == [("1", 0, 0, "html", ""), ("1", 1, 1, "h1", "Ring (mathematics)"), ("1", 2, 1, "p", "A ring is"), ("1", 3, 2, "b", "a")]
    assert [tuple(r) for r in pages.page_pairs(rows).collect()] == [("1", "ring", "A ring is")]
    assert pages.elements(rows.where("false")).collect() == []


def test_xml_lookups(spark):
    raw = "<d><text font='italic'>ring</text><p>one</p><p>two it's</p><text font='bold'>no</text></d>"
    r = spark.createDataFrame([(raw,)], "raw string").select(pages.italic_terms(F.col("raw")).alias("i"), pages.tag_texts(F.col("raw"), "p").alias("p"), pages.tag_holds(F.col("raw"), "p", "it's").alias("h"), pages.tag_holds(F.col("raw"), "p", "two", True).alias("w")).first()
    assert (r.i, r.p, r.h, r.w) == (["ring"], ["one", "two it's"], True, False)


def test_xml_lookups_are_dealt_over_tasks(spark, sf):
    """A table in one small file is not one task."""
    made = files.xml_lookups(spark, sf).select("p_partkey", F.spark_partition_id().alias("task"))
    assert made.select("task").distinct().count() >= 8 and made.count() == spark.read.parquet(f"{sf}/part.parquet").count()


def test_abbreviations_and_sentences(spark):
    rng = random.Random(4)
    nouns = ["ring", "field", "map", "group", "set", "number", "proof"]
    texts = [f"Dr. Abel took the {rng.choice(nouns)} and the {rng.choice(nouns)}. He saw fig. {i} of the {rng.choice(nouns)}! Was it {rng.choice(nouns)}? See J. {rng.choice(nouns)}. It is the 3. ring." for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(90, None), (91, ""), (92, "No end")], "doc_id long, text string")
    known = sentences.abbreviations(docs)
    found = {r.word: (r.n, r.n_point) for r in known.collect()}
    assert found["dr"] == (60, 60) and found["fig"] == (60, 60) and not set(found) & set(nouns)
    # The score of one word by the formula of the paper, from plain counts.
    words = [w for t in [*texts, "No end"] for w in t.split()]
    p = sum(w.endswith(".") for w in words) / len(words)
    want = 2 * 60 * (math.log(0.99) - math.log(p)) * math.exp(-2)
    assert abs(known.where("word = 'dr'").first().score - want) < 1e-9
    rows = sentences.sentences(docs, known).where("doc_id = 0").orderBy("sentence").collect()
    assert [r.text for r in rows] == re.split(r"(?<=[a-z][.!?]) (?=He|Was|See|It)", texts[0])
    assert {r.text for r in sentences.sentences(docs, known).where("doc_id > 80").collect()} == {"No end"}
    got = docs.limit(1).select(sentences.tokens(F.lit("Don't stop, e.g. 3.5 (well)...")).alias("t")).first().t
    assert got == ["Don't", "stop", ",", "e.g", ".", "3.5", "(", "well", ")", "..."]


def test_exact_parts(spark):
    rows = spark.createDataFrame([(i * 7 % 53, i) for i in range(103)], "k long, id long").repartition(5)
    got = stores.exact_parts(rows, 12, "k", "id").collect()
    want = {r: at for at, r in enumerate(sorted((r.k, r.id) for r in rows.collect()))}
    assert all(r.position == want[r.k, r.id] and r.part == f"{min(r.position // 8, 11):02d}" for r in got) and len(got) == 103
    assert stores.exact_parts(rows.where("false"), 3, "k").collect() == []
    assert {r.part for r in stores.exact_parts(rows.limit(2), 5, "k", "id").collect()} == {"0", "1"}


def test_csv_and_commentary(spark, tmp_path):
    rows = [(1, 'say "hi", you', None), (2, "two\nlines", "x"), (3, " , ", "")]
    df = spark.createDataFrame(rows, "id long, note string, more string")
    stores.append_csv(df.where("id < 3"), str(tmp_path / "c"))
    stores.append_csv(df.where("id = 3"), str(tmp_path / "c"))
    got = sorted((r.id, r.note, r.more or None) for r in stores.csv_log(spark, str(tmp_path / "c"), "id long, note string, more string").collect())
    assert got == [(1, 'say "hi", you', None), (2, "two\nlines", "x"), (3, " , ", None)]
    notes = spark.createDataFrame([({"b": "x: y", "a": "1\n 2"},), ({},), (None,)], "notes map<string,string>")
    stores.write_commentary(notes, "notes", str(tmp_path / "n"))
    assert sorted(map(tuple, stores.commentary(spark, str(tmp_path / "n")).collect())) == [("a", "1 2"), ("b", "x: y")]


def test_entity_scores(spark):
    gold = [1, 1, 0, -100, 1, 0, 0, 1, 1]
    guess = [1, 1, 0, 1, 1, 0, 1, 1, 0]
    rows = spark.createDataFrame([("s", i, g, p) for i, (g, p) in enumerate(zip(gold, guess))], "s string, i int, gold int, guess int")
    # Without the ignored word: gold chunks 0-1, 4, 7-8; guessed 0-1, 4, 6-7.
    r = ner.entity_scores(rows, "s", "i", "gold", "guess").first()
    assert (round(r.precision, 6), round(r.recall, 6), round(r.f1, 6), r.accuracy) == (0.666667, 0.666667, 0.666667, 6 / 8)


def test_queries_of_pages(spark, sf):
    want = {str(r.page_id): r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = files.html_paragraphs(spark, sf).collect()
    assert {r.addr for r in got} == set(want)
    for r in got[:200]:
        if r.text:
            assert r.n_words == len(r.text.split()) and r.text.split()[0].replace("&", "&amp;") in want[r.addr]
    # A paragraph for each start tag of one outside of comments and scripts.
    for addr, html in want.items():
        bare = re.sub(r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>", "", html)
        assert sum(r.addr == addr and r.text is not None for r in got) == len(re.findall(r"<p[\s>]", bare))


def test_sentences_move_marked_words_only(spark):
    """Words without a mark once were dealt by document twice; only those that may end a sentence leave it now."""
    from pyspark.sql import functions as F

    from lexiforge.functions import sentences

    rows = [(1, "One two. Three e.g. four! five"), (2, None), (3, ""), (4, " \n "), (5, "7. eight A. Bee. 9. Cee?"), (6, "so e.g."), (None, "Up. Down")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("e.g",)], "word string")
    ends = sentences.sentence_ends(docs, known)
    assert "Window" not in ends._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(((r.doc_id or 0, r.sentence, r.start, r.n_words) for r in ends.collect()))
    assert got == [(0, 0, 0, 1), (0, 1, 1, 1), (1, 0, 0, 2), (1, 1, 2, 3), (1, 2, 5, 1), (5, 0, 0, 4), (5, 1, 4, 1), (5, 2, 5, 1), (6, 0, 0, 2)]
    texts = {(r.doc_id or 0, r.sentence): r.text for r in sentences.sentences(docs, known).collect()}
    assert texts[1, 1] == "Three e.g. four!" and texts[5, 0] == "7. eight A. Bee." and texts[0, 1] == "Down" and len(texts) == 9


def test_cooccurrence_calls_no_function(spark):
    from lexiforge.operators import sequences

    df = spark.createDataFrame([(1, ["a", "b", "c", "a"]), (2, ["a", "b"]), (3, ["x"]), (4, []), (5, None)], "id int, t array<string>")
    out = sequences.cooccurrence(df, "id", "t", 2)
    assert {(r.a, r.b): r.n for r in out.collect()} == {("a", "b"): 2, ("b", "c"): 1, ("c", "a"): 1, ("a", "c"): 1, ("b", "a"): 1}
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
