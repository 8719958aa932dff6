"""Readers, writers, mark-up, learning and streams on small files made here."""

import gzip
import hashlib
import io
import struct
import tarfile

from pyspark.sql import functions as F

from lexiforge.functions import markup
from lexiforge.operators import learning
from lexiforge.sources import archives, tables
from lexiforge.streaming import batches


def test_manifest(spark, tmp_path):
    (tmp_path / "m.xml").write_text("<arXivSRC><file><filename>src/a.tar</filename><num_items>3</num_items><size>12</size></file><timestamp>now</timestamp><file><filename>src/b.tar</filename></file></arXivSRC>")
    rows = tables.manifest(spark, str(tmp_path / "m.xml")).orderBy("filename").collect()
    assert [(r.filename, r.num_items, r.size) for r in rows] == [("src/a.tar", 3, 12), ("src/b.tar", None, None)]


def test_glossary_round_trip(spark, tmp_path):
    terms = [("a1", 1, 0, "A ring is a set <with> & two laws.", "ring"), ("a1", 1, 0, "A ring is a set <with> & two laws.", "unit"), ("a1", 1, 4, "A field.", "field"), ("b2", 2, 1, "A map.", "map")]
    tables.write_glossary(spark.createDataFrame(terms, "article string, num int, index int, stmnt string, term string"), str(tmp_path / "g"))
    assert sorted(map(tuple, tables.glossary(spark, str(tmp_path / "g")).collect())) == sorted(terms)


def test_wiki_pages(spark, tmp_path):
    import bz2

    text = "<mediawiki><page><title>Ring</title><ns>0</ns><id>1</id><revision><text bytes='3'>One</text></revision></page><page><title>Map</title><revision><text bytes='0'>Two</text></revision></page></mediawiki>"
    (tmp_path / "w.xml.bz2").write_bytes(bz2.compress(text.encode()))
    assert sorted(map(tuple, tables.wiki_pages(spark, str(tmp_path / "w.xml.bz2")).collect())) == [("Map", "Two"), ("Ring", "One")]


def test_vectors(spark, tmp_path):
    data = b"2 3\n" + b"".join(w.encode() + b" " + struct.pack("<3f", *v) + b"\n" for w, v in (("ring", (1, 2, 3)), ("map", (0, -1, 0.5))))
    (tmp_path / "v.bin").write_bytes(data)
    assert sorted((r.word, list(r.vec)) for r in archives.word2vec_binary(spark, str(tmp_path / "v.bin")).collect()) == [("map", [0.0, -1.0, 0.5]), ("ring", [1.0, 2.0, 3.0])]
    (tmp_path / "vocab.txt").write_text("ring 9\nmap 4\n")
    (tmp_path / "vectors.txt").write_text("1 2\n3 4\n5 6\n")
    assert sorted((r.word, list(r.vec)) for r in tables.glove(spark, str(tmp_path / "vocab.txt"), str(tmp_path / "vectors.txt")).collect()) == [("<unk>", [5.0, 6.0]), ("map", [3.0, 4.0]), ("ring", [1.0, 2.0])]


def test_numbered_over_partitions(spark):
    rows = tables.numbered(spark.range(0, 1000, 1, 7), "n").collect()
    assert all(r.id == r.n for r in rows)


def _tar(files):
    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode="w") as t:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return held.getvalue()


def test_archives(spark, tmp_path):
    main = rb"\documentclass{article}\title{x}\begin{document}\input{part}\end{document}"
    inner = gzip.compress(_tar([("main.tex", main), ("part.tex", rb"\documentclass{article} part"), ("b.tex", "caf\xe9".encode("latin-1"))]))
    outer = _tar([("1001/1001.0001.gz", inner), ("1001/1001.0002.gz", gzip.compress("né".encode())), ("1001/1001.0003.pdf", b"%PDF"), ("1001/1001.0004.gz", b"\x1f\x8bbroken")])
    (tmp_path / "a.tar").write_bytes(outer)
    (tmp_path / "torn.tar").write_bytes(outer[:100])
    rows = archives.tar_members(spark, str(tmp_path))
    got = {(r.article, r.member, r.kind, r.encoding) for r in rows.collect()}
    assert got == {
        ("1001.0001", "main.tex", "file", "utf-8"), ("1001.0001", "part.tex", "file", "utf-8"), ("1001.0001", "b.tex", "file", "cp1252"), ("1001.0002", "1001.0002.tex", "file", "utf-8"),
        ("1001.0003", "1001/1001.0003.pdf", "pdf", None), ("1001.0004", "1001/1001.0004.gz", "damaged", None), (None, None, "damaged", None),
    }
    assert [(r.article, r.member, r.score) for r in archives.main_files(rows).collect()] == [("1001.0001", "main.tex", 3)]
    sums = spark.createDataFrame([("src/a.tar", hashlib.md5(outer).hexdigest()), ("src/no.tar", "0")], "filename string, md5sum string")
    assert sorted((r.filename, r.ok) for r in tables.verify_checksums(spark, str(tmp_path), sums).collect()) == [("src/a.tar", True), ("src/no.tar", False)]
    assert {r.name for r in tables.file_index(spark, str(tmp_path), "*.tar").collect()} == {"a.tar", "torn.tar"}


def test_sinks(spark, tmp_path):
    tables.write_parts(spark.range(100), str(tmp_path / "p"), 4, "id")
    parts = spark.read.json(str(tmp_path / "p")).groupBy("part").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).orderBy("a").collect()
    assert sum(r.n for r in parts) == 100 and all(x.b < y.a for x, y in zip(parts, parts[1:]))
    tables.write_lines(spark.createDataFrame([("a\n b", 1), ("c", 0)], "t string, y int"), "t", "y", str(tmp_path / "l"))
    assert {(r.value, r.y) for r in spark.read.text(str(tmp_path / "l")).collect()} == {("a b", 1), ("c", 0)}


def test_paragraphs(spark):
    good = """<document xmlns="http://dlmf.nist.gov/LaTeXML"><theorem class="ltx_theorem_definition"><tags><tag role="refnum">1</tag></tags><para><p>A ring <Math mode="inline"/> is<break/>a set <cite>x</cite> here.</p></para></theorem>
    <para><p>See <ERROR>oops</ERROR> lost <itemize><item>one</item></itemize></p></para></document>"""
    rows = spark.createDataFrame([("a", good), ("b", ""), ("c", None), ("d", "<x>"), ("e", "<d><para>ok\x01</para></d>")], "addr string, raw string")
    got = {(r.addr, r["index"]): r for r in markup.paragraphs(rows).collect()}
    assert got["a", 0].text.strip() == "A ring _inline_math_ is a set _citation_ here." and got["a", 0].definition
    assert got["a", 1].text.strip() == "See _item_ one" and got["a", 1].error and not got["a", 1].definition
    assert {k[0]: r.status for k, r in got.items()} == {"a": "good", "b": "empty", "c": "empty", "d": "bad", "e": "cleaned"}
    assert [r.addr for r in markup.definitions(rows, 5).collect()] == ["a"]


def test_macros_links(spark):
    rows = spark.createDataFrame([(r"a \xy{b{c}d} e \xy{f}",), (r"open \xy{b{c}",), (None,)], "t string")
    assert [r.o for r in rows.select(markup.without_macro(F.col("t"), "xy").alias("o")).collect()] == ["a  e ", r"open \xy{b{c}", None]
    html = spark.createDataFrame([('<a href="/wiki/Ring">r</a><a class="x" href="/wiki/File:a">f</a><a href="/no">n</a>',)], "h string")
    assert html.select(markup.article_links(F.col("h"))).first()[0] == ["/wiki/Ring"]


def test_learning(spark):
    rows = spark.createDataFrame([(i, ["good", "proof", f"w{i % 5}"] if i % 2 else ["bad", "noise", f"w{i % 5}"], float(i % 2)) for i in range(60)], "id int, tokens array<string>, label double")
    for kind in ("logistic", "bayes", "tree"):
        assert learning.scored(learning.text_classifier(kind).fit(rows), rows, ["id", "label"]).where("label <> prediction").count() == 0
    marks = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.9, 1)], "score double, label int")
    assert abs(learning.auc_and_loss(marks).first().auc - 0.875) < 1e-12


def test_streams(spark, tmp_path):
    source, mark, seen = str(tmp_path / "in"), str(tmp_path / "mark"), []
    spark.range(10).write.parquet(source)
    for extra in ((), (10, 15)):
        if extra:
            spark.range(*extra).write.mode("append").parquet(source)
        batches.drain(batches.new_files(spark, source, "id long", files=1), mark, lambda df, i: seen.extend(r.id for r in df.collect()))
    assert sorted(seen) == list(range(15))
