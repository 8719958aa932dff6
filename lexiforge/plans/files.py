"""Queries of readers, writers, streams, HTML articles and sentences: each reader's query writes its files from a table to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.functions import pages as P
from lexiforge.functions import sentences as S
from lexiforge.operators import ner
from lexiforge.operators.stored import Rounds
from lexiforge.plans import more
from lexiforge.plans.more import ORACLES, QUERIES, query, read  # noqa: F401
from lexiforge.sources import stores, tables
from lexiforge.streaming import batches

_before = set(QUERIES)


@query("SELECT 'src/' || p_name || '.tar' AS filename, md5(p_name) AS md5sum, p_size AS num_items, p_partkey AS size FROM part")
def manifest_scan(spark, sf):
    path = Rounds(spark, "manifest").path()
    rows = read(spark, sf, "part").select(F.concat(F.lit("src/"), "p_name", F.lit(".tar")).alias("filename"), F.md5("p_name").alias("md5sum"), F.col("p_size").alias("num_items"), F.col("p_partkey").alias("size"))
    rows.write.format("xml").option("rootTag", "root").option("rowTag", "file").save(path)
    return tables.manifest(spark, path).select("filename", "md5sum", "num_items", "size")


@query("SELECT DISTINCT 'doc' || (p_partkey // 10) AS article, (p_partkey // 10)::INTEGER AS num, (p_partkey % 10)::INTEGER AS index, 'A <' || p_name || '> & \"more\".' AS stmnt, unnest([p_brand, p_type]) AS term FROM part")
def glossary_scan(spark, sf):
    """Gzip XML of articles with definitions and their terms, written and read."""
    path = Rounds(spark, "glossary").path()
    tens = F.expr("p_partkey div 10")
    rows = read(spark, sf, "part").select(F.concat(F.lit("doc"), tens).alias("article"), tens.cast("int").alias("num"), (F.col("p_partkey") % 10).cast("int").alias("index"), F.concat(F.lit("A <"), "p_name", F.lit('> & "more".')).alias("stmnt"), F.explode(F.array("p_brand", "p_type")).alias("term"))
    tables.write_glossary(rows.distinct(), path)
    return tables.glossary(spark, path)


@query("SELECT 'T' || conv_id || '-' || turn AS title, string_agg(role || ' & <b>', '') AS text FROM conversations GROUP BY conv_id, turn, role")
def wiki_scan(spark, sf):
    path = Rounds(spark, "wiki").path()
    text = F.struct(F.struct(F.concat("role", F.lit(" & <b>")).alias("_VALUE"), F.lit(1).alias("_bytes")).alias("text"))
    rows = read(spark, sf, "conversations").select(F.concat(F.lit("T"), "conv_id", F.lit("-"), "turn").alias("title"), text.alias("revision"))
    rows.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").option("compression", "bzip2").save(path)
    return tables.wiki_pages(spark, path)


@query("SELECT 'w' || vec_id AS word, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 3) AS total FROM embeddings")
def vectors_scan(spark, sf):
    """word2vec's text form, written with its line of sizes and read."""
    path = Rounds(spark, "vectors").path()
    rows = read(spark, sf, "embeddings")
    sizes = rows.agg(F.concat(F.count("*"), F.lit(" "), F.max(F.size("embedding"))).alias("value"))
    sizes.union(rows.select(F.concat(F.lit("w"), "vec_id", F.lit(" "), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")).alias("value"))).write.text(path)
    return tables.word2vec_text(spark, path).select("word", F.size("vec").alias("n"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 3).alias("total"))


@query("SELECT lang, count(*) AS n, sum(length(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]*\\n[ \\t\\n\\x0b\\f\\r]*', ' ', 'g')))::BIGINT AS chars FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY lang")
def text_lines(spark, sf):
    """One text a line in a folder for each language."""
    path = Rounds(spark, "lines").path()
    tables.write_lines(read(spark, sf, "documents").where("lang is not null and text is not null"), "text", "lang", path)
    return spark.read.option("lineSep", "\n").text(path).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


@query("SELECT source AS folder, 1::BIGINT AS files FROM documents WHERE source IS NOT NULL GROUP BY source")
def file_locations(spark, sf):
    path = Rounds(spark, "index").path()
    rows = read(spark, sf, "documents").where("source is not null").groupBy("source").agg(F.count("*").cast("string").alias("value"))
    rows.repartition("source").write.partitionBy("source").text(path)
    found = tables.file_index(spark, path, "*.txt").where("length > 0")
    return found.groupBy(F.regexp_extract("path", "source=([^/]*)/", 1).alias("folder")).agg(F.count("*").alias("files"))


@query("""SELECT doc_id, lang, coalesce(source, '') || ', "' || coalesce(lang, '') || chr(10) || '"' AS note, n_chars FROM documents""")
def csv_log_scan(spark, sf):
    """A log in CSV with quotes, commas and line ends, written in two goes."""
    path = Rounds(spark, "csv").path()
    note = F.concat(F.coalesce("source", F.lit("")), F.lit(', "'), F.coalesce("lang", F.lit("")), F.lit('\n"')).alias("note")
    rows = read(spark, sf, "documents").select("doc_id", "lang", note, "n_chars")
    stores.append_csv(rows.where("doc_id % 2 = 0"), path)
    stores.append_csv(rows.where("doc_id % 2 <> 0 or doc_id is null"), path)
    return stores.csv_log(spark, path, "doc_id long, lang string, note string, n_chars long")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0")
def insert_delete(spark, sf):
    path = Rounds(spark, "table").path()
    rows = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    stores.insert_rows(rows.where("o_orderkey % 2 = 0"), path)
    stores.insert_rows(rows.where("o_orderkey % 2 = 1"), path)
    stores.delete_rows(spark, path, F.col("o_orderkey") % 5 == 0)
    return spark.read.parquet(path)


@query("SELECT key, value, count(*) AS n FROM (SELECT unnest(['encoding', 'name']) AS key, unnest([coalesce(lang, ''), source || ': x']) AS value FROM documents WHERE source IS NOT NULL) GROUP BY key, value")
def commentary_lines(spark, sf):
    path = Rounds(spark, "notes").path()
    rows = read(spark, sf, "documents").where("source is not null").select(F.create_map(F.lit("name"), F.concat("source", F.lit(": x")), F.lit("encoding"), F.col("lang")).alias("notes"))
    stores.write_commentary(rows, "notes", path)
    return stores.commentary(spark, path).groupBy("key", "value").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos, count(*) OVER () // 7 AS each_ FROM orders)
SELECT least(pos // each_, 6)::VARCHAR AS part, count(*) AS n, min(pos) AS first, sum(o_orderkey)::BIGINT AS keys FROM p GROUP BY ALL""")
def exact_split(spark, sf):
    """Seven contiguous parts of the orders by price, the last with the remainder, written and read."""
    path = Rounds(spark, "parts").path()
    stores.write_exact_parts(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), path, 7, "o_totalprice", "o_orderkey")
    rows = spark.read.schema("o_orderkey long, position long, part string").json(path)
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.min("position").alias("first"), F.sum("o_orderkey").alias("keys"))


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def stream_append(spark, sf):
    """Files that come in two lots are each appended once, over two runs of the stream."""
    rounds = Rounds(spark, "stream")
    came, done, out = rounds.path(), rounds.path(), rounds.path()
    rows = read(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    for half in ("doc_id % 2 = 0", "coalesce(doc_id % 2, 1) <> 0"):
        stores.insert_rows(rows.where(half), came)
        batches.append_new(batches.new_files(spark, came, rows.schema, files=2), done, out)
    return spark.read.parquet(out).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN [p_brand, p_type] ELSE [p_type] END AS italic, ['A ', ' is '] AS parts, starts_with(p_brand, 'Brand#1') AS hit, p_type = 'STANDARD' AS same FROM part")
def xml_lookups(spark, sf):
    """Italic terms, texts of a tag and text search in XML definitions made from parts."""
    esc = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    font = F.when(F.col("p_size") % 2 == 0, "bold italic").otherwise("plain")
    raw = F.concat(F.lit("<def><p>A <text font='"), font, F.lit("'>"), esc("p_brand"), F.lit("</text> is <text font='italic'>"), esc("p_type"), F.lit("</text></p></def>"))
    # A small file is one task, and paths take long: rows are dealt over all cores first.
    part = read(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size").repartition(4 * spark.sparkContext.defaultParallelism)
    rows = part.select("p_partkey", "p_type", raw.alias("raw"))
    return rows.select("p_partkey", P.italic_terms(F.col("raw")).alias("italic"), P.tag_texts(F.col("raw"), "p").alias("parts"), P.tag_holds(F.col("raw"), "text", "Brand#1").alias("hit"), P.tag_holds(F.col("raw"), "text", "STANDARD", True).alias("same"))


@query()
def html_paragraphs(spark, sf):
    """All paragraphs of all pages with their number of words and the state of the page's mark-up; a parser has no SQL, tests hold it against trees written by hand."""
    rows = read(spark, sf, "pages").select(F.col("page_id").alias("addr"), F.col("html").alias("raw"))
    return P.html_paragraphs(rows).select("addr", "index", "text", "n_words", "definition", "status")


@query()
def html_elements(spark, sf):
    """How often each tag stands at each depth of the pages, menus left out."""
    rows = read(spark, sf, "pages").select(F.col("page_id").alias("addr"), F.col("html").alias("raw"))
    return P.elements(rows, skip=("nav", "script", "style")).groupBy("tag", "depth").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query()
def page_definitions(spark, sf):
    """Pages whose first paragraph holds their title."""
    return P.page_pairs(read(spark, sf, "pages").select(F.col("page_id").alias("addr"), F.col("html").alias("raw")))


_BARE = "lower(regexp_replace({0}, '^[\"''(\\[]+|[\"'')\\],;:]*$|\\.[\"'')\\],;:]*$', '', 'g'))"
_POINT = "regexp_matches({0}, '\\.[\"'')\\],;:]*$')"
_SENT = f"""w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS ws FROM documents)),
u AS (SELECT {_BARE.format('w')} AS word, count(*)::DOUBLE AS a, sum({_POINT.format('w')}::INTEGER)::DOUBLE AS k FROM w GROUP BY 1), g AS (SELECT sum(a) AS na, sum(k) AS nk FROM u),
v AS (SELECT word, a, k, nk / na AS p, (length(word) - length(replace(word, '.', '')))::DOUBLE AS inner_, length(replace(word, '.', ''))::DOUBLE AS letters FROM u, g WHERE regexp_matches(word, '[^0-9.]') AND k > 0),
s AS (SELECT word, a, k, 2 * (k * ln(0.99::DOUBLE) + (a - k) * ln(1 - 0.99::DOUBLE) - k * ln(p) - CASE WHEN a > k THEN (a - k) * ln(1 - p) ELSE 0 END) * exp(-letters) * (inner_ + 1) * pow(letters, k - a) AS score FROM v),
ab AS (SELECT * FROM s WHERE score >= 0.3)"""


@query(f"WITH {_SENT} SELECT word, a::BIGINT AS n, k::BIGINT AS n_point, round(score, 6) AS score FROM ab")
def abbreviations(spark, sf):
    """Abbreviations learnt from all documents."""
    return S.abbreviations(read(spark, sf, "documents")).withColumn("score", F.round("score", 6))


@query(f"""WITH {_SENT}, h AS (SELECT doc_id, pos, w, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS nx, {_BARE.format('w')} IN (SELECT word FROM ab) AS short FROM w),
e AS (SELECT doc_id, pos, (regexp_matches(w, '[!?…]["'')\\]]*$') OR ({_POINT.format('w')} AND NOT short AND NOT regexp_matches(w, '^\\p{{L}}\\.$') AND NOT (regexp_matches(w, '^[0-9]+\\.$') AND coalesce(regexp_matches(nx, '^\\p{{Ll}}'), false)))) AS ends FROM h),
n AS (SELECT doc_id, pos, coalesce(sum(ends::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM e)
SELECT doc_id, sentence::INTEGER AS sentence, count(*)::INTEGER AS n_words FROM n GROUP BY doc_id, sentence""")
def sentence_split(spark, sf):
    """The sentences of all documents, abbreviations learnt from them first."""
    docs = read(spark, sf, "documents")
    return S.sentence_ends(docs, S.abbreviations(docs)).select("doc_id", "sentence", "n_words")


@query("SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: NOT regexp_matches(x, '[\\p{L}\\p{N}]'))) AS marks FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+(?:[.''’-][\\p{L}\\p{N}]+)*|\\.{3}|[^\\s\\p{L}\\p{N}]') AS t FROM documents WHERE text IS NOT NULL)")
def word_tokens(spark, sf):
    """Words and marks of every document."""
    t = S.tokens(F.col("text"))
    rows = read(spark, sf, "documents").where("text is not null").select("doc_id", t.alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.filter("t", lambda x: ~x.rlike(r"[\p{L}\p{N}]"))).cast("long").alias("marks"))


_KEPT = more._CUTS.rstrip() + ", k AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY i) AS i, g, score FROM f WHERE i % 5 <> 0)"


@query(_KEPT + f""", a AS {more._SPANS.format('g').replace('FROM f', 'FROM k')}, b AS {more._SPANS.format('score > 0.62').replace('FROM f', 'FROM k')},
m AS (SELECT count(*) FILTER (WHERE a.s IS NOT NULL AND b.s IS NOT NULL) AS n_both, count(*) FILTER (WHERE b.s IS NULL) AS n_left, count(*) FILTER (WHERE a.s IS NULL) AS n_right FROM a FULL JOIN b ON a.s = b.s AND a.start = b.start AND a.n = b.n)
SELECT round(n_both / (n_both + n_right)::DOUBLE, 9) AS precision, round(n_both / (n_both + n_left)::DOUBLE, 9) AS recall, round(2 * n_both / (2 * n_both + n_left + n_right)::DOUBLE, 9) AS f1, (SELECT round(avg((g = (score > 0.62))::INTEGER), 9) FROM k) AS accuracy FROM m""")
def entity_scores(spark, sf):
    """Precision, recall, F1 of entities and accuracy of words, those with an ignored label left out."""
    rows = more._gold(spark, sf).withColumn("label", F.when(F.col("i") % 5 == 0, -100).otherwise(F.col("g").cast("int"))).withColumn("guess", F.when(F.col("score") > 0.62, 1).otherwise(0))
    out = ner.entity_scores(rows, "s", "i", "label", "guess")
    return out.select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


NAMES = [n for n in QUERIES if n not in _before]
