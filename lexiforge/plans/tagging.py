"""Queries of the chunk tagger, of paragraph differences and of definition pairs by site; importing this registers them beside the others."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lexiforge.functions import pages as P
from lexiforge.operators import alignment, chunker, ner
from lexiforge.plans.models import ORACLES, QUERIES, query, read  # noqa: F401

_before = set(QUERIES)
_HEADS = ("the", "der", "die", "das", "la", "le", "les", "el")


def _taught(sentences: pd.Series) -> pd.Series:
    """Tags in one pass, for sentences may be very long."""
    out = []
    for words in sentences:
        tags, left = [], 0
        for w in words:
            begins = not left and w.lower() in _HEADS
            tags.append("B" if begins else "I" if left else "O")
            left = 2 if begins else max(0, left - 1)
        out.append(tags)
    return pd.Series(out, dtype=object)


def _sentences(spark, sf):
    """(doc_id, sent_no, words, tags): sentences of the documents; an article begins a chunk of itself and the two words after it."""
    docs = read(spark, sf, "documents").where("text is not null").withColumn("text", F.translate("text", "\n", " "))
    rows = ner.sentences(docs, "text", "doc_id").select("doc_id", "sent_no", F.filter(F.split("sentence", r"\s+"), lambda w: w != "").alias("words"))
    return rows.where(F.size("words") > 0).withColumn("tags", F.pandas_udf(_taught, "array<string>")("words"))


def _guessed(spark, sf):
    rows = _sentences(spark, sf)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    tagger = chunker.fit(rows.where(~held), "words", "tags")
    return rows.where(held).withColumn("guess", tagger.tag(F.col("words")))


@query()
def chunk_tags(spark, sf):
    """Held-out sentences with the number of their chunks, taught and guessed."""
    begun = lambda c: F.size(F.filter(c, lambda t: t == "B"))
    return _guessed(spark, sf).select("doc_id", "sent_no", F.size("words").alias("n_words"), begun("tags").alias("n_gold"), begun("guess").alias("n_guess"))


@query()
def chunk_tagger_scores(spark, sf):
    """Precision, recall and F1 of the chunks of held-out sentences."""
    words = _guessed(spark, sf).select(F.concat_ws(":", "doc_id", "sent_no").alias("s"), F.posexplode(F.arrays_zip("tags", "guess")).alias("i", "x"))
    words = words.select("s", "i", F.col("x.tags").alias("gold"), F.col("x.guess").alias("guess"))
    found = {c: ner.spans(words, "s", "i", c) for c in ("gold", "guess")}
    out = ner.chunk_score(found["gold"], found["guess"], ["s", "start", "n"])
    return out.select(*[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")])


@query("""WITH l AS (SELECT doc_id, unnest(range(len(p))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE i % 7 <> 3 AND i % 11 <> 5) AS kept, count(*) FILTER (WHERE i % 7 <> 3) AS n_right FROM l GROUP BY doc_id)
SELECT doc_id, n AS n_left, n_right, kept AS n_same FROM n""")
def paragraph_diff(spark, sf):
    """Lines of each document against a copy of it without every seventh and with every eleventh written anew."""
    lines = read(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    fresh = F.when(F.col("i") % 11 == 5, F.concat(F.lit("§"), F.col("i"), F.lit("\n"))).otherwise(F.col("line"))
    copy = lines.where("i % 7 <> 3").select("doc_id", "i", fresh.alias("line"))
    rows = alignment.paragraph_diff(lines, copy, "doc_id", "i", "line")
    return rows.groupBy("doc_id").agg(F.count("left_at").alias("n_left"), F.count("right_at").alias("n_right"), F.count_if(F.col("op") == "same").alias("n_same"))


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS p, trim(string_split(string_split(text, chr(10))[1], ' ')[1], chr(9) || chr(13)) AS word FROM documents WHERE text IS NOT NULL)
SELECT doc_id::VARCHAR AS addr, CASE WHEN doc_id % 4 <> 3 THEN lower(word) END AS title, CASE WHEN doc_id % 4 <> 3 AND len(p) > 1 THEN md5(p[2]) END AS definition_md5,
CASE WHEN doc_id % 4 = 3 THEN 'no style' WHEN len(p) < 2 THEN 'no definition' WHEN contains(lower(p[2]), lower(word)) THEN 'pair' ELSE 'no match' END AS status FROM d""")
def site_definitions(spark, sf):
    """Documents as pages of several sites: the first word is the title, the second line the definition."""
    lines = F.split(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), "\n")
    word, second, turn = F.get(F.split(F.get(lines, F.lit(0)), " "), F.lit(0)), F.get(lines, F.lit(1)), F.col("doc_id") % 4
    rows = read(spark, sf, "documents").where("text is not null")
    host = F.when(turn == 0, "en.wikipedia.org/wiki/a").when(turn == 1, "groupprops.subwiki.org/wiki/a").when(turn == 2, "stacks.math.columbia.edu/tag/03NB").otherwise("example.org/wikipedia")
    text = F.coalesce(F.concat(F.lit("<p>"), second, F.lit("</p>")), F.lit(""))
    place = F.when(turn == 2, '<div class="env-definition"><b>1</b>').otherwise('<span class="mw-headline" id="Formal_Definition">d</span>')
    wiki = F.concat(F.lit('<h1 id="firstHeading">'), word, F.lit(" (mathematics)</h1><p>intro</p>"), F.when(second.isNotNull(), place).otherwise(""), text)
    stacks = F.concat(F.lit('<h2 class="tex-section"><span>54.9</span> '), word, F.lit("</h2>"), F.when(second.isNotNull(), place).otherwise(""), text)
    pages = rows.select(F.col("doc_id").alias("addr"), F.concat(F.lit("https://"), host).alias("url"), F.when(turn == 2, stacks).otherwise(wiki).alias("raw"))
    return P.site_pairs(pages).select("addr", "title", F.md5("definition").alias("definition_md5"), "status")


NAMES = [n for n in QUERIES if n not in _before]
