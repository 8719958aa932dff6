"""Sentences of running text: abbreviations are learnt from the counts of the corpus, then each point is judged.

The test of an abbreviation is that of Kiss and Strunk (Unsupervised Multilingual Sentence Boundary Detection, 2006): a
log-likelihood ratio of how often a word stands before a point, weighted by its length, its inner points and
how often it stands without one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the test: share of points after an abbreviation, least score.
SHARE, LEAST = 0.99, 0.3


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.array_remove(F.split(text, r"[ \t\n\x0b\f\r]++"), "")


def _bare(word: Column) -> Column:
    """A word in lower case without quotes and brackets around it and its last point."""
    return F.lower(F.regexp_replace(word, r"^[\"'(\[]+|[\"')\],;:]*$|\.[\"')\],;:]*$", ""))


def _pointed(word: Column) -> Column:
    return word.rlike(r"\.[\"')\],;:]*$")


def abbreviations(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n, n_point, score): the words of all documents that are abbreviations; counts are partial sums on every executor."""
    # Words are counted as they stand first: patterns then meet each word once, not each of its uses.
    used = docs.select(F.explode(words(F.col(text))).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    used = used.select(_bare(F.col("w")).alias("word"), "c", F.when(_pointed(F.col("w")), F.col("c")).otherwise(0).alias("p"))
    per = used.groupBy("word").agg(F.sum("c").alias("n"), F.sum("p").alias("n_point"))
    total = per.agg(F.sum("n").alias("all_n"), F.sum("n_point").alias("all_point"))
    rows = per.where(F.col("word").rlike(r"[^0-9.]") & (F.col("n_point") > 0)).crossJoin(F.broadcast(total))  # one row
    p, a, k = F.col("all_point") / F.col("all_n"), F.col("n").cast("double"), F.col("n_point").cast("double")
    ratio = 2 * (k * F.ln(F.lit(SHARE)) + (a - k) * F.ln(F.lit(1 - SHARE)) - k * F.ln(p) - F.when(a > k, (a - k) * F.ln(1 - p)).otherwise(0.0))
    inner = F.length("word") - F.length(F.translate("word", ".", ""))
    letters = (F.length("word") - inner).cast("double")
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, k - a)
    return rows.select("word", "n", "n_point", score.alias("score")).where(F.col("score") >= LEAST)


def sentence_ends(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence, start, n_words) of documents, whose keys are their own: a word ends one with !, ? or ..., or with a point if it is no abbreviation of `known` (word), no single letter and no number before a small letter.

    Only words with such a mark, and the last of each document, leave it and meet the abbreviations; the places of
    one document are gathered in a row.
    """
    # Exploded as one row, so that no condition cuts the text again.
    held = docs.select(key, F.explode(F.array(words(F.col(text)))).alias("ws")).where("size(ws) > 0")
    both = F.arrays_zip(F.col("ws").alias("w"), F.slice("ws", F.lit(2), F.size("ws")).alias("after"))
    placed = held.select(key, (F.size("ws") - 1).alias("last"), F.posexplode(both).alias("at", "x")).select(key, "last", "at", "x.w", "x.after")
    marked = F.col("w").rlike(r"[!?…][\"')\]]*$")
    placed = placed.select("*", marked.alias("marked"), _pointed(F.col("w")).alias("pointed")).where("marked or pointed or at = last")
    found = placed.select(key, "last", "at", "w", "after", "marked", "pointed", F.when(F.col("pointed") & ~F.col("marked"), _bare(F.col("w"))).alias("bare_w"))
    met = found.join(known.select(F.col("word").alias("bare"), F.lit(True).alias("short")), F.col("bare_w") == F.col("bare"), "left")
    small = F.coalesce(F.col("after").rlike(r"^\p{Ll}"), F.lit(False))
    point = F.col("pointed") & F.col("short").isNull() & ~F.col("w").rlike(r"^\p{L}\.$") & ~(F.col("w").rlike(r"^[0-9]+\.$") & small)
    ends = met.where(F.col("marked") | point | (F.col("at") == F.col("last"))).groupBy(key).agg(F.array_sort(F.collect_set("at")).alias("ends"))
    starts = F.concat(F.array(F.lit(0)), F.transform("ends", lambda e: e + 1))
    each = ends.select(key, F.posexplode(F.arrays_zip(F.col("ends").alias("end"), F.slice(starts, F.lit(1), F.size("ends")).alias("start"))).alias("sentence", "x"))
    return each.select(key, "sentence", F.col("x.start").alias("start"), (F.col("x.end") - F.col("x.start") + 1).alias("n_words"))


def sentences(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence, n_words, text): the sentences of `sentence_ends` with their words, put together where the document lies."""
    ends = sentence_ends(docs, known, key, text).groupBy(F.col(key).alias("_of")).agg(F.collect_list(F.struct("sentence", "start", "n_words")).alias("found"))
    held = docs.select(key, words(F.col(text)).alias("ws")).join(ends, F.col(key).eqNullSafe(F.col("_of")))
    each = held.select(key, "ws", F.explode("found").alias("s"))
    return each.select(key, "s.sentence", "s.n_words", F.array_join(F.slice("ws", F.col("s.start") + 1, F.col("s.n_words")), " ").alias("text"))


def tokens(sentence: Column) -> Column:
    """Words, numbers and marks of a sentence, each on its own; points within a word stay."""
    return F.regexp_extract_all(sentence, F.lit(r"[\p{L}\p{N}]+(?:[.'’-][\p{L}\p{N}]+)*|\.{3}|[^\s\p{L}\p{N}]"), F.lit(0))
