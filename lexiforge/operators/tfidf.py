"""TF-IDF with sublinear term frequency, smoothed idf and L1 rows, and retrieval on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.operators.stored import Rounds


def tfidf(terms: DataFrame, doc: str, term: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """(doc, term, weight) from one row for each use of a term.

    weight = (1 + ln tf) (1 + ln((N + 1) / (df + 1))), divided by the document's sum. df and the
    vocabulary, a row for each term, are stored first, so that Spark knows their size and
    broadcasts a short one. Then rows that are dealt by document already stay where they are.
    """
    rounds = Rounds(terms.sparkSession, "tfidf")
    if vocabulary is not None:
        terms = terms.join(rounds.save(vocabulary.select(term).distinct()), term, "left_semi")
    counts = terms.groupBy(doc, term).agg(F.count("*").alias("tf"))
    n = counts.agg(F.countDistinct(doc).alias("n_docs"))
    df = rounds.save(counts.groupBy(term).agg(F.count("*").alias("df")))
    raw = counts.join(df, term).crossJoin(F.broadcast(n))  # one row
    raw = raw.withColumn("raw", (1 + F.log("tf")) * (1 + F.log((F.col("n_docs") + 1) / (F.col("df") + 1))))
    total = F.sum("raw").over(Window.partitionBy(doc))
    return raw.select(doc, term, (F.col("raw") / total).alias("weight"))


def top_per_key(rows: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The first k rows of each key by a total order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def sort_key(weight, place=0):
    """Whole-number score: ten decimals of the weight, plus a place that makes it unique."""
    return F.floor(weight * F.lit(1e10)).cast("long") + place
