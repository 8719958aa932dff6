"""Term references: where each term of a glossary is defined, with its weight in the article."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.operators import tfidf

#: Characters of the longest paragraph kept.
MOST = 250_000


def term_references(glossary: DataFrame, paragraphs: DataFrame, uses: DataFrame, most: int = MOST) -> DataFrame:
    """(term, addr, p_index, truid, p_tag, weight, sort_key) from glossary (term, addr, p_index), paragraphs (addr, p_index, p_tag) and uses (addr, term).

    Paragraphs are found by article and place, never by position in a list; one that isn't
    there is ''. truid numbers a term's references from 0, by article and place, before
    paragraphs of `most` characters or more go. Weights are of terms of the glossary only.
    The sort key is the weight's ten decimals with the place added.
    """
    known = glossary.select("term", "addr", "p_index").distinct()
    weights = tfidf.tfidf(uses, "addr", "term", known).withColumn("weight", F.round("weight", 9))
    placed = known.join(paragraphs, ["addr", "p_index"], "left").withColumn("p_tag", F.coalesce("p_tag", F.lit("")))
    numbered = placed.withColumn("truid", F.row_number().over(Window.partitionBy("term").orderBy("addr", "p_index")) - 1)
    kept = numbered.where(F.length("p_tag") < most).join(weights, ["addr", "term"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return kept.withColumn("sort_key", tfidf.sort_key(F.col("weight"), F.col("p_index")))
