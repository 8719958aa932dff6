"""The corpus pipeline: documents to packed training sequences, one Parquet table per stage.

language    documents without a language go: no letter, or the score is under MIN_SCORE
lines       one line of each group of near-equal lines stays; documents left empty go
near        one document of each group of near-equal fingerprints stays
mix         sources are sampled to target weights; rows repeat as often as they are taken
pack        token pieces with their place in training sequences

Defined cases, stage by stage: a null or letterless text has no language and goes; rows that
repeat count as one document for lines and near copies, of which one stays; a null source
is a source of its own; a null doc_id is kept like any other; an empty table stays empty
through all stages. Stages before the last keep every column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import langid, linededup, mixing, packing, simhash
from lexiforge.llm.common import Scratch, release

#: Four languages with no evidence score 0.25; running text of one scores near 1.
MIN_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    marked = langid.predict(docs, model)
    return marked.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.apply(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language", language), ("lines", lines), ("near", near), ("mix", mix), ("pack", pack)]

#: Language scores, min-hash candidates and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = len(Scratch.made)
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        release(made)  # what the stage stored for itself
    return docs
