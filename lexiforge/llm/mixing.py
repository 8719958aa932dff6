"""Operator 1: mixing sources to target weights by systematic sampling.

Each source gets a share of the words to take by weight, at most `cap` times what
it has; the excess is dealt again by weight (water filling). Within a source every
document expects target / source_size copies. The running sum of these, in the order
of size, plus one random offset is cut at the integers: a document is taken once
for every integer that its step crosses, so a cap of 1.5 gives one or two copies.

Defined cases: null text has size 0; null sources form one source, last in order;
sources of size 0 get target 0 and nothing is taken from them; rows that agree in
doc_id and text are interchangeable; an empty table gives an empty result; `mix`
reads doc_id, text and source only, `repeat` keeps every column, whatever its name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import WORD_PATTERN, Scratch, packed, unpacked

WEIGHTS = (3, 1, 2)
SEED = 7
#: A size class is split by hash into so many slices, which bounds a bucket of a hot source.
SLICES = 16


def hash_long(*cols: Column) -> Column:
    """60 bits of an md5, which any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("long")


def row_hash(seed: int = SEED) -> Column:
    return hash_long(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.md5("text"), F.lit("null")))


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(counts: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from rows with source and words: one row for each source.

    Sources ordered by limit per weight fill up one after the other; `level` is the
    words per weight left to those from here on. The first source whose limit lies
    above the level ends the full ones.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")
    per = counts.groupBy("source").agg(F.sum("words").alias("source_size"))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), pick))
    per = per.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    ahead = F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    behind = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    per = per.withColumn("level", (total - ahead) / behind)
    per = per.withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy())
    per = per.withColumn("open_level", level)
    return per.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("open_level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS, seed: int = SEED) -> DataFrame:
    """(doc_id, row_hash, size, source_size, target, copies, taken), one row for each row of docs.

    A rank within a source is the count of the buckets before (source, size class,
    slice) plus the row number within the bucket; buckets are few, so no source is
    ever sorted as a whole.
    """
    sized = docs.select("doc_id", "source", word_count().alias("size"), row_hash(seed).alias("row_hash"))
    bits = F.length(F.bin("size"))
    # The highest bit and the next three: sizes of one class lie within an eighth of each other.
    top = F.when(F.col("size") < 16, F.col("size")).otherwise(bits.cast("long") * 16 + F.expr("shiftright(size, length(bin(size)) - 4)"))
    # Written once: counts, targets and ranks read it, and not the texts again.
    sized = Scratch(docs.sparkSession, "mix").save(sized.withColumn("bucket", top * SLICES + F.col("row_hash") % SLICES), "sized")
    counts = sized.groupBy("source", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    targets = source_targets(counts, share, cap, weights)
    offset = hash_long(F.lit(f"{seed}|offset"), F.coalesce(F.concat(F.lit("s"), F.col("s")), F.lit("null"))) / F.lit(float(1 << 60))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = buckets.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("s", F.col("bucket").alias("b"), "ahead", "source_size", "target", rate.alias("rate"), offset.alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("size", "row_hash", "doc_id")
    ranked = sized.withColumn("rank", F.row_number().over(inside))
    joined = ranked.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    crossed = lambda n: F.floor(n * F.col("rate") + F.col("offset"))
    last = F.col("ahead") + F.col("rank")
    copies = F.least(crossed(last) - crossed(last - 1), F.lit(math.ceil(cap)).cast("long"))
    return joined.select("doc_id", "row_hash", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeat(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows themselves, with all columns of docs, each as many times as it is taken."""
    seed = options.get("seed", SEED)
    same = Window.partitionBy("id", "hash").orderBy("copies")
    taken = mix(docs, **options).select(F.col("doc_id").alias("id"), F.col("row_hash").alias("hash"), "copies").withColumn("nth", F.row_number().over(same)).where("copies > 0")
    again = Window.partitionBy("doc_id", "row_hash").orderBy("doc_id")
    rows = packed(docs, doc_id=F.col("doc_id"), row_hash=row_hash(seed)).withColumn("row_nth", F.row_number().over(again))
    kept = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("hash")) & (F.col("row_nth") == F.col("nth")))
    return unpacked(kept.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), docs.columns)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(md5(text), 'null')), 1, 15))::BIGINT AS h
  FROM documents),
bucketed AS (
  SELECT *, (CASE WHEN size < 16 THEN size ELSE length(bin(size)) * 16 + (size >> (length(bin(size)) - 4)::BIGINT) END) * 16 + h % 16 AS bucket FROM sized),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per),
opened AS (
  SELECT *, max(CASE WHEN source_size * 2.0::DOUBLE > level * weight THEN level END) OVER () AS open_level FROM levels),
targets AS (
  SELECT source, source_size,
         CASE WHEN source_size * 2.0::DOUBLE <= level * weight THEN source_size * 2.0::DOUBLE ELSE open_level * weight END AS target,
         ('0x' || substr(md5('7|offset|' || coalesce('s' || source, 'null')), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS u
  FROM opened),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY bucket, size, h, doc_id) AS rank FROM bucketed),
taken AS (
  SELECT r.doc_id, r.size, t.source_size, t.target,
         least(floor(r.rank * (CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END) + t.u)
             - floor((r.rank - 1) * (CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END) + t.u), 2)::BIGINT AS copies
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, copies * size AS taken FROM taken
"""
