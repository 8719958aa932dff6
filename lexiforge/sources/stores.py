"""Tables kept as files: CSV logs, Parquet tables with inserts and deletes, commentary lines, exact contiguous parts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.operators.stored import Rounds


def csv_log(spark: SparkSession, path: str, schema: str, index: str = "_c0") -> DataFrame:
    """The rows of a CSV log without its index column; fields may hold quotes, commas and line ends."""
    return spark.read.csv(path, header=True, schema=f"{index} long, {schema}", multiLine=True, quote='"', escape='"').drop(index)


def append_csv(rows: DataFrame, path: str, index: str = "_c0") -> None:
    """Adds rows to a CSV log as new files; the index counts rows up, with gaps."""
    numbered = rows.select(F.monotonically_increasing_id().alias(index), *rows.columns)
    numbered.write.mode("append").csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, quote='"', escape='"', quoteAll=True, emptyValue="")


def insert_rows(rows: DataFrame, path: str) -> None:
    """Adds rows to a Parquet table, which the first call makes."""
    rows.write.mode("append").parquet(path)


def delete_rows(spark: SparkSession, path: str, condition: Column) -> None:
    """Takes the rows out for which the condition is true; the rest is written whole beside the table and then takes its place."""
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    spark.read.parquet(path).where(~F.coalesce(condition, F.lit(False))).write.parquet(beside)
    at, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, beside))
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(at, True)
    if not files.rename(new, at):
        raise OSError(f"{beside} can't be renamed to {path}")


def write_commentary(rows: DataFrame, notes: str, path: str) -> None:
    """Appends the entries of a map column as lines `key: value`, in order of keys within a row; line ends in values become blanks."""
    entry = F.explode(F.array_sort(F.map_entries(notes))).alias("e")
    lines = rows.select(entry).select(F.concat(F.col("e.key"), F.lit(": "), F.regexp_replace(F.coalesce("e.value", F.lit("")), r"\s*\n\s*", " ")).alias("value"))
    lines.write.mode("append").text(path)


def commentary(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the lines `key: value`."""
    at = F.instr("value", ": ")
    rows = spark.read.text(path).where(at > 0)
    return rows.select(F.substr("value", F.lit(1), at - 1).alias("key"), F.substr("value", at + 2).alias("value"))


def positions(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with `position`, from 0 in the order given, which must tell rows apart: ranges are saved, counted and numbered each on its own, so no task orders all."""
    rounds = Rounds(rows.sparkSession, "positions")
    ranged = rounds.save(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_nth", nth).join(F.broadcast(starts), "_range").withColumn("position", F.col("_start") + F.col("_nth") - 1).drop("_range", "_nth", "_start")


def exact_parts(rows: DataFrame, parts: int, *order: str) -> DataFrame:
    """The rows with `part`, names 0 to parts - 1 padded by zeros: contiguous parts of count div parts rows, of which the last takes the remainder."""
    placed = positions(rows, *order)
    each = max(1, placed.count() // parts)
    part = F.least(F.col("position") / each, F.lit(parts - 1)).cast("long")
    return placed.withColumn("part", F.lpad(part.cast("string"), len(str(parts - 1)), "0"))


def write_exact_parts(rows: DataFrame, path: str, parts: int, *order: str) -> None:
    """Writes the exact parts as folders part=...; each is dealt to one task."""
    placed = exact_parts(rows, parts, *order)
    placed.repartition("part").sortWithinPartitions("part", "position").write.mode("overwrite").partitionBy("part").json(path)
