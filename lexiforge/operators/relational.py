"""Look-ups, semi and anti joins, range joins and set comparison over tables of articles and terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_counts(rows: DataFrame, key: str, k: int, name: str = "n") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias(name)).orderBy(F.desc(name), key).limit(k)


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_from(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is not in `done`: the work left to do."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def first_match(rows: DataFrame, others: DataFrame, on: Column, key: str, order: list) -> DataFrame:
    """Each row with its first partner by a total order, or nulls."""
    best = Window.partitionBy(key).orderBy(*order)
    return rows.join(others, on, "left").withColumn("_nth", F.row_number().over(best)).where("_nth = 1").drop("_nth")


def range_locate(points: DataFrame, ranges: DataFrame, block: str, value: str, low: str, high: str) -> DataFrame:
    """Points with the range of the same block that holds them; the block is an equi-join key, so no loop join."""
    return points.join(ranges, block).where(F.col(value).between(F.col(low), F.col(high)))


def with_fallback(rows: DataFrame, table: DataFrame, first: str, second: str, key: str, value: str) -> DataFrame:
    """rows with table's value for the key `first`, or else for the key `second`, or null."""
    one = table.select(F.col(key).alias("_k1"), F.col(value).alias("_v1"))
    two = table.select(F.col(key).alias("_k2"), F.col(value).alias("_v2"))
    joined = rows.join(one, F.col(first) == F.col("_k1"), "left").join(two, F.col(second) == F.col("_k2"), "left")
    return joined.withColumn(value, F.coalesce("_v1", "_v2")).drop("_k1", "_k2", "_v1", "_v2")


def set_compare(left: DataFrame, right: DataFrame, key: str, count: str = "n") -> DataFrame:
    """(key, n_left, n_right, side): one full outer join tells intersection, differences and union."""
    joined = left.select(key, F.col(count).alias("n_left")).join(right.select(key, F.col(count).alias("n_right")), key, "full")
    side = F.when(F.col("n_right").isNull(), "left").when(F.col("n_left").isNull(), "right").otherwise("both")
    return joined.select(key, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"), side.alias("side"))


def relative_scores(compared: DataFrame) -> DataFrame:
    """Terms of both sides with the sum of their shares, taken over the intersection."""
    both = compared.where("side = 'both'")
    totals = both.agg(F.sum("n_left").alias("all_left"), F.sum("n_right").alias("all_right"))
    return both.crossJoin(F.broadcast(totals)).withColumn("score", F.col("n_left") / F.col("all_left") + F.col("n_right") / F.col("all_right")).drop("all_left", "all_right")


def agreement(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of keys in both, only left, only right."""
    joined = left.select(*keys, F.lit(1).alias("l")).join(right.select(*keys, F.lit(1).alias("r")), keys, "full")
    return joined.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_both"), F.count_if(F.col("r").isNull()).alias("n_left"), F.count_if(F.col("l").isNull()).alias("n_right"))
