"""Repeatable samples and splits by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fraction(key: Column, seed: str = "") -> Column:
    """A number in [0, 1) from the md5 of a key; the same on any engine and partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def split_label(key: Column, parts: list[tuple[str, float]], seed: str = "") -> Column:
    """The name of the part a key falls into; shares add up to 1."""
    x, upto, out = fraction(key, seed), 0.0, None
    for name, share in parts[:-1]:
        upto += share
        out = F.when(x < upto, name) if out is None else out.when(x < upto, name)
    return out.otherwise(parts[-1][0]) if out is not None else F.lit(parts[-1][0])


def sample_per_group(rows: DataFrame, group: str, key: str, n: int, seed: str = "") -> DataFrame:
    """n rows of each group without replacement; groups with fewer give none."""
    # Groups are counted map-side; then a hash bound leaves a few more than n of each, so no group is ranked as a whole.
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size")).where(F.col("_size") >= n)
    bound = F.when(F.col("_size") <= 50 * n, 1.0).otherwise((n + 10 * F.sqrt(F.lit(float(n))) + 30) / F.col("_size"))
    marked = rows.withColumn("_x", fraction(F.col(key), seed)).join(sizes, group).where(F.col("_x") <= bound)
    nth = F.row_number().over(Window.partitionBy(group).orderBy("_x", key))
    return marked.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_x", "_size", "_nth")
