"""Statistics of scores and term lists: ranks, Spearman, cut-offs, match rates, levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(rows: DataFrame, order: str, *sums: str, slices: int = 64) -> DataFrame:
    """rows with `before_x` for each x of `sums`: the sum over all rows that come before in the order.

    Sums per slice of the order come first, slices being ranges of the values; only those
    are summed in one task, and rows within their own slice.
    """
    ends = rows.agg(F.min(order).cast("double").alias("lo"), F.max(order).cast("double").alias("hi"))
    cut = F.least(F.lit(slices - 1), F.floor((F.col(order).cast("double") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * slices)).cast("int")
    placed = rows.crossJoin(F.broadcast(ends)).withColumn("slice", cut).drop("lo", "hi")
    per = placed.groupBy("slice").agg(*[F.sum(c).alias(f"all_{c}") for c in sums])
    ahead = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row a slice
    per = per.select("slice", *[F.coalesce(F.sum(f"all_{c}").over(ahead), F.lit(0)).alias(f"base_{c}") for c in sums])
    within = Window.partitionBy("slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumns({f"in_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums}).join(F.broadcast(per), "slice")
    return out.withColumns({f"before_{c}": F.col(f"base_{c}") + F.col(f"in_{c}") for c in sums}).drop("slice", *[f"{k}_{c}" for k in ("in", "base") for c in sums])


def mean_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows with the rank of a value, equal values sharing their mean rank: by counts of values."""
    per = offsets(rows.groupBy(value).agg(F.count("*").alias("n")), value, "n")
    return rows.join(per.select(value, (F.col("before_n") + (F.col("n") + 1) / 2).alias(name)), value)


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the correlation of the ranks of two columns."""
    ranked = mean_ranks(mean_ranks(rows.select(a, b), a, "ra"), b, "rb")
    return ranked.agg(F.corr("ra", "rb").alias("spearman"), F.count("*").alias("n"))


def over_mean_accuracy(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One row: how often a score over the mean of all goes with label 1."""
    mean = rows.agg(F.avg(score).alias("mean"))
    return rows.crossJoin(F.broadcast(mean)).agg(F.max("mean").alias("mean"), F.avg(((F.col(score) > F.col("mean")) == (F.col(label) == 1)).cast("double")).alias("accuracy"))


def match_rates(one: Column, other: Column) -> dict[str, Column]:
    """Whether two lists of phrases share a phrase, a first word, a last word, any word; null lists share nothing."""
    words = lambda p: F.filter(F.split(p, r"\s+"), lambda w: w != "")
    forms = {"exact": lambda x: x, "first_word": lambda x: F.transform(x, lambda p: F.get(words(p), F.lit(0))), "last_word": lambda x: F.transform(x, lambda p: F.element_at(words(p), -1)), "any_word": lambda x: F.flatten(F.transform(x, words))}
    return {k: F.coalesce(F.arrays_overlap(f(one), f(other)), F.lit(False)) for k, f in forms.items()}


def mode_of_first(rows: DataFrame, group: str, place: str, value: str, skip: int, n: int) -> DataFrame:
    """(group, mode): the commonest value of the n rows behind the first `skip`, ties to the least; null where there are fewer."""
    order = Window.partitionBy(group).orderBy(place)
    some = rows.withColumn("nth", F.row_number().over(order)).where((F.col("nth") > skip) & (F.col("nth") <= skip + n))
    counts = some.groupBy(group, value).agg(F.count("*").alias("c"))
    best = counts.groupBy(group).agg(F.sum("c").alias("all_c"), F.min_by(value, F.struct(-F.col("c"), F.col(value))).alias("mode"))
    return rows.select(group).distinct().join(best, group, "left").select(group, F.when(F.col("all_c") == n, F.col("mode")).alias("mode"))
