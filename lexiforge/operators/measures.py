"""Histograms, calendars, category statistics and classification measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equal_width_histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, low, high, n): right-closed bins of equal width from least to greatest; empty ones too."""
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends))
    counted = placed.groupBy(F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((F.col(value) - F.col("lo")) / width))).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    frame = ends.select(F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "lo", "hi")
    out = frame.join(counted, "bin", "left")
    return out.select("bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("low"), (F.col("lo") + F.col("bin") * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def resample_months(rows: DataFrame, when: str, value: str, months: int) -> DataFrame:
    """(period, total): sums over runs of months from the first one on; runs without rows are 0."""
    index = (F.year(when) * 12 + F.month(when)).cast("int")
    marked = rows.select(index.alias("m"), F.col(value).alias("v"))
    ends = marked.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    sums = marked.crossJoin(F.broadcast(ends)).groupBy(F.floor((F.col("m") - F.col("lo")) / months).cast("int").alias("period")).agg(F.sum("v").alias("total"))
    frame = ends.select(F.explode(F.sequence(F.lit(0), F.floor((F.col("hi") - F.col("lo")) / months).cast("int"))).alias("period"))
    return frame.join(sums, "period", "left").select("period", F.coalesce("total", F.lit(0.0)).alias("total"))


def category_counts(rows: DataFrame, term: str, category: str) -> DataFrame:
    return rows.groupBy(term, category).agg(F.count("*").alias("n"))


def kl_contributions(counts: DataFrame, baseline: DataFrame, term: str, category: str) -> DataFrame:
    """(term, category, p, q, kl): p ln(p / q) of a term's share in each category against the baseline; 0 where p is 0.

    Only categories a term has are joined; those with p = 0 add nothing to the sum.
    """
    total = F.sum("n").over(Window.partitionBy(term))
    base_total = baseline.agg(F.sum("n").alias("base_all"))
    base = baseline.select(category, F.col("n").alias("base_n")).crossJoin(F.broadcast(base_total))
    joined = counts.withColumn("p", F.col("n") / total).join(base, category).withColumn("q", F.col("base_n") / F.col("base_all"))
    return joined.select(term, category, "n", "p", "q", (F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"), (F.col("p") / F.col("q")).alias("lift"))


def argmax_category(contributions: DataFrame, term: str, category: str, least: int, k: int, ascending: bool = True, digits: int | None = None) -> DataFrame:
    """Terms with at least `least` uses: their total, divergence and leading category, the first k by divergence."""
    best = F.max_by(category, F.struct("kl", category))
    per = contributions.groupBy(term).agg(F.sum("n").alias("total"), F.sum("kl").alias("divergence"), best.alias("top_category"))
    if digits is not None:
        per = per.withColumn("divergence", F.round("divergence", digits))
    divergence = F.col("divergence").asc() if ascending else F.col("divergence").desc()
    return per.where(F.col("total") >= least).orderBy(divergence, term).limit(k)


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two 0/1 raters."""
    sums = rows.agg(F.count("*").alias("n"), F.sum((F.col(a) == F.col(b)).cast("int")).alias("same"), F.sum(a).alias("a1"), F.sum(b).alias("b1"))
    po = F.col("same") / F.col("n")
    pe = (F.col("a1") * F.col("b1") + (F.col("n") - F.col("a1")) * (F.col("n") - F.col("b1"))) / (F.col("n") * F.col("n"))
    return sums.select("n", po.alias("observed"), pe.alias("expected"), ((po - pe) / (1 - pe)).alias("kappa"))


def best_cutoff(rows: DataFrame, score: str, label: str, first: int = 10, last: int = 90) -> DataFrame:
    """The least hundredth above which predicting 1 has the highest F1, from one pass over a histogram of scores."""
    binned = rows.groupBy(F.least(F.lit(last + 1), F.ceil(F.col(score) * 100).cast("int")).alias("b")).agg(F.sum(label).alias("pos"), F.count("*").alias("n"))
    cuts = rows.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("cut"))
    totals = binned.agg(F.sum("pos").alias("all_pos"))
    tried = F.broadcast(cuts).join(binned, F.col("b") > F.col("cut"), "left").groupBy("cut").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("called"))
    f1 = 2 * F.col("tp") / (F.col("called") + F.col("all_pos"))
    return tried.crossJoin(F.broadcast(totals)).select(F.col("cut") / 100.0, "cut", f1.alias("f1")).groupBy().agg(F.max_by(F.col("cut"), F.struct("f1", -F.col("cut"))).alias("cutoff"), F.max("f1").alias("f1"))


def class_report(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(class, precision, recall, f1, support); a ratio without cases is 0."""
    cells = rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    both = cells.select(F.explode(F.array(F.struct(F.col(truth).alias("class"), F.col("n").alias("s"), F.lit(0).cast("long").alias("c")), F.struct(F.col(predicted).alias("class"), F.lit(0).cast("long").alias("s"), F.col("n").alias("c")))).alias("x"), F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("hit"))
    per = both.groupBy("x.class").agg(F.sum("x.s").alias("support"), F.sum("x.c").alias("called"), (F.sum("hit") / 2).alias("tp"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return per.select("class", ratio(F.col("tp"), F.col("called")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("called") + F.col("support")).alias("f1"), "support")


def report_averages(report: DataFrame) -> DataFrame:
    """(average, precision, recall, f1, support) of a class report: macro, weighted, and micro, which is the accuracy where every row has one class."""
    support = F.col("support")
    kinds = {"macro": lambda c: F.avg(c), "weighted": lambda c: F.sum(F.col(c) * support) / F.sum(support), "micro": lambda c: F.sum(F.col("recall") * support) / F.sum(support)}
    measures = ("precision", "recall", "f1")
    wide = report.agg(F.sum("support").alias("support"), *[of(c).alias(f"{k}_{c}") for k, of in kinds.items() for c in measures])
    rows = F.array(*[F.struct(F.lit(k).alias("average"), *[F.col(f"{k}_{c}").alias(c) for c in measures]) for k in kinds])
    return wide.select("support", F.explode(rows).alias("r")).select("r.*", "support")


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(100.0 * part / whole, digits)
