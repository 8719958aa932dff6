"""Vectors of products of Poincaré discs as Gaussians, and the scores that tell the general word of a pair from the special one.

A vector of 2k numbers is k points of the unit disc, a column of array<struct<x, y>>. All maps are column expressions;
only means of chosen rows are aggregates, two numbers for each disc.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points this near the rim are where the disc ends in double precision.
RIM = 1 - 1e-12
_TINY = 1e-10


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def points(vec: Column) -> Column:
    """The points of a vector; a number left over goes, null stays null."""
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(vec) - 2, F.lit(0))), lambda i: (i % 2 == 0) & (i + 1 < F.size(vec)))
    return F.when(vec.isNotNull(), F.transform(at, lambda i: _point(vec[i].cast("double"), vec[i + 1].cast("double"))))


def flat(some: Column) -> Column:
    """The vector of points."""
    return F.flatten(F.transform(some, lambda p: F.array(p["x"], p["y"])))


def _each(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, f)


def _sum(some: Column) -> Column:
    return F.aggregate(some, F.lit(0.0), lambda s, x: s + x)


def mobius_scale(some: Column, r: float) -> Column:
    """r times each point, along its geodesic through the centre; the centre stays."""

    def one(p: Column) -> Column:
        norm = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"])
        by = F.when(norm == 0, 1.0).otherwise(F.tanh(r * F.atanh(F.least(norm, F.lit(RIM)))) / norm)
        return _point(p["x"] * by, p["y"] * by)

    return F.transform(some, one)


def mobius_add(some: Column, more: Column) -> Column:
    """Each point moved by the one of `more`; the order matters."""

    def one(a: Column, b: Column) -> Column:
        ab, aa, bb = a["x"] * b["x"] + a["y"] * b["y"], a["x"] * a["x"] + a["y"] * a["y"], b["x"] * b["x"] + b["y"] * b["y"]
        below, left, right = 1 + 2 * ab + aa * bb, 1 + 2 * ab + bb, 1 - aa
        return _point((left * a["x"] + right * b["x"]) / below, (left * a["y"] + right * b["y"]) / below)

    return _each(some, more, one)


def negative(some: Column) -> Column:
    return F.transform(some, lambda p: _point(-p["x"], -p["y"]))


def rotate(some: Column, turns: Column) -> Column:
    """Each point turned by the angle whose sine and cosine are x and y of `turns`."""
    return _each(some, turns, lambda p, t: _point(t["y"] * p["x"] - t["x"] * p["y"], t["x"] * p["x"] + t["y"] * p["y"]))


def half_plane(some: Column) -> Column:
    """The isometry of discs to upper half-planes."""

    def one(p: Column) -> Column:
        below = p["x"] * p["x"] + (1 - p["y"]) * (1 - p["y"])
        return _point(2 * p["x"] / below, (1 - p["x"] * p["x"] - p["y"] * p["y"]) / below)

    return F.transform(some, one)


def _means(rows: DataFrame, some: str) -> DataFrame:
    """One row: the mean of each disc's points, an empty list for no rows."""
    per = rows.select(F.posexplode(some).alias("at", "p")).groupBy("at").agg(F.avg("p.x").alias("x"), F.avg("p.y").alias("y"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "x", "y")))
    return per.agg(F.transform(ordered, lambda m: _point(m["x"], m["y"])).alias("mean"))


def gaussians(rows: DataFrame, key: str, vec: str, general: Column, special: Column, scale: float = 1.0) -> DataFrame:
    """(key, g): a Gaussian for each disc, x its mean and y its deviation.

    `general` and `special` choose words from both ends of the hierarchy: their Euclidean mean
    becomes the centre, and discs are turned so that the general ones lie at the top. Rows of
    null and empty vectors go; a disc whose general words have their mean in the centre is not turned.
    Without chosen rows there is no centre and no row.
    """
    made = rows.select(key, mobius_scale(points(F.col(vec)), scale).alias("p"), F.coalesce(general, F.lit(False)).alias("top"), F.coalesce(general | special, F.lit(False)).alias("end")).where("size(p) > 0")
    # Two one-row tables, of two numbers for each disc, meet all rows.
    centred = made.join(F.broadcast(_means(made.where("end"), "p")), F.size("mean") == F.size("p")).select(key, "top", mobius_add(negative(F.col("mean")), F.col("p")).alias("p"))

    def unit(p: Column) -> Column:
        norm = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"])
        return F.when(norm == 0, _point(F.lit(0.0), F.lit(1.0))).otherwise(_point(p["x"] / norm, p["y"] / norm))

    turns = _means(centred.where("top"), "p").select(F.transform("mean", unit).alias("turns"))
    turned = centred.join(F.broadcast(turns), F.size("turns") == F.size("p")).select(key, half_plane(rotate(F.col("p"), F.col("turns"))).alias("p"))
    return turned.select(key, F.transform("p", lambda p: _point(p["x"] / F.sqrt(F.lit(2.0)), p["y"])).alias("g"))


def negative_kl(a: Column, b: Column) -> Column:
    """Minus the divergence of b's Gaussians from a's."""
    return -_sum(_each(a, b, lambda v, w: 0.5 * (2 * F.ln(w["y"] / v["y"]) + (v["y"] / w["y"]) * (v["y"] / w["y"]) + (v["x"] - w["x"]) * (v["x"] - w["x"]) / (w["y"] * w["y"]) - 1)))


def fisher(a: Column, b: Column) -> Column:
    """Distance of a and b in the product of half-planes."""

    def squared(v: Column, w: Column) -> Column:
        dx, dy = v["x"] - w["x"], v["y"] - w["y"]
        d = F.acosh(1 + (dx * dx + dy * dy) / (2 * v["y"] * w["y"]))
        return d * d

    return F.sqrt(_sum(_each(a, b, squared))) * F.sqrt(F.lit(2.0))


def mean_cosine(a: Column, b: Column) -> Column:
    """Products of means over the sum of their sizes."""
    return _sum(_each(a, b, lambda v, w: v["x"] * w["x"] / (F.abs(v["x"]) + F.abs(w["x"]) + _TINY)))


def log_volume(a: Column, sigma: float = 1.0) -> Column:
    """Logarithm of the volume of the box of `sigma` deviations round the means."""
    return _sum(F.transform(a, lambda v: F.ln(2 * sigma * v["y"])))


def log_overlap(a: Column, b: Column, sigma: float = 1.0) -> Column:
    """Logarithm of the volume that the boxes of a and b share."""

    def shared(v: Column, w: Column) -> Column:
        low = F.greatest(v["x"] - sigma * v["y"], w["x"] - sigma * w["y"])
        return F.greatest(F.lit(0.0), F.least(v["x"] + sigma * v["y"], w["x"] + sigma * w["y"]) - low)

    return F.ln(_TINY + F.aggregate(_each(a, b, shared), F.lit(1.0), lambda s, x: s * x))


def is_a(a: Column, b: Column, sigma: float = 1.0) -> Column:
    """How much more general b is than a."""
    return log_volume(b, sigma) - log_volume(a, sigma)


def distance_score(a: Column, b: Column, alpha: float = 1000.0, sigma: float = 1.0) -> Column:
    """Minus the distance, weighted by how much more general a is."""
    return -(1 + alpha * (log_volume(a, sigma) - log_volume(b, sigma))) * fisher(a, b)
