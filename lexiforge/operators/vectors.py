"""Dense vectors: cosine neighbours, analogies, centroids, concentration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.operators.stored import Rounds

#: Rows and queries of a block; a task holds a block of both and the best of each query.
ROWS, ASKED = 2048, 512


def blocks(rows: DataFrame, names: tuple[str, str, str], key: str, vec: str, other: str | None = None) -> DataFrame:
    """A row for each block of up to ROWS rows of one vector length: `names` for ids, vectors and other numbers as bytes, and `size`, the length.

    Keys and other numbers are longs; a key or vector that is null, or a vector that holds one, is left out.
    """
    most = ROWS if names[0] == "ids" else ASKED
    used = rows.where(F.col(key).isNotNull() & F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull()))
    used = used.select(F.col(key).cast("long").alias("k"), F.col(vec).cast("array<double>").alias("v"), (F.col(other) if other else F.lit(0)).cast("long").alias("o"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(size: int) -> pa.RecordBatch:
            ids, vecs, others = (np.concatenate(c) for c in zip(*held.pop(size)))
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, vecs, others)] + [pa.array([size], pa.int32())], names=[*names, "size"])

        for batch in batches:
            ids, vecs, others = (batch.column(i) for i in range(3))
            sizes = vecs.value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for begin in range(0, len(at), most):
                    some = pa.array(at[begin : begin + most])
                    held.setdefault(int(size), []).append((ids.take(some).to_numpy(zero_copy_only=False), vecs.take(some).flatten().to_numpy(zero_copy_only=False), others.take(some).to_numpy(zero_copy_only=False)))
                    if sum(len(h[0]) for h in held[int(size)]) >= most:
                        yield out(int(size))
        for size in list(held):
            yield out(size)

    return used.mapInArrow(packed, ", ".join(f"{n} binary" for n in names) + ", size int")


def nearest(rows: DataFrame, key: str, vec: str, queries: DataFrame, k: int, rough: Callable, exact: Callable, slack: float, other: str | None = None) -> DataFrame:
    """(query, key, other, cost): of each task's rows the k of least cost for each query (query, q), equal costs by key.

    rough(q, v) gives a matrix of costs for a block of queries and one of rows, right to `slack`; exact(q, v) that of
    each two rows of q and v, and decides among all whose rough cost may be one of the k least. Every pair is met.
    """
    asked = Rounds(rows.sparkSession, "asked").save(blocks(queries, ("asked", "qs", "none"), "query", "q").withColumnRenamed("size", "n").drop("none"))
    pairs = blocks(rows, ("ids", "vecs", "others"), key, vec, other).crossJoin(asked).where("size = n").drop("n")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, tuple] = {}
        for batch in batches:
            for ids, vecs, others, size, asked, qs in zip(*(batch.column(c) for c in ("ids", "vecs", "others", "size", "asked", "qs"))):
                mark = asked.as_py(), size.as_py()
                q, v = (np.frombuffer(x.as_py(), float).reshape(-1, mark[1]) for x in (qs, vecs))
                with np.errstate(all="ignore"):
                    some = rough(q, v)
                    some[np.isnan(some)] = -np.inf  # left to the exact cost
                    if len(v) > k:
                        at_most = np.partition(np.where(np.isinf(some), np.inf, some), k - 1, axis=1)[:, k - 1 : k]
                        row, at = np.nonzero(some <= at_most + slack)
                    else:
                        row, at = np.nonzero(some <= np.inf)
                    far = exact(q[row], v[at])
                found = row, np.frombuffer(ids.as_py(), np.int64)[at], np.frombuffer(others.as_py(), np.int64)[at], far
                if mark in kept:
                    found = tuple(np.concatenate(c) for c in zip(kept[mark], found))
                order = np.lexsort((found[1], found[3], found[0]))
                found = tuple(c[order] for c in found)
                near = np.arange(len(order)) - np.searchsorted(found[0], found[0]) < k
                kept[mark] = tuple(c[near] for c in found)
        for (names, _), (row, ids, extra, far) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(names, np.int64)[row]), pa.array(ids), pa.array(extra), pa.array(far)], names=["query", key, "other", "cost"])

    return pairs.mapInArrow(best, f"query long, `{key}` long, other long, cost double")


def in_order(terms: np.ndarray) -> np.ndarray:
    """Sums of each row, place by place, as those of a plain loop."""
    out = np.zeros(len(terms))
    for i in range(terms.shape[1]):
        out += terms[:, i]
    return out


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded with halves away from zero, as Spark rounds."""
    return np.sign(x) * np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine_neighbours(rows: DataFrame, key: str, vec: str, queries: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """(query, key, score, rank): the k rows nearest to each query by cosine, itself included.

    `queries` (query, q) is a stated set that meets the rows in blocks. Ties, of rounded scores if
    `digits` is given, go to the least key. Each task keeps k rows of a query before they meet.
    Keys are longs. Pairs without a number as their cosine have no score.
    """

    def rough(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        return -(q @ v.T) / np.sqrt((q * q).sum(axis=1))[:, None] / np.sqrt((v * v).sum(axis=1))[None, :]

    def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        score = in_order(v * q) / (np.sqrt(in_order(v * v)) * np.sqrt(in_order(q * q)))
        return -(score if digits is None else half_up(score, digits))

    slack = 1e-9 + (0 if digits is None else 10.0**-digits)
    types = rows.schema[key].dataType, queries.schema["query"].dataType
    scored = nearest(rows, key, vec, queries, k, rough, exact, slack).where("not isnan(cost)")
    scored = scored.select(F.col("query").cast(types[1]).alias("query"), F.col(key).cast(types[0]).alias(key), (-F.col("cost")).alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def centroids(rows: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, dim, mean)."""
    return rows.select(group, F.posexplode(vec).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def concentration(vec) -> Column:
    """Euclidean norm of the vector scaled to absolute sum 1."""
    total = F.aggregate(vec, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    return norm(vec) / total
