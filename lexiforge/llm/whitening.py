"""Operator 13: embedding whitening on Spark MLlib's RowMatrix.

Vectors become whole numbers, so sums and centring are exact: row x of the fit list (each
distinct vector once) is centred as (n x - S) / n, with S the sums of its dimensions, and only then
multiplied. RowMatrix.computeGramianMatrix adds up the outer products over all executors; divided by n it is
the covariance, whose eigenvectors are found on the driver (dimensions squared, at most
MAX_DIM). Means and scaled components are broadcast, and rows are whitened in pandas batches. A second
Gramian, of the whitened fit list, shows how far its covariance is from the identity.

Defined cases: vectors that are null, empty or hold null or non-finite entries have no row; rows
that repeat stay and count once in the fit; vectors of each length are a space of their own, fitted by
itself; null vec_id is kept; components without variance (an eigenvalue within rounding of
zero) are left out, so one distinct vector gives no row; 64 times an entry beyond 2^40 counts as 2^40; deviation
is null where it exceeds a long; an empty table gives an empty result; extra columns stay out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import Scratch

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Largest 64-fold entry, and most dimensions: the driver holds their square.
LIMIT, MAX_DIM = float(1 << 40), 4096
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, x): the vectors that take part, as whole numbers."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size("embedding") > 0)
    x = F.transform("embedding", lambda v: F.floor(F.least(F.greatest(v.cast("double") * SCALE, F.lit(-LIMIT)), F.lit(LIMIT))).cast("long") + SHIFT)
    return rows.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def gramian(vectors: DataFrame, column: Column) -> np.ndarray:
    """The sum of the outer products of an array column, by RowMatrix."""
    rows = MLUtils.convertVectorColumnsFromML(vectors.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(rows).computeGramianMatrix().toArray()


def centred(sums: list[int], n: int) -> Column:
    """(n x - S) / n of column x, whole numbers up to the division."""
    return F.transform("x", lambda v, i: (v * n - F.get(F.lit(sums), i)) / F.lit(float(n)))


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors as columns, of those with variance."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    fine = values > max(values[0], 0.0) * len(values) * 1e-13
    return values[fine][:most], vectors[:, fine][:, :most]


def whiten(rows: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """As SCHEMA: the first `most` whitened components of each row (vec_id, embedding)."""
    session, scratch = rows.sparkSession, Scratch(rows.sparkSession, "whiten")
    x = scratch.save(whole_vectors(rows), "x")
    lengths = [r[0] for r in x.select(F.size("x")).distinct().orderBy(F.size("x")).collect()]
    out = session.createDataFrame([], SCHEMA)
    for length in lengths:
        if length > MAX_DIM:
            raise ValueError(f"vectors of {length} entries: at most {MAX_DIM} can be whitened")
        space = x.where(F.size("x") == length)
        fit = scratch.save(space.select("x").distinct(), f"fit{length}")
        sums = {r.i: (r.n, r.s) for r in fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}
        n, totals = sums[0][0], [sums[i][1] for i in range(length)]
        if n == 1:
            continue
        covariance = gramian(fit, centred(totals, n)) / n
        values, vectors = components(covariance, most)
        scaled = vectors / np.sqrt(values)
        explained = values / np.trace(covariance)
        shared = session.sparkContext.broadcast((np.array(totals, np.int64), scaled, explained))

        def arrays(batch: pd.DataFrame, n=n, shared=shared) -> tuple[np.ndarray, np.ndarray]:
            away = np.stack(batch["x"].to_numpy()).astype(np.int64) * n - shared.value[0]
            return away, (away / n) @ shared.value[1]

        def of_fit(batches: Iterator[pd.DataFrame], arrays=arrays) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield pd.DataFrame({"w": list(arrays(batch)[1])})

        whitened = scratch.save(fit.mapInPandas(of_fit, "w array<double>"), f"white{length}")
        error = float(np.abs(gramian(whitened, F.col("w")) / n - np.eye(len(values))).max())

        def of_rows(batches: Iterator[pd.DataFrame], n=n, shared=shared, error=error, arrays=arrays) -> Iterator[pd.DataFrame]:
            explained = shared.value[2]
            k = len(explained)
            for batch in batches:
                if not len(batch):
                    continue
                away, white = arrays(batch)
                far = (away.astype(np.float64) ** 2).sum(axis=1) >= 2.0**62
                deviation = [sum(int(v) ** 2 for v in away[i]) if f else int((away[i] ** 2).sum()) for i, f in enumerate(far.tolist())]
                deviation = pd.array([d if d < 1 << 63 else None for d in deviation], dtype="Int64")
                yield pd.DataFrame({
                    "vec_id": batch["vec_id"].astype("Int64").repeat(k).to_numpy(dtype=object, na_value=None), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch)), "n": n,
                    "deviation": deviation.repeat(k), "whitened": white.ravel(), "explained": np.tile(explained, len(batch)), "identity_error": error,
                })

        out = out.union(space.mapInPandas(of_rows, SCHEMA))
    return out


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
