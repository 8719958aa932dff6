"""Differences of two lists of paragraphs of a document, by a longest common subsequence of their hashes.

Both lists of a document meet in one task; the search keeps two rows of its table (Hirschberg's division), so memory
is linear in the paragraphs of the longest document, and equal beginnings, ends and paragraphs of one side only cost no time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of a with each beginning of b."""
    row = np.zeros(len(b) + 1, dtype=np.int32)
    for x in a:
        row[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        np.maximum.accumulate(row, out=row)
    return row


def common(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, ascending."""
    found, ahead = [], [(np.arange(len(a)), np.arange(len(b)))]
    while ahead:
        i, j = ahead.pop()
        n = min(len(i), len(j))
        differ = np.flatnonzero(a[i[:n]] != b[j[:n]])
        k = int(differ[0]) if len(differ) else n
        found += zip(i[:k].tolist(), j[:k].tolist())
        i, j = i[k:], j[k:]
        n = min(len(i), len(j))
        differ = np.flatnonzero(a[i[len(i) - n :]] != b[j[len(j) - n :]])
        k = n - 1 - int(differ[-1]) if len(differ) else n
        found += zip(i[len(i) - k :].tolist(), j[len(j) - k :].tolist())
        i, j = i[: len(i) - k], j[: len(j) - k]
        i, j = i[np.isin(a[i], b[j])], j[np.isin(b[j], a[i])]
        if len(i) == 0:
            continue
        if len(i) == 1:
            found.append((int(i[0]), int(j[np.flatnonzero(b[j] == a[i[0]])[0]])))
            continue
        half = len(i) // 2
        cut = int(np.argmax(_lengths(a[i[:half]], b[j]) + _lengths(a[i[half:]][::-1], b[j][::-1])[::-1]))
        ahead += [(i[:half], j[:cut]), (i[half:], j[cut:])]
    return sorted(found)


def aligned(a: np.ndarray, b: np.ndarray) -> list[tuple[int | None, int | None]]:
    """Every place of both lists once, in order: common ones together, those between them in pairs as far as both sides have some."""
    out, x, y = [], 0, 0
    for i, j in [*common(a, b), (len(a), len(b))]:
        gap = max(i - x, j - y)
        out += [(x + k if x + k < i else None, y + k if y + k < j else None) for k in range(gap)]
        if i < len(a):
            out.append((i, j))
        x, y = i + 1, j + 1
    return out


def _pairs(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([[{"l": i, "r": j} for i, j in aligned(np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64))] for a, b in zip(left, right)], dtype=object)


def paragraph_diff(left: DataFrame, right: DataFrame, key: str, place: str, text: str) -> DataFrame:
    """(key, op, left_at, right_at, left_text, right_text) of both lists' paragraphs, counted from 0 in the order of `place`: op is same, changed, gone (left only) or new (right only).

    As many paragraphs are the same as can be. Null texts equal each other; documents of a null key are one; a document of one side is all gone or all new.
    """
    part = lambda rows, side: rows.select(F.col(key).alias("key"), F.lit(side).alias("side"), F.struct(F.col(place).cast("long").alias("at"), F.col(text).cast("string").alias("text")).alias("p"))
    listed = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("p"))))
    both = part(left, 0).unionByName(part(right, 1)).groupBy("key").agg(listed(0).alias("l"), listed(1).alias("r"))
    hashes = lambda c: F.transform(c, lambda p: F.xxhash64(p["text"]))
    paired = both.withColumn("pairs", F.pandas_udf(_pairs, "array<struct<l:int,r:int>>")(hashes("l"), hashes("r")))
    full = lambda p: F.struct(p["l"].alias("l"), p["r"].alias("r"), F.get("l", p["l"])["text"].alias("a"), F.get("r", p["r"])["text"].alias("b"))
    rows = paired.select("key", F.explode(F.transform("pairs", full)).alias("x"))
    op = F.when(F.col("x.r").isNull(), "gone").when(F.col("x.l").isNull(), "new").when(F.col("x.a").eqNullSafe(F.col("x.b")), "same").otherwise("changed")
    return rows.select(F.col("key").alias(key), op.alias("op"), F.col("x.l").alias("left_at"), F.col("x.r").alias("right_at"), F.col("x.a").alias("left_text"), F.col("x.b").alias("right_text"))
