"""Operator 5: SimHash near-dedup by Golay-code fuzzy hashing.

Fingerprints of 64 bits come from XXH64 values of 3-word shingles. To find those that
differ in at most two bits, a fingerprint is cut in three segments. Two errors leave
one segment whole (pigeonhole) and put at most two into the next. The perfect
(23, 12) Golay code maps every 23-bit word within one bit of a segment to the index of
its codeword: one or six indices, and two segments that differ in at most two bits
share one, that of a word between them. A key is a whole segment with an index of the
segment after it. Fingerprints that share a key are verified by their differing bits.

A key with many fingerprints isn't expanded into pairs: there all words within
one bit of a fingerprint are made and fingerprints that share one are linked to the
least of them, which links exactly those at two or fewer bits.

Defined cases: null or white text has fingerprint zero, linked like any other;
fewer words than a shingle hash as one; null doc_id counts as larger than others;
repeated rows repeat; an empty table gives an empty result; `deduplicate` keeps the
first row of each group, by (doc_id, text), with all its columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import Scratch, components, packed, text_key, unpacked

SHINGLE = 3
BITS = 2
#: Segments as (shift, width).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: a generator polynomial of the perfect Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Keys with more fingerprints than this are linked through the words between them.
PAIRED = 32

_table: np.ndarray | None = None


def golay_table() -> np.ndarray:
    """Index of the nearest codeword of every 23-bit word; all lie within three bits of one."""
    global _table
    if _table is None:
        code = np.zeros(4096, np.int64)
        for bit in range(12):
            code[(np.arange(4096) >> bit & 1) == 1] ^= GENERATOR << bit
        one = [1 << i for i in range(23)]
        errors = [0, *one, *(a | b for i, a in enumerate(one) for b in one[:i]), *(a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j])]
        table = np.zeros(1 << 23, np.int16)
        index = np.arange(4096, dtype=np.int16)
        for error in errors:
            table[code ^ error] = index
        _table = table
    return _table


def fuzzy_indices(words: np.ndarray) -> np.ndarray:
    """Codeword indices of all 24 words within one bit of each, shape (24, n)."""
    table = golay_table()
    return np.stack([table[words], *(table[words ^ (1 << i)] for i in range(23))])


def fingerprint_of(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return h64(b" ".join(words), 42)
    join = b" ".join
    hashes = np.array([h64(join(s), 42) for s in zip(words, words[1:], words[2:])], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` of docs and fp, the fingerprint as a signed long."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = np.array([fingerprint_of(t) for t in batch.column("_text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], names=[*keep, "fp"])

    shown = docs.select(*keep, F.col("text").alias("_text"))
    return shown.mapInArrow(batches, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shown.schema.fields[:-1]) + ", fp long")


def fuzzy_keys(fps: DataFrame) -> DataFrame:
    """(key, fp): several keys for each fingerprint of column fp."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            u = fp.view(np.uint64)
            parts = [(u >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
            keys, owners = [], []
            for i in range(3):
                index = np.sort(fuzzy_indices(parts[(i + 1) % 3]).astype(np.int64), axis=0)
                new = np.vstack([np.ones((1, index.shape[1]), bool), index[1:] != index[:-1]])
                at = np.nonzero(new)
                keys.append((np.int64(i) << 40) | (parts[i][at[1]] << 12) | index[at])
                owners.append(fp[at[1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], names=["key", "fp"])

    return fps.select("fp").mapInArrow(batches, "key long, fp long")


def fingerprint_links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints, which connect all at BITS or fewer differing bits."""
    keys = scratch.save(fuzzy_keys(fps), "keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("src"), F.max("fp").alias("dst")).where("n > 1")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= BITS
    twos = sizes.where("n = 2").where(near("src", "dst")).select("src", "dst")
    some = keys.join(sizes.where(f"n between 3 and {PAIRED}").select("key"), "key")
    pairs = some.join(some.select("key", F.col("fp").alias("dst")), "key").where(F.col("fp") < F.col("dst"))
    pairs = pairs.where(near("fp", "dst")).select(F.col("fp").alias("src"), "dst")
    # In full buckets: one row for each word within a bit, linked to the least fingerprint beside it.
    full = keys.join(sizes.where(f"n > {PAIRED}").select("key"), "key").select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    between = full.select("fp", F.explode(flips).alias("word"))
    least = between.groupBy("word").agg(F.min("fp").alias("src"), F.max("fp").alias("most")).where("src <> most").select("word", "src")
    stars = between.join(least, "word").where("src <> fp").select("src", F.col("fp").alias("dst"))
    return twos.union(pairs).union(stars).distinct()


def fingerprint_roots(fps: DataFrame) -> DataFrame:
    """(node, root) over distinct fingerprints that are linked to another."""
    scratch = Scratch(fps.sparkSession, "simhash")
    distinct = scratch.save(fps.select("fp").distinct(), "fps")
    return components(scratch.save(fingerprint_links(distinct, scratch), "edges"), scratch)


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_key, fp, component_id): one row for each row of docs."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.save(fingerprints(docs.select("doc_id", "text", text_key().alias("doc_key")), "doc_id", "doc_key"), "marked")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = least.join(fingerprint_roots(marked), F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = roots.join(named, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "doc_key", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: the least by (doc_id, text)."""
    grouped = groups(docs)
    # A group's documents meet in partial minima, not in one task.
    first = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "doc_key")).alias("k")).select("k.doc_id", "k.doc_key")
    mine = packed(docs, doc_id=F.col("doc_id"), doc_key=text_key())
    kept = mine.join(first.withColumnsRenamed({"doc_id": "id", "doc_key": "key"}), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("doc_key") == F.col("key")), "left_semi")
    again = Window.partitionBy("doc_id", "doc_key").orderBy("doc_id")
    return unpacked(kept.withColumn("nth", F.row_number().over(again)).where("nth = 1"), docs.columns)


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
