"""Shared helpers: scratch tables in the shared folder, connected components, text units."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexiforge.operators.stored import shuffles_dropped

#: Words are runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]++"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a plain local master (tests) gets a temporary folder when it is unset.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = getattr(spark.sparkContext, "_lexiforge_shared", None)
        if path is None:
            path = "file://" + tempfile.mkdtemp(prefix="lexiforge-")
            spark.sparkContext._lexiforge_shared = path
    return path.rstrip("/")


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors.

    They go when `release` is called, or with the Python process, for the results that
    operators return read them.
    """

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}
        Scratch.made.append(self)

    def save(self, df: DataFrame, name: str, by: str | None = None, halves: str | None = None) -> DataFrame:
        """The table written and read again; with `by`, stored in buckets of that column, so that joins on it need not move its rows.

        With `halves`, a column of longs, odd rows are worked out and written after the even ones, so that shuffles take half the disk.
        """
        path, table = f"{self.base}/{name}", f"lexiforge_{name}_{uuid.uuid4().hex}"
        for some in [df] if halves is None else [df.where(F.pmod(halves, F.lit(2)) == half) for half in (0, 1)]:
            with shuffles_dropped(self.spark):
                out = some.write.mode("append").option("compression", "zstd")
                if by is None:
                    out.parquet(path)
                else:
                    out.format("parquet").bucketBy(int(self.spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(table)
        if by is None:
            return self.spark.read.schema(df.schema).parquet(path)
        self.tables[name] = table
        return self.spark.table(table)

    def drop(self, name: str | None = None) -> None:
        """Deletes one table, or all."""
        for key in [name] if name else list(self.tables):
            if key in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(key)}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(since: int = 0) -> None:
    """Drops the scratch tables made after the first `since`; results that read them can't be read any more."""
    while len(Scratch.made) > since:
        scratch = Scratch.made.pop()
        if scratch.spark.sparkContext._jsc is not None:
            scratch.drop()


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # the JVM is gone; its folder's owner cleans up
        Scratch.made.clear()


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, **beside: Column) -> DataFrame:
    """The rows of docs in one struct `row`, so that no name of theirs meets one of an operator's, and columns beside it."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in beside.items()])


def unpacked(rows: DataFrame, names: list[str], out: dict[str, Column] | None = None) -> DataFrame:
    """The columns `names` of the packed rows and those of `out`, which replace or follow them; Spark's names ignore case, so these do."""
    out = out or {}
    by_low, taken = {k.lower(): k for k in out}, {c.lower() for c in names}
    return rows.select(*[out[by_low[c.lower()]].alias(c) if c.lower() in by_low else F.col(f"row.{quoted(c)}").alias(c) for c in names], *[v.alias(k) for k, v in out.items() if k.lower() not in taken])


def others(names: list[str], added: Iterable[str]) -> list[str]:
    """Those of the names that an added column doesn't replace; names that differ in case only are the same."""
    low = {c.lower() for c in added}
    return [c for c in names if c.lower() not in low]


def with_batches(docs: DataFrame, keep: list[str], of: list[Column], added: str, make: Callable) -> DataFrame:
    """The columns `keep` of docs and those of the schema `added`, which `make` gives for each Arrow batch of the columns `of`; an added column replaces one of its name."""
    more = StructType.fromDDL(added)
    keep = others(keep, more.names)
    rows = docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(keep)], *[c.alias(f"of{i}") for i, c in enumerate(of)])
    shape = StructType([*rows.schema.fields[: len(keep)], *more.fields])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *make(*batch.columns[len(keep) :])], names=shape.names)

    made = rows.mapInArrow(batches, shape)
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *more.names)


def text_key(text: str = "text", doc_id: str = "doc_id") -> Column:
    """Tells rows apart that share a doc_id; rows equal in both are one document."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """Distributed union-find over (src, dst) longs: returns (node, root), root the least node.

    Alternates large-star and small-star steps. The edge table is written to the
    shared folder after each round; the driver sees only a row count and a checksum.
    Nodes without an edge to another node are not returned.
    """

    def directed(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first())

    def large_star(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        return both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))

    def small_star(e: DataFrame) -> DataFrame:
        least = e.groupBy("src").agg(F.min("dst").alias("m"))
        moved = e.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        return moved.union(least.select("src", F.col("m").alias("dst")))

    step = 0
    now = scratch.save(directed(edges), f"{label}-{step}")
    before, after = None, state(now)
    while before != after:
        step += 1
        now = scratch.save(directed(small_star(directed(large_star(now)))), f"{label}-{step}")
        scratch.drop(f"{label}-{step - 1}")
        before, after = after, state(now)
    roots = now.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return roots.union(now.select(F.col("dst").alias("node"), F.col("dst").alias("root"))).distinct()
