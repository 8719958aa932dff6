"""Tables of iterative steps, written to the folder that driver and executors share, so that lineage stays short and a lost executor costs no earlier round."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a plain local master gets a temporary folder where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = getattr(spark.sparkContext, "_lexiforge_rounds", None)
        if path is None:
            path = spark.sparkContext._lexiforge_rounds = "file://" + tempfile.mkdtemp(prefix="lexiforge-rounds-")
    return path.rstrip("/")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, a write deletes its shuffle files when it has ended, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Rounds:
    """Saves a step's table and reads it again; `keep` deletes all but the newest tables. The last ones go with the Python process, for results read them."""

    made: list[Rounds] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self.paths = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", []
        Rounds.made.append(self)

    def path(self) -> str:
        self.paths.append(f"{self.base}/{uuid.uuid4().hex}")
        return self.paths[-1]

    def save(self, df: DataFrame) -> DataFrame:
        path = self.path()
        with shuffles_dropped(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def delete(self, path: str) -> None:
        """Deletes one table; `paths` knows it no more."""
        self.paths.remove(path)
        self._delete(path)

    def keep(self, newest: int) -> None:
        for path in self.paths[: len(self.paths) - newest]:
            self._delete(path)
        self.paths = self.paths[len(self.paths) - newest :]

    def drop(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self._delete(self.base)


@atexit.register
def _at_exit() -> None:
    for rounds in Rounds.made:
        try:
            rounds.drop()
        except Exception:  # the JVM is gone; its folder's owner cleans up
            return
