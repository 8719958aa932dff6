"""Readers and writers of XML, vector and text tables, all split by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed names of the columns of a download manifest.
MANIFEST = "content_md5sum string, filename string, first_item string, last_item string, md5sum string, num_items int, seq_num int, size bigint, timestamp string, yymm string"
GLOSSARY = "_name string, _num int, definition array<struct<_index: int, stmnt: string, dfndum: array<string>>>"
WIKI_PAGE = "title string, ns int, id bigint, revision struct<text: struct<_VALUE: string>>"


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """One row for each element `row_tag`; damaged ones give nulls. Compressed files are read as they are."""
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").schema(schema).load(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return xml_rows(spark, path, "file", MANIFEST)


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """(article, num, index, stmnt, term) of glossary files; an article's definitions and their terms as rows."""
    rows = xml_rows(spark, path, "article", GLOSSARY).select(F.col("_name").alias("article"), F.col("_num").alias("num"), F.explode("definition").alias("d"))
    return rows.select("article", "num", F.col("d._index").alias("index"), F.col("d.stmnt").alias("stmnt"), F.explode("d.dfndum").alias("term"))


def write_glossary(terms: DataFrame, path: str) -> None:
    """Writes (article, num, index, stmnt, term) as gzip XML, one article element with its definitions."""
    one = terms.groupBy("article", "num", "index", "stmnt").agg(F.array_sort(F.collect_list("term")).alias("dfndum"))
    each = F.struct(F.col("index").cast("int").alias("_index"), "stmnt", "dfndum")
    articles = one.groupBy("article", "num").agg(F.array_sort(F.collect_list(each)).alias("definition"))
    articles = articles.select(F.col("article").alias("_name"), F.col("num").alias("_num"), "definition")
    articles.write.mode("overwrite").format("xml").option("rootTag", "root").option("rowTag", "article").option("compression", "gzip").save(path)


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of the pages of a dump; splittable compression such as bz2 is read in parallel."""
    rows = xml_rows(spark, path, "page", WIKI_PAGE)
    return rows.select("title", F.col("revision.text._VALUE").alias("text"))


def numbered(rows: DataFrame, name: str = "n") -> DataFrame:
    """Rows with their position from 0 in reading order; only row counts per partition are exchanged."""
    held = rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    counts = held.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return held.join(starts, "_part").withColumn(name, F.col("_at") - F.col("_first") + F.col("_start")).drop("_part", "_at", "_first", "_start")


def floats(text: Column) -> Column:
    return F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.cast("float"))


def glove(spark: SparkSession, vocab: str, vectors: str) -> DataFrame:
    """(word, vec): the n-th word has the n-th vector; a vector past the last word is that of <unk>."""
    words = numbered(spark.read.text(vocab)).select("n", F.split("value", " ")[0].alias("word"))
    vecs = numbered(spark.read.text(vectors)).select("n", floats(F.col("value")).alias("vec"))
    return vecs.join(words, "n", "left").select(F.coalesce("word", F.lit("<unk>")).alias("word"), "vec")


def word2vec_text(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) of the text form; the line of sizes is left out."""
    line = F.col("value")
    rows = spark.read.text(path).where(~line.rlike(r"^\d+ \d+\s*$"))
    return rows.select(F.split(line, " ")[0].alias("word"), floats(F.regexp_replace(line, r"^\S+ ", "")).alias("vec"))


def write_parts(rows: DataFrame, path: str, parts: int, order: str) -> None:
    """Writes contiguous parts of about one size, as folders part=0, 1, ...; a range exchange, no single task."""
    cut = rows.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id())
    cut.sortWithinPartitions(order).write.mode("overwrite").partitionBy("part").json(path)


def write_lines(rows: DataFrame, text: str, label: str, path: str) -> None:
    """One text a line, in one folder for each label; line ends inside become blanks."""
    rows.select(F.regexp_replace(text, r"\s*\n\s*", " ").alias("value"), F.col(label)).write.mode("overwrite").partitionBy(label).text(path)


def file_index(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, name, length, modified) of all files under root; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def verify_checksums(spark: SparkSession, root: str, manifest_rows: DataFrame) -> DataFrame:
    """(filename, md5sum, found, ok) for every manifest row; a file that is missing is not ok."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    sums = files.select(F.element_at(F.split("path", "/"), -1).alias("_name"), F.md5("content").alias("found"))
    rows = manifest_rows.withColumn("_name", F.element_at(F.split("filename", "/"), -1)).join(sums, "_name", "left")
    return rows.select("filename", "md5sum", "found", F.coalesce(F.col("found") == F.col("md5sum"), F.lit(False)).alias("ok"))
