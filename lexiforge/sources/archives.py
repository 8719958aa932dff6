"""Archives of article sources: members, nested gzip and tar files, character sets, main files."""

from __future__ import annotations

import gzip
import io
import struct
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import charsets

MEMBERS = "tar string, article string, member string, kind string, encoding string, text string"
VECTORS = "word string, vec array<float>"


def decode(data: bytes) -> tuple[str, str]:
    """(text, name of the character set): a byte order mark, else UTF-8, else what scores best, Western sets as Windows-1252, else UTF-8 without what fails."""
    for mark, codec in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            try:
                return data.decode(codec), codec
            except UnicodeDecodeError:
                break
    try:
        return data.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        text, name, _, note = charsets.decoded(data)
    if note is None and name not in ("ISO-8859-1", "Windows-1252"):
        return text, name
    try:
        return data.decode("cp1252"), "cp1252"
    except UnicodeDecodeError:
        pass
    return data.decode("utf-8", "ignore"), "unknown"


def _inner(tar: str, member: str, data: bytes) -> Iterator[tuple]:
    """Rows of one member: a pdf or an encrypted source is only noted; gzip is opened; a tar inside gives all its files."""
    stem = member.rsplit("/", 1)[-1]
    article = stem.removesuffix(".gz").removesuffix(".pdf")
    if ".pdf" in stem:
        yield tar, article, member, "pdf", None, None
        return
    if b'.tex.cry"' in data[:512] or b".tex.cry" in data[:64]:
        yield tar, article, member, "encrypted", None, None
        return
    if data[:2] == b"\x1f\x8b":
        try:
            data = gzip.decompress(data)
        except (OSError, EOFError):
            yield tar, article, member, "damaged", None, None
            return
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as nested:
            for each in nested:
                if each.isfile():
                    text, codec = decode(nested.extractfile(each).read())
                    yield tar, article, each.name, "file", codec, text
    except tarfile.TarError:
        text, codec = decode(data)
        yield tar, article, f"{article}.tex", "file", codec, text


def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in MEMBERS.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows = []
            try:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as outer:
                    for each in outer:
                        if each.isfile():
                            rows.extend(_inner(path, each.name, outer.extractfile(each).read()))
                        if len(rows) >= 64:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
            except (tarfile.TarError, EOFError):
                rows.append((path, None, None, "damaged", None, None))
            yield pd.DataFrame(rows, columns=names)


def tar_members(spark: SparkSession, root: str, pattern: str = "*.tar") -> DataFrame:
    """One row for each file in the tar files under root: tar, article, member, kind, encoding, text.

    A tar file is one row of Spark's binary reader, so it must be under 2 GB; files are the
    unit of parallel work. kind is file, pdf, encrypted or damaged; the text of the last three is null.
    Spark's reader leaves files of no bytes out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "content").mapInPandas(expand, MEMBERS)


def main_files(members: DataFrame) -> DataFrame:
    """(tar, article, member, score): the main file of each article.

    A point each for a document class, for the start of the document and for a title. Files
    that another one of the article inputs or includes are out. The highest score over 0
    wins, then the first name.
    """
    tex = members.where("kind = 'file'")
    has = lambda pattern: F.col("text").rlike(pattern).cast("int")
    scored = tex.withColumn("score", has(r"\\document(class|style)") + has(r"\\begin\s*\{document\}") + has(r"\\(title|maketitle)\b"))
    named = tex.select("tar", "article", F.explode(F.regexp_extract_all("text", F.lit(r"\\(?:input|include)\s*\{([^}]+)\}"), F.lit(1))).alias("name"))
    named = named.select("tar", "article", F.regexp_replace(F.trim("name"), r"(^\./)|(\.tex$)", "").alias("stem")).distinct()
    left = scored.withColumn("stem", F.regexp_replace("member", r"(^\./)|(\.tex$)", "")).join(named, ["tar", "article", "stem"], "left_anti")
    best = F.min(F.struct((-F.col("score")).alias("minus"), F.col("member").alias("member")))
    return left.where("score > 0").groupBy("tar", "article").agg(best.alias("b")).select("tar", "article", "b.member", (-F.col("b.minus")).alias("score"))


def word2vec_binary(spark: SparkSession, path: str, rows: int = 4096) -> DataFrame:
    """(word, vec) of binary word2vec files: a line with both sizes, then each word, a blank and its floats."""

    def parse(batches):
        for batch in batches:
            for data in batch["content"]:
                end = data.index(b"\n")
                count, width = map(int, data[:end].split())
                at, words, vecs = end + 1, [], []
                for _ in range(count):
                    blank = data.index(b" ", at)
                    words.append(data[at:blank].decode("utf-8", "replace").lstrip("\n"))
                    at = blank + 1 + 4 * width
                    vecs.append(list(struct.unpack(f"<{width}f", data[blank + 1 : at])))
                    if len(words) == rows:
                        yield pd.DataFrame({"word": words, "vec": vecs})
                        words, vecs = [], []
                yield pd.DataFrame({"word": words, "vec": vecs})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, VECTORS)
