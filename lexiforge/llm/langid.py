"""Operator 6: language identification by multinomial naive Bayes over hashed character n-grams.

N-grams of one to four characters (code points) of the lower-cased text are hashed into
2**16 columns. The model holds a log probability for each column and language. Training
reads at most `per_language` labelled texts of a language, equal texts counting once, those of
least hash; the bound keeps the driver's and workers' part the same at every size:
languages x 2**16 floats, with at most LANGUAGES languages. Prediction reads whole texts: those of a batch become one
sparse matrix of column counts, whose product with the log probabilities has their sums.

Defined cases: text that is null or has no letter is 'und' with score 0; rows without
lang don't train; without a labelled row every text is 'und'; ties go to the first
language by code point; repeated rows repeat, and train as one; other columns are kept by
`predict`, which replaces columns named lang_pred and score in any case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import with_batches

COLUMNS = 1 << 16
ORDERS = (1, 2, 3, 4)
PER_LANGUAGE = 1500
#: Languages that are learnt at most, those of most texts.
LANGUAGES = 256
#: The evidence of a text counts as that of so many n-grams at most, so that scores spread.
TEMPER = 40.0
#: Added to every count, so that no n-gram is impossible; small, so that a language learnt from little text isn't drowned.
ALPHA = 0.02
#: Characters of texts that are scored together; longer texts are counted part by part.
CHUNK = 1 << 18
UNDETERMINED = "und"


def gram_columns(points: np.ndarray) -> list[np.ndarray]:
    """Hash columns of the n-grams that start at each code point, an array for each order; the last ones of an order lack."""
    grams, out = np.zeros(len(points), np.uint32), []
    for n in range(1, max(ORDERS) + 1):
        m = max(len(points) - n + 1, 0)
        grams = (grams[:m] * np.uint32(0x01000193)) ^ (points[n - 1 : n - 1 + m] + np.uint32(0x9E3779B9))
        if n in ORDERS:
            mixed = (grams ^ (grams >> np.uint32(15)) ^ np.uint32(n << 28)) * np.uint32(2246822519)
            mixed ^= mixed >> np.uint32(13)
            mixed *= np.uint32(3266489917)
            out.append(mixed >> np.uint32(16))
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_rows(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, column) of all n-grams of the texts, text numbers rising within each part, of about CHUNK characters; no n-gram goes over the end of a text."""
    longest, held, size = max(ORDERS), [], 0

    def rows(parts: list[tuple[int, np.ndarray, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        points = np.concatenate([p for _, p, _ in parts])
        sizes = np.array([len(p) for _, p, _ in parts])
        owner, ends = np.repeat([i for i, _, _ in parts], sizes), np.cumsum(sizes)
        for n, found in zip(ORDERS, gram_columns(points)):
            fit = np.ones(len(points), bool)
            for (_, p, starting), end in zip(parts, ends.tolist()):
                # Starts in the part that the next one repeats, or too near its end.
                fit[end - len(p) + min(starting, max(len(p) - n + 1, 0)) : end] = False
            fit = fit[: len(found)]
            yield owner[: len(found)][fit], found[fit]

    for i, text in enumerate(texts):
        points = _points(text)
        for at in range(0, len(points), CHUNK):
            part = points[at : at + CHUNK + longest - 1]
            held.append((i, part, min(CHUNK, len(points) - at)))
            size += len(part)
            if size >= CHUNK:
                yield from rows(held)
                held, size = [], 0
    if held:
        yield from rows(held)


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities of shape (COLUMNS, languages)) from text and lang."""
    usable = labelled.where("text is not null and lang is not null").select("text", "lang")
    keyed = usable.select("lang", "text", F.xxhash64("text").alias("key"))
    # Equal texts share a draw; so that they can't fill a language's share, keys are counted once.
    draw = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 40))
    # A share of each language that holds more than enough texts, so that the order below sorts few at any size.
    # Broadcast: one row for each language, of which the model holds COLUMNS numbers anyway.
    # Junk labels can't fill the driver: the languages of most texts are learnt, ties by their name.
    known = keyed.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("texts")).orderBy(F.desc("texts"), "lang").limit(languages)
    sizes = known.select(F.col("lang").alias("lang_of"), (F.lit(float(1 << 40)) * (1.4 * per_language + 200) / F.col("texts")).alias("below"))
    drawn = keyed.withColumn("draw", draw).join(F.broadcast(sizes), (F.col("lang") == F.col("lang_of")) & (F.col("draw") <= F.col("below")))
    once = drawn.groupBy("lang", "key", "draw").agg(F.first("text").alias("text"))
    spread = Window.partitionBy("lang").orderBy("draw", "key")
    some = once.withColumn("nth", F.row_number().over(spread)).where(F.col("nth") <= per_language).select("lang", "text")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in it:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = totals.setdefault(lang, np.zeros(COLUMNS, np.int64))
                for _, columns in gram_rows([text]):
                    mine += np.bincount(columns, minlength=COLUMNS)
        for lang, mine in totals.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(mine[at])], names=["lang", "at", "n"])

    counted = some.repartition(8, F.xxhash64("text")).mapInArrow(count, "lang string, at int, n long")
    table = counted.groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    langs = sorted(table["lang"].unique())
    logs = np.zeros((COLUMNS, len(langs)), np.float32)
    for i, lang in enumerate(langs):
        mine = np.full(COLUMNS, ALPHA)
        part = table[table["lang"] == lang]
        mine[part["at"].to_numpy()] += part["n"].to_numpy()
        logs[:, i] = np.log(mine / mine.sum())
    return langs, logs


def scores(texts: list[str], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed log probabilities, of shape (texts, languages), and n-grams of each text."""
    sums, grams = np.zeros((len(texts), logs.shape[1])), np.zeros(len(texts), np.int64)
    for owner, column in gram_rows(texts):
        # Compressed sparse rows: the columns of each row in turn, and where each row begins; a column that repeats counts again.
        row, first = np.unique(owner, return_index=True)
        if len(row):
            sums[row] += np.add.reduceat(logs.take(column, axis=0), first, axis=0, dtype=np.float64)
            grams += np.bincount(owner, minlength=len(texts))
    return sums, grams


def classify(texts: list[str | None], langs: list[str], logs: np.ndarray) -> tuple[list[str], list[float]]:
    found, sure = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    usable = [i for i, t in enumerate(texts) if langs and t is not None and any(map(str.isalpha, t))]
    if usable:
        sums, grams = scores([texts[i] for i in usable], logs)
        z = (sums - sums.max(axis=1, keepdims=True)) * np.minimum(1.0, TEMPER / grams)[:, None]
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        for i, best, row in zip(usable, p.argmax(axis=1).tolist(), p):
            found[i], sure[i] = langs[best], float(row[best])
    return found, sure


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all if None), lang_pred and score, which replace columns of their names in any case."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: pa.Array) -> list[pa.Array]:
        found, sure = classify(texts.to_pylist(), *shared.value)
        return [pa.array(found, pa.string()), pa.array(sure, pa.float64())]

    return with_batches(docs, docs.columns if keep is None else keep, [F.col("text")], "lang_pred string, score double", make)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op6_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(rows, model, ["doc_id", "held_out"])
