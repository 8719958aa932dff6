"""Operator 12: ranked lexical search by sort-based accumulation.

Documents are cut into words once and stored as the terms of the items they hold with their
counts. Scoring concatenates, for a run of documents, the impacts of all matched (item, document)
as arrays, radix sorts their packed keys and sums equal keys by reduceat. Each task keeps the
best of each item in heaps; what the tasks found is dealt by ranges of item and score, a heap
per item and range selects again, and the few left are numbered. A range holds whole rows of
any item, so a hot item is spread over several.

Items are asked in blocks of at most about BLOCK_BYTES of text, whose terms are broadcast: an
item set of any size is searched whole. Item terms count once an item. Document frequencies are counted on Spark
over all documents; only those of a block's terms come to the driver.

Defined cases: null and wordless texts hold no term; an item without terms has no row; item
rows that share an item_id are one item, those without item_id too; repeated documents are ranked
each; equal scores go by ascending doc_id, null last; an empty table gives an empty
result. Words are equal if their 64-bit hashes are. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import Scratch, with_batches
from lexiforge.llm.words import hashed

K = 50
BLOCK_BYTES = 4 << 20
#: Impacts that are sorted at once.
TOGETHER = 1 << 21
#: Fixed values of the score: scale of weights and impacts, share of length in percent, factor of it.
SCALE, IMPACT, SHARE, LENGTH = 1000, 1_000_000_000, 50, 20


class Terms:
    """The terms of some items: sorted hashes, and for each the items that hold it."""

    def __init__(self, texts: list[str | None]):
        words, counts = hashed(pa.array(texts, pa.string()))
        item = np.repeat(np.arange(len(counts)), counts)
        order = np.lexsort((item, words))
        words, item = words[order], item[order]
        new = np.append(True, (words[1:] != words[:-1]) | (item[1:] != item[:-1])) if len(words) else np.zeros(0, bool)
        words, self.items = words[new], item[new].astype(np.int64)
        self.hashes, first, self.sizes = np.unique(words, return_index=True, return_counts=True)
        self.starts = first.astype(np.int64)
        self.some = np.zeros(1 << 16, bool)
        self.some[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in words, term) of the words that are terms."""
        at = np.flatnonzero(self.some[(words >> np.uint64(48)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.hashes, words[at]), max(0, len(self) - 1))
        same = self.hashes[term] == words[at] if len(self) else np.zeros(len(at), bool)
        return at[same], term[same]


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """The order of uint64 keys of `bits` bits: stable radix sorts by 16 bits each, lowest first."""
    order = np.argsort((keys & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")
    for shift in range(16, bits, 16):
        order = order[np.argsort((keys[order] >> np.uint64(shift) & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")]
    return order


def postings(docs: DataFrame, terms, scratch: Scratch, name: str) -> DataFrame:
    """(doc_id, n, terms, counts) of the documents that hold a term of any kind: n of them, and those of the block with their counts."""

    def make(texts: pa.Array) -> list[pa.Array]:
        block: Terms = terms.value
        words, n = hashed(texts)
        at, term = block.find(words)
        doc = np.searchsorted(np.cumsum(n), at, side="right")
        key, count = np.unique(doc * max(1, len(block)) + term, return_counts=True)
        doc, term = np.divmod(key, max(1, len(block)))
        offsets = pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=len(n)))), pa.int32())
        return [pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(count, pa.int32()))]

    rows = with_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("searched")), ["doc_id"], [F.col("searched")], "n long, terms array<int>, counts array<int>", make)
    return scratch.save(rows.where("n > 0"), name)


class Best:
    """Heaps of the k best documents of each item: highest score, then least doc_id, null last."""

    def __init__(self, k: int):
        self.k, self.heaps = k, {}

    def put(self, item: int, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        heap = self.heaps.setdefault(item, [])
        if len(heap) == self.k:
            worth = score >= heap[0][0]
            score, doc, known = score[worth], doc[worth], known[worth]
        if len(score) > self.k:
            worth = score >= np.partition(score, -self.k)[-self.k]
            score, doc, known = score[worth], doc[worth], known[worth]
        for row in zip(score.tolist(), known.tolist(), (-doc).tolist()):
            if len(heap) < self.k:
                heapq.heappush(heap, row)
            elif row > heap[0]:
                heapq.heapreplace(heap, row)

    def batch(self) -> pa.RecordBatch:
        rows = [(item, score, -doc if known else None) for item, heap in self.heaps.items() for score, known, doc in heap]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["item", "score", "doc_id"])


def scored(postings: DataFrame, terms, weights, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, score, doc_id): the k best of each item in each task; item is its number in the block."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Terms = terms.value
        weight, best = weights.value, Best(k)
        n_items = int(block.items.max(initial=0)) + 1
        for batch in it:
            held = np.diff(batch.column(2).offsets.to_numpy())
            term = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            tf = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            length = 100 - SHARE + (SHARE * batch.column(1).to_numpy() * n_docs) // n_terms
            known = ~np.asarray(batch.column(0).is_null())
            ids = batch.column(0).fill_null(0).to_numpy()
            doc = np.repeat(np.arange(len(held)), held)
            impact = weight[term] * ((IMPACT * tf) // (SCALE * tf + LENGTH * length[doc]))
            doc, term, impact = doc[impact > 0], term[impact > 0], impact[impact > 0]
            # Runs of postings whose (item, document) impacts fit together; a document's postings stay in one.
            reach = np.cumsum(block.sizes[term])
            a = 0
            while a < len(doc):
                b = int(np.searchsorted(reach, (reach[a - 1] if a else 0) + TOGETHER, side="right"))
                whole = int(np.searchsorted(doc, doc[b])) if b < len(doc) else b
                b = whole if whole > a else int(np.searchsorted(doc, doc[a], side="right"))
                size = block.sizes[term[a:b]]
                at = np.arange(size.sum()) + np.repeat(block.starts[term[a:b]] - (np.cumsum(size) - size), size)
                key = (block.items[at].astype(np.uint64) << np.uint64(32)) | np.repeat(doc[a:b], size).astype(np.uint64)
                order = radix_order(key, 32 + max(1, (n_items - 1).bit_length()))
                key = key[order]
                heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                score = np.add.reduceat(np.repeat(impact[a:b], size)[order], heads)
                item, row = (key[heads] >> np.uint64(32)).astype(np.int64), (key[heads] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                cuts = np.append(np.flatnonzero(np.append(True, item[1:] != item[:-1])), len(item))
                for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    best.put(int(item[low]), score[low:high], ids[row[low:high]], known[row[low:high]])
                a = b
        yield best.batch()

    return postings.mapInArrow(batches, "item long, score long, doc_id long")


def selected(found: DataFrame, k: int) -> DataFrame:
    """(item, rank, score, doc_id): the k best of each item among those found, range by range and then of all ranges."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in it:
            item, score, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            known, doc = ~np.asarray(doc.is_null()), doc.fill_null(0).to_numpy()
            for i in np.unique(item).tolist():
                best.put(i, score[item == i], doc[item == i], known[item == i])
        yield best.batch()

    dealt = found.repartitionByRange("item", "score").mapInArrow(batches, "item long, score long, doc_id long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return dealt.withColumn("rank", rank).where(F.col("rank") <= k).select("item", "rank", "score", "doc_id")


def search(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents (doc_id, text) of highest score for each item (item_id, text)."""
    session, scratch = docs.sparkSession, Scratch(docs.sparkSession, "search")
    asked = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    out = None
    for b in range(n):
        # Texts of one item are one text: terms count once an item.
        block = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).groupBy("item_id").agg(F.array_join(F.collect_set("text"), "\n").alias("text")).collect()
        block.sort(key=lambda r: (r.item_id is None, r.item_id))
        terms = Terms([r.text for r in block])
        shared = session.sparkContext.broadcast(terms)
        rows = postings(docs, shared, scratch, f"postings{b}")
        n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
        df = np.zeros(len(terms), np.int64)
        for r in held:
            df[r.term] = r.df
        weights = np.array([math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        # Saved, for ranges are drawn from a sample of it first.
        local = scratch.save(scored(rows, shared, session.sparkContext.broadcast(weights), n_docs, max(1, n_terms), k), f"local{b}")
        best = selected(local, k)
        names = session.createDataFrame([(i, r.item_id) for i, r in enumerate(block)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        found = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # one row for each item of the block
        out = found if out is None else out.union(found)
    return out


def op12_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents WHERE text IS NOT NULL),
l AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
g AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM l),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS t FROM benchmark WHERE text IS NOT NULL),
u AS (SELECT r, unnest(w) AS t FROM d),
c AS (SELECT r, t, count(*)::BIGINT AS tf FROM u WHERE t IN (SELECT t FROM q) GROUP BY r, t),
f AS (SELECT t, count(*)::BIGINT AS df FROM c GROUP BY t),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM f, g),
m AS (SELECT r, doc_id, 50 + ((50 * n * nn) // ll) AS m FROM l, g),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN c USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 50
"""
