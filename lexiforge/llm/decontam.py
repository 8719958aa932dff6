"""Operator 11: benchmark decontamination by training suffix arrays.

The words of the documents of a batch, as 64-bit hashes, lie in shards of about SHARD_WORDS
words. A shard's suffix array orders all its places by the words that follow (prefix
doubling up to a window's length); every test suffix, at each word of each item, is searched in it
by bisection, all suffixes at once. Each place found is a window that occurs there; windows
that follow one another in item and document alike join to longest verbatim matches
with their places. A shard is made, searched and left in one task, so nothing is
shuffled; a document of more than a shard's words has several, which overlap by a window less one
word. Items are broadcast in blocks of at most about BLOCK_BYTES of text, one pass over the documents a
block, so a benchmark of any size is searched whole.

A window is WINDOW consecutive words of an item, or all words of a shorter one.

Defined cases: null and wordless texts have no words, as documents and as items; repeated
rows repeat; item rows that share an item_id count as one item; an item without item_id hits
words, but isn't counted or named; an empty benchmark hits nothing; an empty table gives an
empty result; columns of docs named like an added one are replaced, whatever their case.
Words are equal if their 64-bit hashes are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import quoted, with_batches
from lexiforge.llm.words import hashed

WINDOW = 10
SHARD_WORDS = 1 << 19
BLOCK_BYTES = 4 << 20
#: Suffixes that are searched side by side.
TOGETHER = 1 << 15
MATCH = "struct<item_id: string, item: long, item_start: int, start: long, length: long>"
_MATCH = pa.struct([("item_id", pa.string()), ("item", pa.int64()), ("item_start", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Places of `words` (uint64), ordered by the `depth` words or more from there on."""
    n = len(words)
    order = np.argsort(words)
    first = np.ones(n, bool)
    np.not_equal(words[order[1:]], words[order[:-1]], out=first[1:])
    slots = np.arange(n)
    rank = np.full(n + depth, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, slots, 0))
    step = 1
    while step < depth:
        # Only places that others equal so far are ordered anew.
        at = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(at):
            break
        some = order[at]
        key = (rank[some] << 32) | (rank[some + step] + 1)
        by = np.argsort(key)
        some, key = some[by], key[by]
        new = np.ones(len(at), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        order[at], first[at] = some, new
        rank[some] = np.maximum.accumulate(np.where(new, at, 0))
        step *= 2
    return order


class Suffixes:
    """The test suffixes of some items: for each that a window begins, its words, item and place."""

    def __init__(self, ids: list[str | None], texts: list[str | None], first_item: int, window: int = WINDOW):
        words, counts = hashed(pa.array(texts, pa.string()))
        self.ids, self.first_item, self.window = ids, first_item, window
        ends = np.repeat(np.cumsum(counts), counts)
        self.item = np.repeat(np.arange(len(counts)), counts)
        self.at = np.arange(len(words)) - (ends - np.repeat(counts, counts))
        self.width = np.minimum(np.repeat(counts, counts), window)
        begins = np.flatnonzero(np.arange(len(words)) + self.width <= ends)
        self.item, self.at, self.width = self.item[begins], self.at[begins], self.width[begins]
        self.begins, self.words = begins, np.append(words, np.zeros(window, np.uint64))

    def __len__(self) -> int:
        return len(self.begins)


def _bounds(text: np.ndarray, order: np.ndarray, asked: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of `asked` the range of `order` whose suffixes of `text` begin with its first `width` words."""
    columns = np.arange(asked.shape[1])
    counts = columns[None, :] < width[:, None]
    rows = np.arange(len(asked))
    found = []
    for past in (False, True):
        low, high = np.zeros(len(asked), np.int64), np.full(len(asked), len(order))
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            there = text[order[np.minimum(middle, len(order) - 1)][:, None] + columns]
            differ = (there != asked) & counts
            at = differ.argmax(axis=1)
            right = np.where(differ[rows, at], there[rows, at] < asked[rows, at], past) & open_
            low = np.where(right, middle + 1, low)
            high = np.where(open_ & ~right, middle, high)
        found.append(low)
    return found[0], found[1]


def _runs(suffixes: Suffixes, order: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows (item, item_start, place, windows): windows found that follow one another in item and shard, as longest runs."""
    out = []
    diagonal, since = np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = None

    def closed(which: np.ndarray, item: int, end: int) -> None:
        if len(diagonal[which]):
            out.append(np.stack([np.full(which.sum(), item), since[which], diagonal[which] + since[which], end - since[which]], axis=1))

    for s in np.flatnonzero(high > low).tolist():
        item, at = int(suffixes.item[s]), int(suffixes.at[s])
        if before != (item, at - 1) and before is not None:
            closed(np.ones(len(diagonal), bool), before[0], before[1] + 1)
            diagonal, since = diagonal[:0], since[:0]
        now = np.sort(order[low[s] : high[s]]) - at
        goes_on = np.isin(diagonal, now, assume_unique=True)
        closed(~goes_on, item, at)
        fresh = now[~np.isin(now, diagonal, assume_unique=True)]
        diagonal = np.concatenate([diagonal[goes_on], fresh])
        since = np.concatenate([since[goes_on], np.full(len(fresh), at)])
        before = (item, at)
    if before is not None:
        closed(np.ones(len(diagonal), bool), before[0], before[1] + 1)
    return np.concatenate(out) if out else np.zeros((0, 4), np.int64)


def _in_shard(words: np.ndarray, places: np.ndarray, suffixes: Suffixes) -> np.ndarray:
    """The runs of windows in one shard; place is that in `places`, where the shard's words come from."""
    text = np.append(words, np.zeros(suffixes.window, np.uint64))
    order = suffix_array(words, suffixes.window)
    low, high = np.zeros(len(suffixes), np.int64), np.zeros(len(suffixes), np.int64)
    for a in range(0, len(suffixes), TOGETHER):
        some = slice(a, a + TOGETHER)
        asked = suffixes.words[suffixes.begins[some][:, None] + np.arange(suffixes.window)]
        low[some], high[some] = _bounds(text, order, asked, suffixes.width[some])
    runs = _runs(suffixes, order, low, high)
    runs[:, 2] = places[runs[:, 2]]
    return runs


def matches_of(words: np.ndarray, counts: np.ndarray, suffixes: Suffixes, shard_words: int = SHARD_WORDS) -> np.ndarray:
    """Rows (document, start, length, item, item_start) of the longest matches in the documents whose `counts` words stand in `words`."""
    ends = np.cumsum(counts)
    overlap, found = suffixes.window - 1, []
    a = 0
    while a < len(counts) and len(suffixes):
        b = a + max(1, int(np.searchsorted(ends[a:], (ends[a - 1] if a else 0) + shard_words, side="right")))
        base, stop = int(ends[a] - counts[a]), int(ends[b - 1])
        for low in range(base, max(base + 1, stop - overlap if stop - base > shard_words else base + 1), shard_words):
            high = min(low + shard_words + overlap, stop) if stop - base > shard_words else stop
            # A zero, which is no word, ends each document.
            own = np.repeat(np.arange(b - a), counts[a:b])[low - base : high - base]
            at = np.arange(high - low) + own
            text = np.zeros(high - low + b - a, np.uint64)
            text[at] = words[low:high]
            places = np.zeros(len(text), np.int64)
            places[at] = np.arange(low, high)
            found.append(_in_shard(text, places, suffixes))
        a = b
    runs = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    # Runs that go on in the next shard of a document.
    item, item_start, place, windows = runs.T
    runs = runs[np.lexsort((place, place - item_start, item))]
    item, item_start, place, windows = runs.T
    if len(runs):
        joins = np.append(False, (item[1:] == item[:-1]) & (place[1:] - item_start[1:] == place[:-1] - item_start[:-1]) & (place[1:] == place[:-1] + windows[:-1]))
        heads = np.flatnonzero(~joins)
        windows = np.add.reduceat(windows, heads)
        item, item_start, place = item[heads], item_start[heads], place[heads]
    document = np.searchsorted(ends, place, side="right")
    width = np.zeros(len(suffixes.ids) + 1, np.int64)
    width[suffixes.item] = suffixes.width
    rows = np.stack([document, place - (ends - counts)[document] if len(place) else place, windows + width[item] - 1, item, item_start], axis=1)
    return rows[np.lexsort((rows[:, 4], rows[:, 3], rows[:, 1], rows[:, 0]))]


def _covered(counts: np.ndarray, document: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many words of each document lie in a match."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    place = (ends - counts)[document] + start
    change = np.bincount(place, minlength=total + 1) - np.bincount(place + length, minlength=total + 1)
    hit = np.append(0, np.cumsum(np.cumsum(change)[:total] > 0))
    return hit[ends] - hit[ends - counts]


def _blocks(items: DataFrame, block_bytes: int) -> list[DataFrame]:
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) for b in range(n)]


def found(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns `keep` of docs (all if None) and n_words, n_hit and `matches`, the longest verbatim matches of each document with the items (item_id, text)."""
    session, keep = docs.sparkSession, docs.columns if keep is None else keep
    names = [c for c in keep if c.lower() not in ("n_words", "n_hit", "matches")]
    rows = docs.select(*[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(names)], F.col("text").alias("words_of"), F.lit(None).cast(f"array<{MATCH}>").alias("matches"))
    held, seen = [f"k{i}" for i in range(len(names))], 0
    for block in _blocks(items, block_bytes):
        some = sorted(((r.item_id, r.text) for r in block.collect()), key=lambda r: (r[0] is None, r))
        shared = session.sparkContext.broadcast(Suffixes([r[0] for r in some], [r[1] for r in some], seen, window))
        seen += len(some)

        def make(texts: pa.Array, before: pa.Array, shared=shared) -> list[pa.Array]:
            suffixes = shared.value
            words, counts = hashed(texts)
            new = matches_of(words, counts, suffixes)
            names_of = np.array([*suffixes.ids, None], object)
            flat = before.flatten()
            sizes = np.diff(before.offsets.to_numpy()) if len(before) else np.zeros(0, np.int64)
            document = np.concatenate([np.repeat(np.arange(len(before)), sizes), new[:, 0]]).astype(np.int64)
            parts = [
                np.concatenate([np.array(flat.field("item_id").to_pylist(), object), names_of[new[:, 3]]]),
                *[np.concatenate([flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64), new[:, i] + plus]) for f, i, plus in (("item", 3, suffixes.first_item), ("item_start", 4, 0), ("start", 1, 0), ("length", 2, 0))],
            ]
            order = np.argsort(document, kind="stable")
            document, parts = document[order], [p[order] for p in parts]
            hit = _covered(counts, document, parts[3], parts[4])
            listed = pa.StructArray.from_arrays([pa.array(p, f.type, from_pandas=False) for p, f in zip(parts, _MATCH)], fields=list(_MATCH))
            offsets = np.append(0, np.cumsum(np.bincount(document, minlength=len(counts))))
            return [texts, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), listed), pa.array(counts), pa.array(hit)]

        rows = with_batches(rows, held, [F.col("words_of"), F.coalesce("matches", F.array().cast(f"array<{MATCH}>"))], f"words_of string, matches array<{MATCH}>, n_words long, n_hit long", make)
    return rows.select(*[F.col(k).alias(c) for k, c in zip(held, names)], "n_words", "n_hit", "matches")


def items_hit(matches: Column) -> Column:
    """The distinct item_ids of matches, sorted as strings."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(matches, lambda m: m["item_id"]), lambda i: i.isNotNull())))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those that hold a window of an item, all columns kept."""
    # Names as they were: an own column called n_hit stays.
    packed = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    return found(packed, items, ["row"], window).where("n_hit = 0").select(*[F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])


def op11_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = found(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    rows = rows.select("doc_id", "n_words", "n_hit", items_hit(F.col("matches")).alias("ids"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP11_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark WHERE text IS NOT NULL),
k AS (SELECT item_id, w, least(len(w), 10) AS k FROM i WHERE len(w) > 0),
a AS (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM k),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS t FROM a),
kinds AS (SELECT DISTINCT k FROM win),
b AS (SELECT r, kinds.k, w, unnest(range(1, len(w) - kinds.k + 2)) AS p FROM d, kinds WHERE len(w) >= kinds.k),
occ AS (SELECT r, b.k, p, item_id FROM (SELECT r, k, p, array_to_string(w[p : p + k - 1], ' ') AS t FROM b) b JOIN win ON b.k = win.k AND b.t = win.t),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM occ WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
