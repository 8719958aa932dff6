"""Chunks of sentences by a greedy tagger: its own last tags are features of the next word.

Words within three places, their stems and word classes, and shape flags are hashed into one table of weights, which is
fitted as a multinomial logistic regression with the gold tags as history. Each round passes over all training sentences:
every task goes on from the last table by AdaGrad on its own sentences, then the tasks' tables are averaged by words
(McDonald, Hall and Mann, 2010). Tagging runs on Arrow batches: the words' own scores are sums over the table, then all
sentences of a batch are decoded together, place by place.

Defined cases: a null sentence has null tags, an empty one none; a null word or class counts as an empty one; a training
sentence without tags, or with another number of them than words, is left out; without training sentences every tag is O;
ties go to the tag that sorts first.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.operators.stored import Rounds

REACH, OUTSIDE, MOST_TAGS = 3, "O", 100
#: Sentences that a task tags or learns from at once, and words of a stored part of the training sentences on average.
PART, SHARE = 512, 1_000_000
#: Words of a training step and its rate; pieces that tables are averaged in.
STEP, RATE, PIECES = 1024, 0.1, 64
#: Rounds end when the mean loss of a word is under GOOD, or when IDLE in a row didn't take the share LEAST off the least one.
GOOD, IDLE, LEAST = 0.01, 4, 0.05
#: The marker words of formulas.
FORMULAS = ("_inline_math_", "_display_math_")
_FLAGS = 6  # of one word: ASCII, dash, dot, all capitals, capital first, formula


def stem(word: str) -> str:
    """A word in lower case without a common ending, of which at least three letters stay."""
    return re.sub(r"(?<=\w{3})(?:ing|ed|ly|es|s)$", "", word.lower())


@lru_cache(maxsize=1 << 16)
def _known(word: str, stemmed: Callable[[str], str]) -> tuple[int, int, int]:
    """Hash of the word, hash of its stem, its flags as bits."""
    upper = word == word.upper() and word != word.lower()
    flags = (word.isascii(), "-" in word, "." in word, upper, word[:1].isupper(), word in FORMULAS)
    return zlib.crc32(word.encode()), zlib.crc32(stemmed(word).encode()), sum(1 << k for k, f in enumerate(flags) if f)


def _slot(value: np.ndarray, kind: int, width: int) -> np.ndarray:
    """The table's place for a value of a kind of feature."""
    mixed = (value.astype(np.uint64) + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(width)).astype(np.int64)


def _history(n_tags: int, width: int) -> np.ndarray:
    """Places [distance, tag] of the last tags; tag n_tags stands before the sentence."""
    return np.stack([_slot(np.arange(n_tags + 1), 100 + d, width) for d in range(REACH)])


def _own(words: Sequence[Sequence], classes: Sequence[Sequence], width: int, stemmed: Callable[[str], str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Places of the words' own features, one array for each kind over all words of all sentences, and where each sentence begins."""
    gap, known, coded = [None] * REACH, {}, {}
    flat, marks, at = list(gap), list(gap), []
    for ws, cs in zip(words, classes):
        at.append(len(flat))
        flat += [w or "" for w in ws] + gap
        marks += [c or "" for c in cs] + gap
    for w in set(flat):
        known[w] = (0, 0, 0) if w is None else _known(w, stemmed)
    for c in set(marks):
        coded[c] = 0 if c is None else zlib.crc32(c.encode())
    # Places are worked out for each different word, then looked up.
    table, code = np.array(list(known.values()), dtype=np.uint64).reshape(-1, 3), np.array(list(coded.values()), dtype=np.uint64)
    at_word, at_class = {w: i for i, w in enumerate(known)}, {c: i for i, c in enumerate(coded)}
    word_no = np.fromiter((at_word[w] for w in flat), dtype=np.int64, count=len(flat))
    class_no = np.fromiter((at_class[c] for c in marks), dtype=np.int64, count=len(marks))
    real = np.flatnonzero(word_no != at_word[None])
    places, kind = [], 0
    for d in range(-REACH, REACH + 1):
        views = [(table[:, 0], word_no), (code, class_no)] + ([(table[:, 1], word_no)] if abs(d) <= 1 else [])
        for v, no in views:
            places.append(_slot(v, kind, width)[no[real + d]])
            kind += 1
    for d in (-1, 0, 1):
        for k in range(_FLAGS):
            places.append(_slot((table[:, 2] >> np.uint64(k)) & np.uint64(1), kind, width)[word_no[real + d]])
            kind += 1
    # Places are counted without the gaps from here on.
    return places, np.array([a - REACH * (i + 1) for i, a in enumerate(at)], dtype=np.int64)


def _classes(words: list, classes: list | None) -> list[list]:
    if classes is None:
        return [[""] * len(w) for w in words]
    return [[*list(c)[: len(w)], *[""] * (len(w) - len(c))] if c is not None else [""] * len(w) for w, c in zip(words, classes)]


def decode(own: np.ndarray, starts: np.ndarray, sizes: np.ndarray, past: np.ndarray) -> np.ndarray:
    """Tag numbers of all words from their own scores [word, tag] and scores past[distance, last tag, tag]."""
    n_tags = own.shape[1]
    out = np.zeros(len(own), dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    last = np.full((REACH, len(starts)), n_tags)
    for place in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -place, side="left"))  # sentences longer than the place
        last = last[:, :live]
        score = own[starts[:live] + place]
        for d in range(REACH):
            score = score + past[d][last[d]]
        tag = score.argmax(axis=1)
        out[starts[:live] + place] = tag
        last = np.vstack([tag[None, :], last[:-1]])
    return out


class Chunker:
    """A fitted tagger: tags, weights [place, tag] of a table of fixed width, and a bias for each tag."""

    def __init__(self, tags: list[str], weights: np.ndarray, bias: np.ndarray, stemmed: Callable[[str], str] = stem):
        self.tags, self.weights, self.bias, self.stemmed = tags, weights, bias, stemmed

    def tag(self, words: Column, classes: Column | None = None) -> Column:
        """Tags of a sentence of words, with their word classes if the tagger was fitted on such."""
        names, weights, bias, stemmed = np.array(self.tags, dtype=object), self.weights, self.bias, self.stemmed
        width = len(weights)
        past = weights[_history(len(names), width)]

        def tagged(sentences: pd.Series, marks: pd.Series | None) -> pd.Series:
            given = [[] if s is None else list(s) for s in sentences]
            places, starts = _own(given, _classes(given, None if marks is None else list(marks)), width, stemmed)
            sizes = np.array([len(s) for s in given], dtype=np.int64)
            own = np.tile(bias, (int(sizes.sum()), 1))
            for p in places:
                own += weights[p]
            found = names[decode(own, starts, sizes, past)] if len(own) else np.array([], dtype=object)
            return pd.Series([None if s is None else list(found[a : a + n]) for s, a, n in zip(sentences, starts, sizes)], dtype=object)

        with_classes = classes is not None

        def parts(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                for begin in range(0, len(columns[0]), PART):
                    some = [c.iloc[begin : begin + PART] for c in columns]
                    yield tagged(*some) if with_classes else tagged(some[0], None)

        parts.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
        return F.pandas_udf(parts, "array<string>")(words, classes if with_classes else F.lit(None).cast("string"))


def _learn(places: np.ndarray, gold: np.ndarray, table: np.ndarray, sums: np.ndarray) -> float:
    """A step on some words by their places and tag numbers, which changes the table and its sums of squares; the loss before it."""
    score = table[places].sum(axis=1)
    score -= score.max(axis=1, keepdims=True)
    chance = np.exp(score)
    chance /= chance.sum(axis=1, keepdims=True)
    each = np.arange(len(gold))
    loss = -np.log(np.maximum(chance[each, gold], 1e-300)).sum()
    chance[each, gold] -= 1.0
    flat, n = places.ravel(), places.shape[1]
    used = np.flatnonzero(np.bincount(flat, minlength=len(table)))
    slope = np.stack([np.bincount(flat, weights=np.repeat(chance[:, k], n), minlength=len(table))[used] for k in range(table.shape[1])], axis=1)
    sums[used] += slope * slope
    table[used] -= RATE * slope / np.sqrt(sums[used])
    return float(loss)


def fit(rows: DataFrame, words: str, tags: str, classes: str | None = None, width: int = 1 << 16, penalty: float = 1e-5, rounds: int = 50, stemmed: Callable[[str], str] = stem) -> Chunker:
    """A tagger taught by all sentences (words, tags), each different one once, in at most so many rounds. Its table has `width` places a tag and doesn't grow with the words."""
    good = rows.where(F.size(words) == F.size(tags)).where(~F.exists(tags, lambda t: t.isNull()))
    mark = F.col(classes) if classes else F.lit(None).cast("array<string>")
    good = good.select(F.col(words).alias("w"), F.col(tags).alias("t"), mark.alias("c"))
    kept = Rounds(rows.sparkSession, "chunker")
    # Words are counted here, so that sentences are dealt once; they lie in an order of their own, whatever order they came in.
    parts = max(1, -(-(good.agg(F.sum(F.size("w"))).first()[0] or 0) // SHARE))
    drawn = kept.save(good.repartition(parts, "w", "t").groupBy("w", "t").agg(F.min("c").alias("c")).sortWithinPartitions(F.xxhash64("w", "t"), "w", "t"))
    names = sorted(r[0] for r in drawn.select(F.explode("t")).distinct().limit(MOST_TAGS + 1).collect())
    if len(names) > MOST_TAGS:
        kept.keep(0)
        raise ValueError(f"more than {MOST_TAGS} different tags")
    if len(names) < 2:
        kept.keep(0)
        return Chunker(names or [OUTSIDE], np.zeros((width, 1)), np.zeros(1), stemmed)
    before, number = _history(len(names), width), {t: k for k, t in enumerate(names)}

    def points(sentences: pd.Series, gold: pd.Series, marks: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Places of all words, that of the bias last, and their tag numbers."""
        given, gap = [list(s) for s in sentences], [len(names)] * REACH
        places, _ = _own(given, _classes(given, list(marks)), width, stemmed)
        seen = np.array([n for g in gold for n in (*gap, *(number[t] for t in g))], dtype=np.int64)
        real = np.flatnonzero(seen != len(names))
        past = [before[d][seen[real - 1 - d]] for d in range(REACH)]
        return np.stack([*places, *past, np.full(len(real), width)], axis=1), seen[real]

    def passed(table: np.ndarray, sums: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, squares, loss, n = table.copy(), sums.copy(), 0.0, 0
            for some in batches:
                for begin in range(0, len(some), PART):
                    cut = some.iloc[begin : begin + PART]
                    places, gold = points(cut["w"], cut["t"], cut["c"])
                    for a in range(0, len(gold), STEP):
                        loss += _learn(places[a : a + STEP], gold[a : a + STEP], own, squares)
                        own[:-1] *= 1 - RATE * penalty
                    n += len(gold)
            if n:
                pieces = enumerate(np.array_split(np.stack([own, squares], axis=1) * n, PIECES))
                yield pd.DataFrame([(k, p.tobytes(), loss, n) for k, p in pieces], columns=["piece", "data", "loss", "n"])

        return part

    def summed(some: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(d) for d in some.sort_values(["n", "loss", "data"])["data"]], axis=0)
        return pd.DataFrame([(some["piece"].iloc[0], total.tobytes(), some["loss"].sum(), some["n"].sum())], columns=some.columns)

    table, sums, best, idle = np.zeros((width + 1, len(names))), np.ones((width + 1, len(names))), np.inf, 0
    schema = "piece int, data binary, loss double, n long"
    for _ in range(rounds):
        found = drawn.mapInPandas(passed(table, sums), schema).groupBy("piece").applyInPandas(summed, schema).collect()
        n = found[0]["n"]
        whole = np.concatenate([np.frombuffer(r["data"]) for r in sorted(found)]).reshape(width + 1, 2, len(names)) / n
        table, sums, loss = whole[:, 0], whole[:, 1], found[0]["loss"] / n
        idle = idle + 1 if loss > (1 - LEAST) * best else 0
        best = min(best, loss)
        if loss < GOOD or idle == IDLE:
            break
    kept.keep(0)
    return Chunker(names, table[:width].copy(), table[width].copy(), stemmed)
