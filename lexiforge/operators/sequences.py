"""Ordered analytics: running vocabularies, tag runs, bigram scores and phrase joining."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.operators.stats import offsets
from lexiforge.operators.stored import Rounds


def running_vocabulary(terms: DataFrame, place: str, term: str) -> DataFrame:
    """(place, total, distinct_terms, ratio): uses and different terms up to each place.

    Sums per place first, then per range of places: only ranges are summed in one task.
    """
    uses = terms.groupBy(place).agg(F.count("*").alias("n"))
    new = terms.groupBy(term).agg(F.min(place).alias(place)).groupBy(place).agg(F.count("*").alias("fresh"))
    per = uses.join(new, place, "left").select(place, "n", F.coalesce("fresh", F.lit(0)).alias("fresh"))
    out = offsets(per, place, "n", "fresh").select(place, (F.col("before_n") + F.col("n")).alias("total"), (F.col("before_fresh") + F.col("fresh")).alias("distinct_terms"))
    return out.withColumn("ratio", F.col("total") / F.col("distinct_terms"))


def bio_tags(rows: DataFrame, group: str, place: str, flag: str) -> DataFrame:
    """Adds bio: B where a run of true flags begins, I inside, O elsewhere."""
    before = F.coalesce(F.lag(flag).over(Window.partitionBy(group).orderBy(place)), F.lit(False))
    return rows.withColumn("bio", F.when(~F.col(flag), "O").when(before, "I").otherwise("B"))


def tag_runs(rows: DataFrame, group: str, place: str, word: str, tag: str) -> DataFrame:
    """(group, start, n, phrase): words of each run; B always begins one, I begins one after O."""
    order = Window.partitionBy(group).orderBy(place)
    begins = (F.col(tag) == "B") | ((F.col(tag) == "I") & (F.coalesce(F.lag(tag).over(order), F.lit("O")) == "O"))
    marked = rows.withColumn("_run", F.sum(begins.cast("int")).over(order)).where(F.col(tag) != "O")
    words = F.transform(F.array_sort(F.collect_list(F.struct(place, word))), lambda x: x[word])
    return marked.groupBy(group, "_run").agg(F.min(place).alias("start"), F.count("*").alias("n"), F.array_join(words, " ").alias("phrase")).drop("_run")


def bigram_scores(lines: DataFrame, tokens: str, least: int = 5) -> DataFrame:
    """(a, b, n, score): (n - least) / n_a / n_b * n_words for neighbours within a line."""
    words = lines.select(F.explode(tokens).alias("w"))
    counts = words.groupBy("w").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n_words"))
    pairs = lines.select(F.explode(F.arrays_zip(F.expr(f"slice({tokens}, 1, greatest(size({tokens}) - 1, 0))").alias("a"), F.expr(f"slice({tokens}, 2, greatest(size({tokens}) - 1, 0))").alias("b"))).alias("p"))
    seen = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    one, two = counts.select(F.col("w").alias("a"), F.col("c").alias("ca")), counts.select(F.col("w").alias("b"), F.col("c").alias("cb"))
    scored = seen.join(one, "a").join(two, "b").crossJoin(F.broadcast(total))
    return scored.select("a", "b", "n", ((F.col("n") - least) / F.col("ca") / F.col("cb") * F.col("n_words")).alias("score"))


def join_phrases(rows: DataFrame, tokens: str, phrases: list[tuple[str, ...]], longest_first: bool = True) -> DataFrame:
    """Adds joined: tokens with known phrases joined by '_', greedily from the left.

    The phrase list is a vocabulary the caller holds; it travels inside the function.
    """
    by_first: dict[str, list[tuple[str, ...]]] = {}
    for phrase in phrases:
        if len(phrase) < 2:
            raise ValueError("a phrase has two words or more")
        by_first.setdefault(phrase[0], []).append(tuple(phrase))
    for known in by_first.values():
        known.sort(key=lambda p: (-len(p) if longest_first else len(p), p))

    def joined(words: list[str]) -> str:
        out, at = [], 0
        while at < len(words):
            hit = next((p for p in by_first.get(words[at], ()) if tuple(words[at : at + len(p)]) == p), (words[at],))
            out.append("_".join(hit))
            at += len(hit)
        return " ".join(out)

    def batches(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in it:
            yield column.map(lambda words: None if words is None else joined(list(words)))

    return rows.withColumn("joined", F.pandas_udf(batches, "string")(F.col(tokens)))


def join_pairs(rows: DataFrame, row_id: str, tokens: str, pairs: DataFrame) -> DataFrame:
    """Adds joined: tokens with the neighbours in `pairs` (a, b) joined by '_', greedily from the left.

    The pairs are met by a join, so that there may be any number of them; they are stored first,
    so that Spark knows their size and broadcasts few: then the places stay where they are.
    """
    pairs = Rounds(rows.sparkSession, "pairs").save(pairs.select("a", "b").distinct())
    keyed = rows.withColumn("_key", F.xxhash64(row_id, tokens))
    size = F.greatest(F.size(tokens) - 1, F.lit(0))
    both = F.arrays_zip(F.slice(tokens, F.lit(1), size).alias("a"), F.slice(tokens, F.lit(2), size).alias("b"))
    places = keyed.select(row_id, "_key", F.posexplode(both).alias("at", "p")).select(F.col(row_id).alias("_id"), F.col("_key").alias("_own"), "at", "p.a", "p.b")
    hits = places.join(pairs, ["a", "b"]).groupBy("_id", "_own").agg(F.collect_set("at").alias("_hits"))

    def joined(words: list[str], hits: set[int]) -> str:
        out, at = [], 0
        while at < len(words):
            n = 2 if at in hits else 1
            out.append("_".join(words[at : at + n]))
            at += n
        return " ".join(out)

    def batches(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for words, hits in it:
            yield pd.Series([None if w is None else joined(list(w), set(h) if h is not None else set()) for w, h in zip(words, hits)], dtype=object)

    met = keyed.join(hits, F.col(row_id).eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_own")), "left")
    return met.withColumn("joined", F.pandas_udf(batches, "string")(F.col(tokens), F.col("_hits"))).drop("_key", "_id", "_own", "_hits")


def tag_title(rows: DataFrame, tokens: str, title: str) -> DataFrame:
    """Adds tags: BIO of the title's words found in the tokens, by prefix and without case, greedy."""

    def tagged(words: list[str], name: str) -> list[str]:
        wanted, out, at = name.lower().split(), [], 0
        while at < len(words):
            part = [w.lower() for w in words[at : at + len(wanted)]]
            if wanted and len(part) == len(wanted) and all(w.startswith(t) for w, t in zip(part, wanted)):
                out += ["B"] + ["I"] * (len(wanted) - 1)
                at += len(wanted)
            else:
                out.append("O")
                at += 1
        return out

    def batches(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for words, names in it:
            yield pd.Series([tagged(list(w), n or "") if w is not None else None for w, n in zip(words, names)])

    return rows.withColumn("tags", F.pandas_udf(batches, "array<string>")(F.col(tokens), F.col(title)))


def merge_subtokens(pieces: list[str], labels: list[str], special: tuple = ("[CLS]", "[SEP]", "[PAD]")) -> list[tuple[str, str]]:
    """Words of '##' pieces, each with the label of its first piece."""
    out: list[tuple[str, str]] = []
    for piece, label in zip(pieces, labels):
        if piece in special:
            continue
        if piece.startswith("##") and out:
            out[-1] = (out[-1][0] + piece[2:], out[-1][1])
        else:
            out.append((piece, label))
    return out


def cooccurrence(rows: DataFrame, doc: str, tokens: str, window: int) -> DataFrame:
    """(a, b, n) for words at most `window` places apart, the earlier first."""
    # Lists laid beside themselves, in generated code, not by a function called for each place.
    beside = [F.arrays_zip(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - d, F.lit(0))).alias("a"), F.slice(tokens, F.lit(d + 1), F.greatest(F.size(tokens) - d, F.lit(0))).alias("b")) for d in range(1, window + 1)]
    held = rows.select(F.explode(F.array(tokens)).alias(tokens))
    return held.select(F.explode(F.concat(*beside)).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
