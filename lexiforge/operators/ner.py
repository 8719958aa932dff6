"""Tagged sentences: sub-token merge, alignment, taggers, spans, their scores and features.

Sentences are arrays of words with arrays of labels beside them; a fold over a sentence
stays in the JVM. Sentences are short, so a fold's list grows by appending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.operators import relational, sequences

SPECIAL = ("[CLS]", "[SEP]", "[PAD]")
#: Fixed value: the words a tokenizer makes of the marker of inline math.
MARKER = ("_", "inline", "_", "math", "_")
_WORDS = "cast(array() as array<struct<word:string,label:string>>)"


def once(value: Column, use) -> Column:
    """use(value), the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def zipped(words: Column, labels: Column) -> Column:
    return F.zip_with(words, labels, lambda w, l: F.struct(w.alias("word"), l.alias("label")))


def merge_subtokens(pieces: Column, special: tuple[str, ...] = SPECIAL) -> Column:
    """Words of '##' pieces (word, label), each with the label of its first piece; special tokens go."""

    def add(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(F.concat(last["word"], F.substring(p["word"], 3, 1 << 20)).alias("word"), last["label"].alias("label"))
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))
        return F.when(p["word"].startswith("##") & (F.size(acc) > 0), grown).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(F.filter(pieces, lambda p: ~p["word"].isin(*special)), F.expr(_WORDS), add)


def merge_marker(pieces: Column, marker: tuple[str, ...] = MARKER) -> Column:
    """Words (word, label) with every run of the marker's parts as one word, greedily from the left, under the first part's label."""
    n, joined = len(marker), "".join(marker)
    start = F.struct(F.expr(_WORDS).alias("out"), F.lit(0).alias("skip"))

    def add(acc: Column, i: Column, own: Column) -> Column:
        p = F.element_at(own, i)
        whole = F.transform(F.slice(own, i, n), lambda x: x["word"]) == F.array(*map(F.lit, marker))
        word = F.struct(F.when(whole, joined).otherwise(p["word"]).alias("word"), p["label"].alias("label"))
        kept = F.struct(F.concat(acc["out"], F.array(word)).alias("out"), F.when(whole, n - 1).otherwise(0).alias("skip"))
        return F.when(acc["skip"] > 0, F.struct(acc["out"].alias("out"), (acc["skip"] - 1).alias("skip"))).otherwise(kept)

    def fold(own: Column) -> Column:
        places = F.when(F.size(own) > 0, F.sequence(F.lit(1), F.size(own))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.aggregate(places, start, lambda acc, i: add(acc, i, own), lambda acc: acc["out"])

    return once(pieces, fold)


def align(pieces: Column, gold: Column) -> Column:
    """Pieces (word, label) run together until they equal the next gold word; its label is the highest of B, I, O among them. Pieces that never fit are left out."""
    start = F.struct(F.expr(_WORDS).alias("out"), F.lit("").alias("held"), F.lit("O").alias("label"))
    rank = lambda x: F.when(x == "B", 2).when(x == "I", 1).otherwise(0)

    def add(acc: Column, p: Column) -> Column:
        held = F.concat(acc["held"], p["word"])
        label = F.when(rank(p["label"]) > rank(acc["label"]), p["label"]).otherwise(acc["label"])
        done = F.struct(F.concat(acc["out"], F.array(F.struct(held.alias("word"), label.alias("label")))).alias("out"), F.lit("").alias("held"), F.lit("O").alias("label"))
        return F.when(held == F.get(gold, F.size(acc["out"])), done).otherwise(F.struct(acc["out"].alias("out"), held.alias("held"), label.alias("label")))

    return F.aggregate(pieces, start, add, lambda acc: acc["out"])


def runs(words: Column) -> Column:
    """Phrases of a tagged sentence (word, label): B begins one, I goes on or, after O, begins one; each phrase once, in order of first place."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit("O").alias("last"))

    def add(acc: Column, p: Column) -> Column:
        begins = (p["label"] == "B") | ((p["label"] == "I") & (acc["last"] == "O"))
        longer = F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(F.concat_ws(" ", F.element_at(acc["out"], -1), p["word"])))
        out = F.when(begins, F.concat(acc["out"], F.array(p["word"]))).when(p["label"] == "I", longer).otherwise(acc["out"])
        return F.struct(out.alias("out"), p["label"].alias("last"))

    return F.aggregate(words, start, add, lambda acc: F.array_distinct(acc["out"]))


def cropped_terms(pieces: Column) -> Column:
    """Terms of a sentence of sub-tokens: merged, markers joined, runs, each once."""
    return runs(merge_marker(merge_subtokens(pieces)))


def title_tags(words: Column, title: Column, exact: bool = False) -> Column:
    """B and I where the title's words stand, greedily and without case, O elsewhere; a word need only begin with the title's unless `exact`."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit(0).alias("left"))
    fits = lambda w, t: F.coalesce(F.lower(w) == t if exact else F.startswith(F.lower(w), t), F.lit(False))

    def add(acc: Column, i: Column, name: Column) -> Column:
        here = F.slice(words, i, F.greatest(F.size(name), F.lit(1)))
        hit = (F.size(name) > 0) & (F.size(here) == F.size(name)) & F.forall(F.zip_with(here, name, fits), lambda x: x)
        fresh = F.struct(F.concat(acc["out"], F.array(F.when(hit, "B").otherwise("O"))).alias("out"), F.when(hit, F.size(name) - 1).otherwise(0).alias("left"))
        return F.when(acc["left"] > 0, F.struct(F.concat(acc["out"], F.array(F.lit("I"))).alias("out"), (acc["left"] - 1).alias("left"))).otherwise(fresh)

    places = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.expr("cast(array() as array<int>)"))
    return once(F.filter(F.split(F.lower(title), r"\s+"), lambda t: t != ""), lambda name: F.aggregate(places, start, lambda acc, i: add(acc, i, name), lambda acc: acc["out"]))


def sentences(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep, sent_no, sentence): split behind a full stop, question or exclamation mark and white space."""
    cut = F.filter(F.split(F.col(text), r"(?<=[.!?])\s+"), lambda s: s != "")
    return rows.select(*keep, F.posexplode(cut).alias("sent_no", "sentence"))


def tagged_sentences(rows: DataFrame, text: str, title: str, *keep: str, exact: bool = False) -> DataFrame:
    """Sentences that hold the title, their words and tags."""
    found = sentences(rows, text, *keep, title).where(F.contains(F.lower("sentence"), F.lower(F.col(title))))
    found = found.withColumn("words", F.split("sentence", r"\s+"))
    return found.select(*keep, "sent_no", "words", title_tags(F.col("words"), F.col(title), exact).alias("tags"))


def spans(rows: DataFrame, group: str, place: str, tag: str) -> DataFrame:
    """(group, start, n): the chunks of tagged words."""
    return sequences.tag_runs(rows.withColumn("w", F.lit("")), group, place, "w", tag).select(group, "start", "n")


def chunk_score(gold: DataFrame, guessed: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of chunks, of which place and length must agree; 0 without cases."""
    met = relational.agreement(gold, guessed, keys)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("n_both"), F.col("n_both") + F.col("n_right")), ratio(F.col("n_both"), F.col("n_both") + F.col("n_left"))
    return met.select("n_both", "n_left", "n_right", p.alias("precision"), r.alias("recall"), ratio(2 * F.col("n_both"), 2 * F.col("n_both") + F.col("n_left") + F.col("n_right")).alias("f1"))


def entity_scores(rows: DataFrame, group: str, place: str, gold: str, guess: str, ignored: int = -100, outside: int = 0) -> DataFrame:
    """One row (precision, recall, f1, accuracy) of labelled words: those with the gold label `ignored` are left out first; then runs of any label but `outside` are entities, of which place and length must agree."""
    left = rows.where((F.col(gold) != ignored) | F.col(gold).isNull()).select(group, place, *[F.coalesce(F.col(c) != outside, F.lit(False)).alias(k) for c, k in ((gold, "in_gold"), (guess, "in_guess"))])
    runs = {k: spans(sequences.bio_tags(left, group, place, k), group, place, "bio") for k in ("in_gold", "in_guess")}
    right = left.agg(F.avg((F.col("in_gold") == F.col("in_guess")).cast("double")).alias("accuracy"))
    scores = chunk_score(runs["in_gold"], runs["in_guess"], [group, "start", "n"])
    return scores.crossJoin(right).select("precision", "recall", "f1", "accuracy")  # a row each


def span_scores(rows: DataFrame, group: str, place: str, tag: str) -> DataFrame:
    """(group, text, score, start, stop) of rows with word, prob, begin, end: each chunk's text, mean probability and offsets."""
    order = Window.partitionBy(group).orderBy(place)
    begins = (F.col(tag) == "B") | ((F.col(tag) == "I") & (F.coalesce(F.lag(tag).over(order), F.lit("O")) == "O"))
    marked = rows.withColumn("run", F.sum(begins.cast("int")).over(order)).where(F.col(tag) != "O")
    words = F.transform(F.array_sort(F.collect_list(F.struct(place, "word"))), lambda x: x["word"])
    return marked.groupBy(group, "run").agg(F.array_join(words, " ").alias("text"), F.avg("prob").alias("score"), F.min("begin").alias("start"), F.max("end").alias("stop")).drop("run")


def tagged_by_score(words: Column, scores: Column, cut: float) -> Column:
    """Tags of as many words as there are, from scores that may be padded: over the cut is in a chunk."""
    flags = F.transform(F.slice(scores, F.lit(1), F.size(words)), lambda s: s > cut)
    return F.transform(flags, lambda f, i: F.when(~f, "O").when((i > 0) & F.coalesce(F.get(flags, i - 1), F.lit(False)), "I").otherwise("B"))


def window_features(rows: DataFrame, group: str, place: str, word: str, reach: int = 3) -> DataFrame:
    """Adds the words up to `reach` before and after, and shape flags of the word and its neighbours."""
    order = Window.partitionBy(group).orderBy(place)
    out = {}
    for d in range(1, reach + 1):
        out[f"prev_{d}"], out[f"next_{d}"] = F.lag(word, d).over(order), F.lead(word, d).over(order)
    caps = lambda c: F.coalesce(c.rlike("^[A-Z]"), F.lit(False))
    out |= {"caps": caps(F.col(word)), "prev_caps": caps(F.lag(word).over(order)), "next_caps": caps(F.lead(word).over(order)), "ascii": ~F.col(word).rlike(r"[^\x00-\x7f]"), "dash": F.contains(F.col(word), F.lit("-"))}
    return rows.withColumns(out)
