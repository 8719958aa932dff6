"""Operator 3: fuzzy line dedup by MinHash, keeping one line of each component (native).

A line is lower-cased and its white space collapsed. Lines that are then equal are one
line. A shingle is a run of characters that starts at any character; a line shorter than
a run is its own shingle. ROWS x BANDS minima of hashed shingles of SIGNED characters give
BANDS keys; lines that share a key are candidates. Signatures come from generated code: a
row for each shingle, hashed once, and the minimum of its exclusive or with each constant.
They are drawn by content: of a line longer than BOTH[0] characters the quarter of the
shingles whose hash ends in two zero bits, and the first; of a line of up to BOTH[1] all.
Lines between have both, and two lines whose lengths differ by no more than a fifth
share one kind.
Shingles of five characters as in verification would meet in most long lines of one
language: on 40,000 lines they made 22 times the candidates. Candidates of which fewer
than AGREE of the minima agree go; of pairs of 0.8 or more under one in a hundred do.

Each candidate is compared with one leader of the bucket. Lines that are then in one
component need no further pair. In buckets of more than FEW lines those outside the largest
component meet HELPERS lines of it. Of those left in a bucket all pairs are candidates: in
buckets of at most SMALL lines their signatures are compared, each pair in the first bucket
it shares, and only pairs that agree are written; in larger ones lines meet through an exact
prefix filter on rare shingles, so a passage that any number of lines share makes no pairs.
Both ways lead to the same components. Sizes and parity bits of the shingle sets of lines
that share a bucket are kept; pairs whose bits show that they can't reach the threshold go
before their texts are met. Pairs whose exact Jaccard coefficient of
whole shingle sets is at least `threshold` are edges; components, found by distributed
union-find, keep their first line, by (doc_id, line number).

Line ids are 64-bit hashes of the normalised line.

Defined cases: null text has no line; lines that are empty once normalised are never
duplicates; rows that agree in doc_id and text are one document; null doc_id sorts
first; `apply` leaves a document that had lines and lost all of them out, and keeps
every other row and column, whatever the names of the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import Scratch, components, packed, text_key, unpacked

#: Characters of a shingle in verification and in signatures.
SPAN, SIGNED = 5, 8
ROWS, BANDS = 3, 8
#: Minima, of ROWS x BANDS, in which a candidate must agree; FIELD bits of each are compared.
AGREE, FIELD = 13, 5
THRESHOLD = 0.8
#: Lines longer than the first length have a signature of drawn shingles, lines up to the second one of all.
BOTH = (120, 150)
#: Blank, the other ASCII white space and the no-break space.
WHITE = " \t\n\x0b\f\r\xa0"
#: In buckets of at most so many lines beside the leader signatures are compared pair by pair.
SMALL = 512
#: In buckets of more than FEW lines those outside the largest component meet so many lines of it first.
FEW, HELPERS = 32, 16
#: Shingles of a prefix that are compared so that a pair meets once.
EARLIER = 24
#: Words of 64 parity bits of a line's shingles.
PARITIES = 16
MARKS = [f"p{i}" for i in range(PARITIES)]
_RUNS = rf"(?s)(?=(.{{{SPAN}}}))"


def normalised(text: Column) -> Column:
    """The text in lower case, runs of white space other than line ends as one blank; lines are trimmed once cut."""
    # Most texts have single blanks only: a search of bytes spares them the pattern.
    odd = text.contains("  ")
    for white in WHITE[1:].replace("\n", ""):
        odd = odd | text.contains(white)
    blanks = WHITE.replace("\n", "")
    return F.lower(F.when(odd, F.regexp_replace(text, f"[{blanks}]++", " ")).otherwise(text))


def _located(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_key, line_no, line_id, line) of all lines that are not empty."""
    # Whole texts are normalised, once: a condition on normalised lines would be pushed below and work them out twice.
    cut = F.split(normalised(F.col("text")), "\n")
    lines = docs.select("doc_id", text_key().alias("doc_key"), F.posexplode(cut).alias("line_no", "line"))
    lines = lines.withColumn("line", F.trim("line")).where("line <> ''")
    return lines.withColumn("line_id", F.xxhash64("line"))


def distinct_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(line_id, line, n, first): each line, how often it occurs and where first; stored by line_id, so that later steps don't move it."""
    place = F.struct("doc_id", "doc_key", "line_no")
    found = _located(docs).groupBy("line_id").agg(F.first("line").alias("line"), F.count("*").alias("n"), F.min(place).alias("first"))
    return scratch.save(found, "lines", by="line_id")


def _signed(lines: DataFrame, drawn: bool) -> DataFrame:
    """(line_id, keys, kind, s0, s1): the band keys of lines that are not empty and FIELD bits of each minimum, packed."""
    coded = lines.select("line_id", F.encode("line", "UTF-32").alias("points"), F.length("line").alias("n"))
    rows = coded.select("line_id", "points", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - SIGNED, F.lit(0)))).alias("at"))
    hashed = rows.select("line_id", "n", "at", F.xxhash64(F.substring("points", 4 * F.col("at") + 1, F.lit(4 * SIGNED))).alias("h"))
    if drawn:
        hashed = hashed.where("h & 3 = 0 or at = 0")
    # Constants whose top bits all differ, so that no two minima look at the same part of the hashes.
    n = ROWS * BANDS
    constants = [(((i << 64) // n) ^ (0x9E3779B97F4A7C15 * (i + 1) % (1 << 58))) - (1 << 63) for i in range(n)]
    least = hashed.groupBy("line_id").agg(F.max("n").alias("n"), *[F.min(F.col("h").bitwiseXOR(F.lit(c))).alias(f"m{i}") for i, c in enumerate(constants)])
    keys = F.array(*[F.xxhash64(F.lit(b), *[f"m{i}" for i in range(b, n, BANDS)]) for b in range(BANDS)])

    def pack(some: range) -> Column:
        word = F.lit(0).cast("long")
        for at, i in enumerate(some):
            word = word.bitwiseOR(F.shiftleft(F.shiftright(f"m{i}", 8).bitwiseAND(F.lit((1 << FIELD) - 1)), FIELD * at))
        return word

    kind = F.lit(0 if drawn else 1)
    alone = F.col("n") > BOTH[1] if drawn else F.col("n") <= BOTH[0]
    return least.select("line_id", keys.alias("keys"), kind.alias("kind"), alone.alias("alone"), pack(range(n // 2)).alias("s0"), pack(range(n // 2, n)).alias("s1"))


def _agree() -> Column:
    """Whether the signatures of a and b, if they are of one kind, agree in enough minima; lines that have no kind in common are let through."""
    mask = F.lit(sum(1 << (FIELD * i) for i in range(ROWS * BANDS // 2)))

    def unlike(x: Column) -> Column:
        any_bit = x
        for i in range(1, FIELD):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, i))
        return F.bit_count(any_bit.bitwiseAND(mask))

    differ = unlike(F.col("a0").bitwiseXOR(F.col("b0"))) + unlike(F.col("a1").bitwiseXOR(F.col("b1")))
    return F.when(F.col("kind") == F.col("kind_b"), differ <= ROWS * BANDS - AGREE).otherwise(F.col("alone") & F.col("alone_b"))


def _one(signed: DataFrame, name: str, *more: str) -> DataFrame:
    return signed.select(F.col("line_id").alias(name), "kind", "alone", F.col("s0").alias("a0"), F.col("s1").alias("a1"), *more)


def _other() -> list[Column]:
    """The signature of `_one` as that of the other line."""
    return [F.col(a).alias(b) for a, b in (("kind", "kind_b"), ("alone", "alone_b"), ("a0", "b0"), ("a1", "b1"))]


def _other_set() -> list[Column]:
    """The size and the parity bits as those of the other line."""
    return [F.col("size").alias("other_size"), *[F.col(p).alias(f"other_{p}") for p in MARKS]]


def _parities() -> list[Column]:
    """Aggregates: each hashed shingle `h` turns over one of the parity bits."""
    bit, word = F.expr("shiftleft(1L, cast(h & 63 as int))"), F.shiftrightunsigned("h", 6) % PARITIES
    return [F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(p) for i, p in enumerate(MARKS)]


def _differ() -> Column:
    """So many shingles at least are in one of the two lines only: where their parity bits differ, one has a shingle that the other lacks."""
    return sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"other_{p}"))) for p in MARKS), F.lit(0))


def _within(differ: Column, threshold: float) -> Column:
    """Whether two sets of which so many shingles differ may reach the threshold t: (a + b) (1 - t) / (1 + t) differ at most for sizes a and b."""
    return differ <= (F.col("size") + F.col("other_size")) * ((1 - threshold) / (1 + threshold)) + 1e-6


def marked(signed: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(line_id, kind, alone, s0, s1, size, p0...): the signatures of the lines of `texts`, sizes and parity bits of their shingle sets."""
    runs = texts.select("line_id", F.explode(F.array_distinct(shingles(F.col("line")))).alias("run")).select("line_id", F.xxhash64("run").alias("h"))
    sets = runs.groupBy("line_id").agg(F.count("*").cast("int").alias("size"), *_parities())
    return scratch.save(signed.drop("keys").join(sets.hint("shuffle_hash"), "line_id"), "marks", by="line_id")


def signatures(lines: DataFrame, scratch: Scratch) -> DataFrame:
    length = F.length("line")
    return scratch.save(_signed(lines.where(length > BOTH[0]), True).union(_signed(lines.where(length <= BOTH[1]), False)), "signed", by="line_id")


def _buckets(signed: DataFrame) -> DataFrame:
    """(key, leader, line_id) for the lines of buckets that hold two or more; the leader is one of them, without a row of its own."""
    keys = signed.select(F.explode("keys").alias("key"), "line_id")
    # Dealt by key once: the leader is found where its bucket lies.
    banded = keys.withColumn("leader", F.max("line_id").over(Window.partitionBy("key")))
    return banded.where("line_id <> leader").select("key", "leader", "line_id")


def _likely(pairs: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """(a, b, na, nb): the pairs whose signatures agree and whose parity bits allow the threshold, and the sizes of their sets."""
    two = _one(marks, "b", "size", *MARKS).select("b", *_other(), *_other_set())
    met = pairs.join(_one(marks, "a", "size", *MARKS), "a").join(two, "b")
    return met.where(_agree() & _within(_differ(), threshold)).select("a", "b", F.col("size").alias("na"), F.col("other_size").alias("nb")).distinct()


def _runs(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(_RUNS), F.lit(1))


def shingles(line: Column) -> Column:
    return F.when(F.length(line) < SPAN, F.array(line)).otherwise(_runs(line))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b, na, nb) whose Jaccard coefficient of shingle sets, of na and nb shingles, reaches the threshold."""
    pairs = pairs.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)
    for end in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("line_id").alias(end), F.col("line").alias(f"l{end}")), end)
    shared = F.col("na") - F.size(F.array_except(shingles(F.col("la")), shingles(F.col("lb"))))
    # Exploded as one row, so that no condition works it out again.
    rows = pairs.select("a", "b", "na", "nb", F.explode(F.array(shared)).alias("shared"))
    return rows.where(F.col("shared") >= threshold * (F.col("na") + F.col("nb") - F.col("shared")) - 1e-9).select("a", "b")


def _prefix_pairs(some: DataFrame, large: DataFrame, texts: DataFrame, marks: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b, na, nb) of an `open` line and any other of `some` (line_id, label, open), labels unlike, that may reach the threshold and share a bucket of `large` (key, line_id).

    Two sets within the threshold share one of their first size - ceil(threshold * size) + 1
    shingles in any common order. The order is by the number of lines that hold a shingle, so
    passages that many lines share come last. Shingles of one line alone, or of no open line,
    come first and can't be shared by such a pair: they are only counted.

    Each other shingle of a line turns over one of its parity bits. Where the bits of two lines
    differ, one line has a shingle that the other lacks, so a pair of which too many differ is
    not within the threshold and isn't written.
    """
    # Lines are exchanged, not their many shingles.
    held = some.join(texts, "line_id").select("line_id", "label", "open", F.explode(F.array(F.array_distinct(shingles(F.col("line"))))).alias("held"))
    tokens = held.select("line_id", "label", "open", F.size("held").alias("size"), F.explode("held").alias("h")).withColumn("h", F.xxhash64("h"))
    tokens = scratch.save(tokens, "tokens")
    # Counted where they lie, a row for each shingle of a line, not joined with counts.
    alike = Window.partitionBy("h")
    shared = tokens.withColumn("n", F.count("*").over(alike)).withColumn("any_open", F.max("open").over(alike)).where("n > 1 and any_open")
    known = shared.groupBy("line_id", "label", "open", "size").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("known"), *_parities())
    first = F.col("size") - F.ceil(threshold * F.col("size") - 1e-9) + 1 - (F.col("size") - F.size("known"))
    prefix = known.withColumn("first", first.cast("int")).where("first > 0").select("line_id", "label", "open", "size", *MARKS, F.size("known").alias("held"), F.transform(F.slice("known", F.lit(1), F.col("first")), lambda t: t["h"]).alias("ids"), F.posexplode(F.slice("known", F.lit(1), F.col("first"))).alias("at", "t"))
    # What a set can share if this is the first shared shingle: itself and those after it.
    prefix = prefix.withColumn("most", F.col("held") - F.col("at"))
    # A pair meets at its first shared shingle; the first EARLIER of each tell, and what they don't tell is made distinct.
    prefix = prefix.select("line_id", "label", "open", "size", "held", *MARKS, "most", F.slice("ids", F.lit(1), F.least("at", F.lit(EARLIER))).alias("earlier"), F.col("t.h").alias("h"))
    # Unlike lines share short shingles: only those of one bucket meet. A line has as many keys as there are bands, twice that at most.
    keys = large.groupBy("line_id").agg(F.collect_set("key").alias("keys"))
    prefix = scratch.save(prefix.join(_one(marks, "line_id"), "line_id").join(keys, "line_id"), "prefix")
    other = prefix.select("h", F.col("line_id").alias("other"), F.col("held").alias("other_held"), *_other_set(), F.col("most").alias("other_most"), F.col("label").alias("other_label"), F.col("open").alias("other_open"), F.col("keys").alias("other_keys"), F.col("earlier").alias("other_earlier"), *_other())
    most = F.least("most", "other_most")
    fit = most >= threshold * (F.col("size") + F.col("other_size") - most) - 1e-9
    # Shingles that are only counted are in one of the two lines; of the others at least so many are.
    alone = F.col("size") - F.col("held") + F.col("other_size") - F.col("other_held")
    fit = fit & _within(alone + _differ(), threshold)
    # Two open lines meet once.
    once = (F.col("line_id") < F.col("other")) | ~F.col("other_open")
    met = prefix.where("open").join(other, "h").where((F.col("label") != F.col("other_label")) & once & fit & _agree() & ~F.arrays_overlap("earlier", "other_earlier") & F.arrays_overlap("keys", "other_keys"))
    return met.select(F.col("line_id").alias("a"), F.col("other").alias("b"), F.col("size").alias("na"), F.col("other_size").alias("nb")).distinct()


def _split(led: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, line_id, label, n, most) of the buckets whose lines are in several components: their size and the component of most.

    The leader is not counted, for it has met all of its bucket.
    """
    labels = roots.select(F.col("node").alias("line_id"), F.col("root").alias("label"))
    members = led.join(labels, "line_id", "left").select("key", "line_id", F.coalesce("label", "line_id").alias("label"))
    per_label = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    most = per_label.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("labels"), F.max(F.struct("n", "label"))["label"].alias("most"))
    return members.join(most.where("labels > 1"), "key").select("key", "line_id", "label", "n", "most")


def line_roots(lines: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, small: int = SMALL) -> DataFrame:
    """(node, root) of the line ids that are linked to another one."""
    signed = signatures(lines, scratch)
    led = scratch.save(_buckets(signed), "led", halves="key")
    ids = led.select("line_id").union(led.select("leader")).distinct()
    # The lines that share a bucket with another: what later steps ask of lines is kept of these only, text apart.
    texts = lines.select("line_id", "line").join(ids.hint("shuffle_hash"), "line_id", "left_semi")
    texts = scratch.save(texts, "texts", by="line_id")
    marks = marked(signed, texts, scratch)
    scratch.drop("signed")
    stars = _likely(led.select(F.col("line_id").alias("a"), F.col("leader").alias("b")).distinct(), marks, threshold)
    edges = scratch.save(_verified(stars, texts, threshold).select(F.col("a").alias("src"), F.col("b").alias("dst")), "stars")
    roots = scratch.save(components(edges, scratch, "near"), "roots")
    split = scratch.save(_split(led, roots), "split")
    # In larger buckets, those outside the component of most lines meet some lines of it first: one link is as good as all.
    # Half of them are drawn, half are the shortest: of lines that share a passage, those with the least beside it are near most others.
    large = split.where(F.col("n") > FEW)
    drawn = [F.max(F.struct(F.xxhash64("key", "line_id", F.lit(i)), "line_id"))["line_id"] for i in range(HELPERS // 2)]
    of = large.where("label = most").join(marks.select("line_id", "size").distinct(), "line_id")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("size", "line_id"))
    shortest = of.withColumn("nth", rank).where(F.col("nth") <= HELPERS // 2).select("key", F.col("line_id").alias("a"))
    helpers = of.groupBy("key").agg(F.array_distinct(F.array(*drawn)).alias("helpers")).select("key", F.explode("helpers").alias("a")).union(shortest).distinct()
    asked = large.where("label <> most").select("key", F.col("line_id").alias("b")).join(helpers, "key").select("a", "b").distinct()
    helped = _verified(_likely(asked, marks, threshold), texts, threshold)
    stars = roots.select(F.col("node").alias("src"), F.col("root").alias("dst"))
    roots = scratch.save(components(scratch.save(stars.union(helped), "helped"), scratch, "nearer"), "roots2")
    split = scratch.save(_split(led, roots), "split2")
    few = split.where(F.col("n") <= small).select("key", "line_id", "label")
    # At most BANDS keys of a kind each: a pair is compared in all of its buckets, but written in the least of them only.
    shared = few.groupBy("line_id").agg(F.collect_set("key").alias("keys"))
    few = few.join(shared, "line_id").join(_one(marks, "line_id", "size", *MARKS), "line_id").select("key", F.col("line_id").alias("a"), F.col("label").alias("la"), "keys", "kind", "alone", "a0", "a1", "size", *MARKS)
    few = scratch.save(few, "few")
    other = few.select("key", F.col("a").alias("b"), F.col("la").alias("lb"), F.col("keys").alias("other_keys"), *_other(), *_other_set())
    few = few.join(other, "key").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & _agree() & _within(_differ(), threshold) & (F.col("key") == F.array_min(F.array_intersect("keys", "other_keys"))))
    few = few.select("a", "b", F.col("size").alias("na"), F.col("other_size").alias("nb")).distinct()
    # Those still outside meet all others of their buckets through rare shingles.
    large = split.where(F.col("n") > small)
    some = large.groupBy("line_id", "label").agg(F.max(F.col("label") != F.col("most")).alias("open"))
    pairs = scratch.save(few.union(_prefix_pairs(some, large.select("key", "line_id"), texts, marks, threshold, scratch)).distinct(), "pairs")
    more = _verified(pairs, texts, threshold)
    links = scratch.save(roots.select(F.col("node").alias("src"), F.col("root").alias("dst")).union(more.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "links")
    for name in ("led", "texts", "marks", "stars", "roots", "split", "helped", "roots2", "split2", "few", "tokens", "prefix", "pairs"):
        scratch.drop(name)
    return components(links, scratch)


def dropped_lines(docs: DataFrame, threshold: float = THRESHOLD, small: int = SMALL) -> DataFrame:
    """(doc_id, doc_key, line_no, kept): the lines to leave out and the line that stays for each."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = distinct_lines(docs, scratch)
    roots = line_roots(lines, scratch, threshold, small)
    shared = lines.select("line_id", "n", "first").join(roots, F.col("line_id") == F.col("node"), "left").where("n > 1 or node is not null")
    shared = shared.select("line_id", "first", F.coalesce("root", "line_id").alias("root"))
    kept = shared.groupBy("root").agg(F.min("first").alias("kept"))
    decided = scratch.save(shared.join(kept, "root").select("line_id", "kept"), "decided")
    scratch.drop("lines")
    found = _located(docs).select("doc_id", "doc_key", "line_no", "line_id").join(decided, "line_id")
    mine = F.struct("doc_id", "doc_key", "line_no")
    return found.where(~mine.eqNullSafe(F.col("kept"))).select("doc_id", "doc_key", "line_no", "kept")


def _with_drops(rows: DataFrame, drops: DataFrame) -> DataFrame:
    """rows, which have doc_id and doc_key, and `drop`: the sorted numbers of the lines to drop, null for none."""
    per = drops.groupBy(F.col("doc_id").alias("id"), F.col("doc_key").alias("key")).agg(F.array_sort(F.collect_set(F.col("line_no").cast("long"))).alias("drop"))
    return rows.join(per, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("doc_key") == F.col("key")), "left").drop("id", "key")


def apply(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the dropped lines taken out of text, n_chars counted anew; other columns stay."""
    text = F.col("row.text")
    left = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("drop", i.cast("long")))
    rows = _with_drops(packed(docs, doc_id=F.col("doc_id"), doc_key=text_key()), dropped_lines(docs, threshold))
    rows = rows.select("row", "drop", F.when(F.col("drop").isNull(), text).otherwise(F.array_join(left, "\n")).alias("left"))
    rows = rows.where(F.col("drop").isNull() | (F.trim("left") != ""))
    out = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("drop").isNull(), F.col("row.n_chars")).otherwise(F.length("left").cast(docs.schema["n_chars"].dataType))
    return unpacked(rows, docs.columns, out)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """One row for each document: its lines that are not empty, and those dropped."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n_lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x, F.lit(WHITE)) != "")).cast("long")
    rows = _with_drops(docs.select("doc_id", text_key().alias("doc_key"), n_lines.alias("n_lines")), dropped_lines(docs))
    return rows.select("doc_id", "n_lines", F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("drop", F.array().cast("array<bigint>")).alias("dropped"))
