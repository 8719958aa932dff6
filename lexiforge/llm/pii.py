"""Operator 10: personal data by patterns, checksums and context words (native).

Patterns propose spans; validators confirm them (parts of an address, digit counts, Luhn,
mod 97); a span's score starts at its kind's and rises if a context word stands near.
Spans of the base kinds stay whatever their score; the added kinds (iban, ssn) need a
score of `threshold`.

Patterns are bounded against long runs: an address is only tried where its run of
characters starts or the last match ended, and repeats don't give back. An account
number is as long as its country's are, whatever follows it; that of a country not
listed ends where mod 97 holds, the longest first.

Defined cases: null text is empty; every span counts, repeated values too; kinds may
overlap; spans of one kind don't; places are code points, the end exclusive; repeated
rows repeat; an empty table gives an empty result; `find` keeps the columns it is
asked for, but for one named spans, which it replaces; `redact` keeps every column.
Matches are numbered block by block, so that a text of many is not read over and over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import others, packed, unpacked

_LOCAL = "A-Za-z0-9._%+-"
#: kind -> (pattern, score of a confirmed span), in the order of the result.
BASE = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.6),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", 0.8),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.6),
}
#: Length of a bank account number -> the countries that use it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = "|".join(sorted(c for names in IBAN_LENGTHS.values() for c in names.split()))
_BY_COUNTRY = "|".join(rf"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items())
ADDED = {
    "iban": (rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_BY_COUNTRY}|(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])", 0.8),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3),
}
#: Words that make a span of a kind more likely.
CONTEXT = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel|write",
    "ip": "ip|address|server|host|login|adresse",
    "card": "card|visa|mastercard|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|tax id",
}
NEAR, CONTEXT_SCORE, THRESHOLD = 48, 0.35, 0.6
_EMPTY = "cast(array() as array<struct<start:bigint,end:bigint,value:string>>)"


#: Matches of a block: lists grow by appending within one only.
BLOCK = 128


def matches(text: str, pattern: str) -> Column:
    """All matches in order, as structs (start, end, value): the lengths of what lies between and in them add up."""
    quoted = "r'" + pattern + "'"
    items = f"zip_with(split({text}, {quoted}, -1), regexp_extract_all({text}, {quoted}, 0), (gap, value) -> named_struct('gap', cast(length(gap) as bigint), 'value', value))"
    # A lambda over a list of one names a value, so that it is worked out once.
    blocks = f"transform(array({items}), items -> transform(sequence(0, (size(items) - 1) div {BLOCK}), b -> slice(items, cast(b as int) * {BLOCK} + 1, {BLOCK})))[0]"
    offsets = """aggregate(blocks, named_struct('at', 0L, 'out', cast(array() as array<bigint>)), (acc, block) -> named_struct(
        'at', acc.at + aggregate(block, 0L, (n, x) -> n + x.gap + coalesce(length(x.value), 0)), 'out', concat(acc.out, array(acc.at))), acc -> acc.out)"""
    within = f"""aggregate(block, named_struct('at', offset, 'out', {_EMPTY}),
        (acc, x) -> named_struct('at', acc.at + x.gap + coalesce(length(x.value), 0), 'out', if(x.value is null, acc.out,
            concat(acc.out, array(named_struct('start', acc.at + x.gap, 'end', acc.at + x.gap + length(x.value), 'value', x.value))))),
        acc -> acc.out)"""
    return F.expr(f"case when {text} rlike {quoted} then transform(array({blocks}), blocks -> flatten(zip_with(blocks, {offsets}, (block, offset) -> {within})))[0] else {_EMPTY} end")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    each = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), lambda c, i: c.cast("int") * (i % 2 + 1))
    return F.aggregate(each, F.lit(0), lambda acc, d: acc + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether the remainder of a bank account number, its head moved behind, is 1."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    worth = F.transform(F.regexp_extract_all(moved, F.lit("."), F.lit(0)), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(worth, F.lit(0), lambda acc, v: (acc * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def whole_iban(m: Column) -> Column:
    """A match whose country has no listed length, cut before a blank to its longest part that mod 97 confirms; any other as it is."""
    words = F.split(m["value"], " ")
    parts = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
    part = F.get(F.filter(parts, lambda p: (F.length(F.replace(p, F.lit(" "), F.lit(""))) >= 15) & mod97(p)), F.lit(0))
    cut = F.struct(m["start"].alias("start"), (m["start"] + F.length(part)).alias("end"), part.alias("value"))
    return F.when(m["value"].rlike(f"^(?:{_LISTED})") | part.isNull(), m).otherwise(cut)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda part: F.regexp_replace(part, "^0+", "").rlike("^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
    "card": lambda v: F.length(_digits(v)).between(14, 19) & luhn(_digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
    "iban": mod97,
    "ssn": lambda v: ~v.rlike("^(?:000|666|9)|-00-|-0000$"),
}


def _valid(kind: str):
    return lambda m: VALID[kind](m["value"])


def _is(kind: str):
    return lambda s: s["kind"] == kind


#: Characters of a part of a text: a place in it is found by counting from the part's beginning.
PART = 4096


def _part(start: Column, n: Column) -> Column:
    """Up to n <= NEAR characters of the text from a place on."""
    return F.get(F.col("parts"), F.floor(start / PART).cast("int")).substr((start % PART + 1).cast("int"), n.cast("int"))


def _span(kind: str, rank: int, score: float):
    """The span of a match; context words within NEAR characters raise its score."""

    def span(m: Column) -> Column:
        begin = F.greatest(m["start"] - NEAR, F.lit(0))
        before = _part(begin, m["start"] - begin)
        after = _part(m["end"], F.lit(NEAR))
        near = F.concat(before, F.lit(" "), after)
        raised = F.when(near.rlike(rf"(?iu)(?<![\p{{L}}])(?:{CONTEXT[kind]})(?![\p{{L}}])"), CONTEXT_SCORE).otherwise(0.0)
        return F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"), F.least(F.lit(1.0), F.lit(score) + raised).alias("score"))

    return span


def find(docs: DataFrame, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The columns `keep` of docs (all if None) and spans: structs (start, rank, kind, end, score) in order."""
    names = others(docs.columns if keep is None else keep, ["spans"])
    return unpacked(_found(docs, threshold), names, {"spans": F.col("spans")})


def _found(docs: DataFrame, threshold: float) -> DataFrame:
    """(row, t, spans): the packed rows, their text and what it holds."""
    kinds = BASE | ADDED
    rows = packed(docs, t=F.coalesce("text", F.lit("")))
    guard = {"email": F.col("t").contains("@"), "phone": F.col("t").contains("+")}
    found = {k: matches("t", p) if k not in guard else F.when(guard[k], matches("t", p)).otherwise(F.expr(_EMPTY)) for k, (p, _) in kinds.items()}
    rows = rows.select("*", *[c.alias(f"of_{k}") for k, c in found.items()])
    some = F.size(F.concat(*[f"of_{k}" for k in kinds])) > 0
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.length("t") / PART).cast("int")), lambda i: F.col("t").substr(i * PART + 1, F.lit(PART + NEAR)))
    rows = rows.withColumn("parts", F.when(some, cut))
    parts = []
    for rank, (kind, (_, score)) in enumerate(kinds.items()):
        proposed = F.transform("of_iban", whole_iban) if kind == "iban" else F.col(f"of_{kind}")
        spans = F.transform(F.filter(proposed, _valid(kind)), _span(kind, rank, score))
        parts.append(spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= threshold))
    return rows.select("row", "t", F.array_sort(F.concat(*parts)).alias("spans"))


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with each found value replaced by its kind in angle brackets; of overlapping spans the first counts."""
    clean = F.expr("""aggregate(spans, named_struct('at', 0L, 'out', cast(array() as array<string>)), (acc, s) -> if(s.start < acc.at, acc,
        named_struct('at', s.end, 'out', concat(acc.out, array(substring(t, cast(acc.at + 1 as int), cast(s.start - acc.at as int)), '<', s.kind, '>')))),
        acc -> array_join(concat(acc.out, array(substring(t, cast(acc.at + 1 as int)))), ''))""")
    return unpacked(_found(docs, threshold), docs.columns, {"text": F.when(F.col("row.text").isNotNull(), clean)})


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_pii(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
