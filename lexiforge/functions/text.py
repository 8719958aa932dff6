"""Column functions on text: tokens, normal forms, identifiers, log lines and mark-up remains."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks spaced out, made blank and dropped by the tagging normal form.
SPACED = [".", ",", ";", ":", "(", ")", "!", "?", "-", "/", "\n"]
BLANKED = ["=", "*", "|", "~", "«", "»"]
DROPPED = ["’", "′", "'", "“", '"', "[", "]", "{", "}", "\\", "^"]
#: Marks dropped by the phrase normal form.
PHRASE_DROPPED = [
    "’", "'", "′", "“", '"', ".", ",", "(", ")", "!", "?", "^", ";", ":", "=", "*", "|", "/", "\\", "~", "«", "»", "<", ">", "”", "[", "]", "{", "}",
]
#: Abbreviations whose marks stay.
ABBREVIATIONS = ["eq.", "eqs.", "i.e.", "e.g.", "f.g.", "w.r.t.", "cf.", "dr.", "resp.", "etc.", "no.", "a.e.", "ph.d.", "i.i.d.", "fig.", "vol.", "thm."]
#: Phrases that are no terms.
PHRASE_BLACKLIST = [
    "_inline_math_ and", "_inline_math_ _inline_math_", "recent years", "for _inline_math_", "_inline_math_ if", "_inline_math_ also", "suppose that", "condition for",
    "_inline_math_ on", "_inline_math_ a", "_inline_math_ as", "_inline_math_ in", "_inline_math_ up", "_inline_math_ by", "_inline_math_ which", "_inline_math_ that",
    "_inline_math_ the", "_inline_math_ or", "_inline_math_ of", "_inline_math_ to", "_inline_math_ it", "family of", "of the", "all _inline_math_", "a _inline_math_",
    "well known", "group of", "r and", "a point", "a linear", "a field", "a line", "choice of", "set of", "the measure", " ", "",
]

#: Letters and marks that have no decomposition, in ASCII.
_LATIN = str.maketrans({
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th",
    "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ŋ": "ng", "Ŋ": "NG", "‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"', "«": "<<", "»": ">>",
    "‹": "<", "›": ">", "‐": "-", "‒": "-", "–": "-", "—": "--", "−": "-", "×": "x", "÷": "/", "¡": "!", "¿": "?", "·": ".", "•": "*", "€": "EUR", "£": "GBP",
    "©": "(c)", "®": "(r)", "°": "deg", "§": "SS", "⁄": "/",
})


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    # Only the ends can be empty. Taken away in generated code, not by a function called for each word.
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]++"), "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def ascii_form(text: str) -> str:
    """Compatible decomposition without combining marks, then a table; what neither maps stays."""
    parts = unicodedata.normalize("NFKD", text.translate(_LATIN))
    return "".join(c for c in parts if not unicodedata.combining(c)).translate(_LATIN)


def transliterate(text: Column) -> Column:
    def batches(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in it:
            yield column.map(lambda x: None if x is None else ascii_form(x))

    odd = text.rlike(r"[^\x00-\x7f]")
    # ASCII texts don't go to Python.
    return F.when(odd, F.pandas_udf(batches, "string")(F.when(odd, text))).otherwise(text)


def _marks(text: Column, mode: str) -> Column:
    """The mark table of a mode, all replacements at once: none makes a mark that another one takes."""
    out = F.replace(text, F.lit("``"), F.lit(""))
    if mode == "drop":
        out = F.translate(out, "-" + "".join(PHRASE_DROPPED), " ")
        return F.replace(out, F.lit("\n"), F.lit(" \n "))
    out = F.translate(out, "".join(BLANKED) + "".join(DROPPED), " " * len(BLANKED))
    return F.regexp_replace(out, r"([.,;:()!?/\n-])", " $1 ")


def _finished(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(text, "[ \t]+", " ")), r"^\s+|\s+$", "")


def normalize_text(text: Column, mode: str = "space", letters: str = "map", abbreviations: list[str] | None = None) -> Column:
    """Line-break tags and digits to blanks, letters to ASCII, marks spaced (mode 'space') or dropped ('drop'), blanks collapsed, lower case, trimmed.

    Line ends stay, as words of their own. `letters`: 'map' transliterates, 'drop' leaves
    out what is not ASCII. With `abbreviations`, in mode 'space', the longest one within a word
    keeps its marks; a word that holds it twice goes.
    """
    out = F.regexp_replace(F.regexp_replace(text, r"<br\s*/? ?>", " "), "[0-9]+", " ")
    out = F.regexp_replace(out, r"[^\x00-\x7f]+", "") if letters == "drop" else transliterate(out)
    if abbreviations is None or mode == "drop":
        return _finished(_marks(out, mode))
    known = sorted(set(abbreviations), key=lambda a: (-len(a), a))

    def word(w: Column) -> Column:
        form = _marks(w, mode)
        for abbreviation in reversed(known):
            own = F.split(w, r"\Q" + abbreviation + r"\E", -1)
            around = F.concat(_marks(F.get(own, F.lit(0)), mode), F.lit(abbreviation), _marks(F.get(own, F.lit(1)), mode))
            form = F.when(F.contains(w, F.lit(abbreviation)), F.when(F.size(own) == 2, around)).otherwise(form)
        return form

    words = F.filter(F.split(out, r"\s+"), lambda w: w != "")
    return _finished(F.array_join(F.transform(words, word), " "))


def normalize_phrase(text: Column, letters: str = "map") -> Column:
    return F.regexp_replace(normalize_text(text, "drop", letters), r"\s+", "_")


def next_words(words: Column) -> Column:
    """Pairs (word, next word) of a list of words."""
    return F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("word"), b.alias("next")))


def remove_math(text: Column, marker: str = "_inline_math_") -> Column:
    return F.regexp_replace(text, r"\$[^$]*?\$", marker)


def quoted_terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1))


def definition_section(text: Column) -> Column:
    """Bodies of the wiki sections headed by a definition, up to a blank line and the next heading or the end; null if there is none."""
    bodies = F.regexp_extract_all(text, F.lit(r"(?is)(=+)\s*definition\s*\1\s*?\n(.*?)(?=\n\n=|\z)"), F.lit(2))
    return F.when(F.size(bodies) > 0, bodies)


def metadata_map(text: Column) -> Column:
    """Commands of the form \\pmname{value} as a map from name to the list of its values."""
    command = F.lit(r"\\(pm[a-z]+)\{([^}\n]*)\}")
    names, values = F.regexp_extract_all(text, command, F.lit(1)), F.regexp_extract_all(text, command, F.lit(2))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    of = lambda k: F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])
    return F.map_from_entries(F.transform(F.array_distinct(names), lambda k: F.struct(k, of(k))))


def article_id(name: Column) -> Column:
    """struct(scheme, category, yymm, number, version) of any written form of an article id; null if none fits."""
    new = r"(?:^|/|arXiv:)(\d{4})[./](\d{4,5})(?:v(\d+))?(?:$|\.|/)"
    member = r"(\d{4})/(\d{4})\.(\d{4,5})(?:v(\d+))?"
    old = r"(?:^|/)([a-z-]+(?:\.[A-Z]{2})?)[./]?(\d{4})(\d{3})(?:v(\d+))?(?:$|\.|/)"
    nullif = lambda c: F.when(c != "", c)
    as_struct = lambda scheme, cat, yymm, number, version: F.struct(F.lit(scheme).alias("scheme"), cat.alias("category"), yymm.alias("yymm"), number.alias("number"), nullif(version).cast("int").alias("version"))
    ex = F.regexp_extract
    none = F.lit(None).cast("string")
    return (
        F.when(name.rlike(member), as_struct("new", none, ex(name, member, 2), ex(name, member, 3), ex(name, member, 4)))
        .when(name.rlike(r"(?:^|/|arXiv:)\d{4}\.\d{4,5}"), as_struct("new", none, ex(name, r"(\d{4})\.(\d{4,5})(?:v(\d+))?", 1), ex(name, r"(\d{4})\.(\d{4,5})(?:v(\d+))?", 2), ex(name, r"(\d{4})\.(\d{4,5})(?:v(\d+))?", 3)))
        .when(name.rlike(old), as_struct("old", ex(name, old, 1), ex(name, old, 2), ex(name, old, 3), ex(name, old, 4)))
        .when(name.rlike(new), as_struct("new", none, ex(name, new, 1), ex(name, new, 2), ex(name, new, 3)))
    )


def conversion_counts(line: Column) -> Column:
    """struct(warnings, errors, fatal, undefined, missing) of a 'Conversion complete' line, zeros where not named."""
    number = lambda what: F.coalesce(F.when(line.rlike(rf"(\d+) {what}"), F.regexp_extract(line, rf"(\d+) {what}", 1)).cast("int"), F.lit(0))
    return F.struct(number("warnings?").alias("warnings"), number("errors?").alias("errors"), number("fatal errors?").alias("fatal"), number("undefined macros?").alias("undefined"), number("missing files?").alias("missing"))


def outcome(started: Column, ended: Column, fatal: Column, errors: Column, timed_out: Column, most: int = 10000) -> Column:
    """Flags of a conversion run, as an array."""
    died = F.array(F.lit("DIED"))
    main = F.when(fatal == 0, "SUCC").when(errors > most, "MAXED").otherwise("FATAL")
    flags = F.when(timed_out & (fatal > 0), F.array(main, F.lit("TIMED"))).otherwise(F.array(main))
    return F.when(started.isNull() | ended.isNull(), died).otherwise(flags)


def log_time(text: Column) -> Column:
    """Timestamp of a log stamp such as 'Thu Aug  1 10:00:00 2019'."""
    squeezed = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3}\s+", ""), r"\s+", " ")
    return F.try_to_timestamp(squeezed, F.lit("MMM d HH:mm:ss yyyy"))


def shape_flags(word: Column) -> Column:
    return F.struct(word.rlike("^[A-Z]").alias("capital"), word.contains("-").alias("dash"))


def pad_to(ids: Column, n: int, pad) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), n)), 1, n)
