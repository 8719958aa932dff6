"""Character sets of files, told from their bytes: marks and escapes, then UTF-8, then a score of the text each codec gives.

The score looks at runs of letters that are not ASCII: text in the right codec keeps to one script in a run, small
letters don't turn into capitals, and the commonest letters of the script are common. Control characters and
drawing marks count against a codec. A run of Latin letters may hold ASCII ones; any other must not touch them.
Accented letters that stand alone prove no other alphabet: one counts for less without WORDS different words of WORD
letters, or if at least as many different runs of its letters touch ASCII ones as don't. Latin letters prove none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Each character set with the codecs that are tried for it, in order.
CODECS = {
    "utf-8": ("utf-8",), "ascii": ("utf-8",), "ISO-8859-1": ("ISO-8859-1",), "ISO-8859-5": ("iso8859_5",), "ISO-8859-9": ("iso8859_9",), "Windows-1252": ("cp1252", "latin1"),
    "SHIFT_JIS": ("shift_jis", "cp932"), "GB2312": ("gbk", "gb18030"), "Big5": ("big5", "gbk"), "windows-1251": ("windows-1251",), "IBM866": ("ibm866",), "IBM855": ("ibm855",),
    "Windows-1254": ("cp1254", "latin1"), "TIS-620": ("cp874",), "HZ-GB-2312": ("hz", "gbk"), "KOI8-R": ("koi8-r",), "MacCyrillic": ("mac_cyrillic", "koi8-r"), "EUC-JP": ("euc_jp",), "EUC-KR": ("euc_kr", "cp949"),
    "ISO-2022-JP": ("iso2022_jp", "cp932"), "windows-1255": ("cp1255",), "windows-1253": ("cp1253",), "CP949": ("cp949",), "UTF-8-SIG": ("utf-8-sig",), "UTF-16": ("utf-16",), "UTF-32": ("utf-32",),
}
MARKS = ((b"\xef\xbb\xbf", "UTF-8-SIG"), (b"\xff\xfe\x00\x00", "UTF-32"), (b"\x00\x00\xfe\xff", "UTF-32"), (b"\xff\xfe", "UTF-16"), (b"\xfe\xff", "UTF-16"))
ESCAPES = ((regex.compile(rb"\x1b(?:\$[@B]|\([BJ])"), "ISO-2022-JP"), (regex.compile(rb"~\{(?:[\x21-\x7e]{2})+~\}"), "HZ-GB-2312"))
#: Tried in this order; of equal scores the first stays.
TRIED = ("ISO-8859-1", "Windows-1252", "EUC-KR", "EUC-JP", "SHIFT_JIS", "GB2312", "Big5", "windows-1251", "KOI8-R", "IBM866", "ISO-8859-5", "MacCyrillic", "IBM855", "windows-1253", "windows-1255", "TIS-620", "Windows-1254", "CP949")
#: The commonest letters of each script.
COMMON = "éèàùâêîôûçëïäöüßáíóúñоеаинтсрвлкмОЕАИНТαοιετνσηςρיוהלאתרבาน่รอก้เงのにはをがでしたると이다는을의에가를고하的一是不了在人有我他這个中大來上国國"

#: Character sets of an alphabet that isn't Latin, a byte a letter.
ONE_BYTE = frozenset(("windows-1251", "KOI8-R", "IBM866", "ISO-8859-5", "MacCyrillic", "IBM855", "windows-1253", "windows-1255", "TIS-620"))
#: Letters of a run that make a word, different words that prove an alphabet, and the worth of one without them.
WORD, WORDS, UNPROVEN = 3, 2, 0.4

_RUN = regex.compile(r"[\p{L}\p{M}]+")
_LATIN = 0.9
_SCRIPTS = [
    (1.0, regex.compile(r"\p{Cyrillic}+")), (1.0, regex.compile(r"\p{Greek}+")), (1.0, regex.compile(r"[\p{Hebrew}\p{M}]+")), (1.0, regex.compile(r"\p{Thai}+")),
    (1.0, regex.compile(r"\p{Hangul}+")), (0.8, regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々]+")), (_LATIN, regex.compile(r"\p{Latin}+")),
]
#: Of these, the alphabets of one byte a letter that aren't Latin come first.
_ALPHABETS = 4
_HIGH, _FLIP, _LATE = regex.compile(r"[^\x00-\x7f]"), regex.compile(r"\p{Ll}\p{Lu}"), regex.compile(r"^\p{Ll}+$")
_BAD, _ODD = regex.compile(r"[\x80-\x9f\p{Co}\p{Cn}]"), regex.compile(r"(?![\x00-\x7f])[\p{So}─-▟｡-ﾟ\p{Sm}ªº¤¦¨¬¯´¸¹²³¼½¾¿µ]")
_COMMON = regex.compile(f"[{COMMON}]")
_WIDE = regex.compile(r"[\p{Hiragana}\p{Katakana}]")


def _score(text: str, name: str) -> float:
    """How much like text it is, at most 2, by the characters that are not ASCII."""
    high = len(_HIGH.findall(text))
    if not high:
        return 0.0
    total, words, own, mixed = 0.0, 0, 0, 0
    other = name in ONE_BYTE
    for run, times in Counter(_RUN.findall(text)).items():
        n = len(_HIGH.findall(run))
        if not n:
            continue
        at = next((i for i, (_, script) in enumerate(_SCRIPTS) if script.fullmatch(run)), None)
        worth = -1.0 if at is None or (other and _SCRIPTS[at][0] == _LATIN) else _SCRIPTS[at][0]
        mixed += n < len(run)
        if at is not None and at < _ALPHABETS:
            own, words = own + 1, words + (len(run) >= WORD)
        flips = len(_FLIP.findall(run))
        capitals = len(run) > 3 and run.isupper() and not run.isascii()
        part = n * worth - min(n, flips) - 0.5 * n * capitals
        if worth == _LATIN and n > 1 and n == len(run):
            part -= 0.8 * n  # a word of accented letters only
        total += times * part
    total -= len(_BAD.findall(text)) + 0.8 * len(_ODD.findall(text))
    kana = len(_WIDE.findall(text)) / high
    if name == "GB2312" and kana > 0.1:
        total -= 0.3 * high  # kana lie at the same place in both; Japanese has them
    score = (total + len(_COMMON.findall(text))) / high
    return min(score, UNPROVEN * score) if own and words < WORDS or other and mixed >= max(own, 1) else score


def ranked(data: bytes) -> list[tuple[str, float]]:
    """The character sets that fit, the best first: (name, score), 2 for those that marks or the form of UTF-8 prove."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return [(name, 2.0)]
    if data.isascii():
        return [next(((name, 2.0) for form, name in ESCAPES if form.search(data)), ("ascii", 2.0))]
    try:
        data.decode("utf-8")
        return [("utf-8", 2.0)]
    except UnicodeDecodeError:
        pass
    found = []
    for name in TRIED:
        try:
            found.append((name, _score(data.decode(CODECS[name][0]), name)))
        except UnicodeDecodeError:
            continue
    return sorted(found, key=lambda f: -f[1])


def decoded(data: bytes, least: float = -0.5) -> tuple[str, str | None, float, str | None]:
    """(text, character set, score, note): a codec that fails gives way to the next one, at last to UTF-8 without what fails, which the note says."""
    best = ranked(data)
    name, score = best[0] if best and best[0][1] > least else (None, 0.0)
    for codec in CODECS.get(name, ()):
        try:
            return data.decode(codec), name, score, None
        except UnicodeDecodeError:
            continue
    note = "no character set fits" if name is None else f"tried {', '.join(CODECS[name])}, all failed"
    return data.decode("utf-8", "ignore"), name, score, note


def _decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for some in batches:
        yield pd.DataFrame([(None,) * 4 if data is None else decoded(bytes(data)) for data in some], columns=["text", "encoding", "score", "note"], dtype=object).astype({"score": float})


def decode(data: Column) -> Column:
    """struct<text, encoding, score, note> of bytes, null for null."""
    return F.when(data.isNotNull(), F.pandas_udf(_decode, "text string, encoding string, score double, note string")(data))


def encoding_counts(rows: DataFrame, data: str) -> DataFrame:
    """(encoding, n): how many files are in each character set."""
    return rows.where(F.col(data).isNotNull()).select(decode(F.col(data))["encoding"].alias("encoding")).groupBy("encoding").agg(F.count("*").alias("n"))
