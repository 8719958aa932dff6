"""Character sets of short texts in many encodings."""

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import charsets

RUSSIAN = "Пусть дано множество всех натуральных чисел. Тогда существует наибольший общий делитель, и он единственный."
FRENCH = "Soit une variété différentielle : on appelle espace vérifié l'ensemble où la dérivée est à la fois définie et réelle."
JAPANESE = "この定理の証明は次のように行われる。まず集合を考えて、その部分集合の数を数える。"
CHINESE = "我们在这里证明这个定理是不成立的,因为他的一个条件在中国的大学里没有人知道。"
TRADITIONAL = "這個定理的證明是由我們在學校裡完成的,因為他的一個條件不是大家都知道的事情。"
KOREAN = "이 정리의 증명은 다음과 같이 진행된다. 먼저 집합을 생각하고 그 부분집합의 수를 센다."
GREEK = "Έστω ότι το σύνολο των φυσικών αριθμών είναι άπειρο και ότι η συνάρτηση είναι συνεχής."
HEBREW = "תהי קבוצה של מספרים טבעיים ונניח כי הפונקציה רציפה בכל נקודה של הקטע הסגור."
THAI = "ให้เซตของจำนวนนับเป็นเซตอนันต์และฟังก์ชันนี้ต่อเนื่องทุกจุด"

CASES = [
    ("utf-8", RUSSIAN, "utf-8"), ("utf-8", THAI, "utf-8"), ("ascii", "plain text", "ascii"), ("utf-8-sig", FRENCH, "UTF-8-SIG"), ("utf-16", GREEK, "UTF-16"),
    ("latin1", FRENCH, "ISO-8859-1"), ("cp1252", FRENCH + " L’été “vert”", "Windows-1252"), ("cp1251", RUSSIAN, "windows-1251"), ("koi8-r", RUSSIAN, "KOI8-R"), ("ibm866", RUSSIAN, "IBM866"),
    ("iso8859_5", RUSSIAN, "ISO-8859-5"), ("euc_jp", JAPANESE, "EUC-JP"), ("shift_jis", JAPANESE, "SHIFT_JIS"), ("iso2022_jp", JAPANESE, "ISO-2022-JP"), ("gbk", CHINESE, "GB2312"), ("hz", CHINESE, "HZ-GB-2312"),
    ("big5", TRADITIONAL, "Big5"), ("euc_kr", KOREAN, "EUC-KR"), ("cp1253", GREEK, "windows-1253"), ("cp1255", HEBREW, "windows-1255"), ("cp874", THAI, "TIS-620"),
]


@pytest.mark.parametrize("codec,text,name", CASES)
def test_detects(codec, text, name):
    got, found, _, note = charsets.decoded(text.encode(codec))
    assert (found, got, note) == (name, text, None), charsets.ranked(text.encode(codec))[:4]


@pytest.mark.parametrize("codec,text,name", [c for c in CASES if c[0] != "ascii"])
def test_detects_within_mark_up(codec, text, name):
    raw = f"\\section{{One}} Let $x$ be.\n{text}\n\\begin{{proof}} {text} \\end{{proof}}"
    assert charsets.decoded(raw.encode(codec))[:2] == (raw, name)


def test_columns(spark):
    rows = [(1, FRENCH.encode("latin1")), (2, b""), (3, None), (4, RUSSIAN.encode("koi8-r")), (5, bytes(range(256)) * 3), (6, b"\xff\xfe\x00")]
    df = spark.createDataFrame(rows, "id int, data binary")
    got = {r["id"]: r["d"] for r in df.select("id", charsets.decode(F.col("data")).alias("d")).collect()}
    assert got[1]["text"] == FRENCH and got[2]["encoding"] == "ascii" and got[2]["text"] == "" and got[3] is None and got[4]["text"] == RUSSIAN
    assert got[6]["note"].startswith("tried utf-16") and got[5]["text"] is not None
    n = {r["encoding"]: r["n"] for r in charsets.encoding_counts(df, "data").collect()}
    assert n["ISO-8859-1"] == n["KOI8-R"] == n["ascii"] == n["UTF-16"] == 1 and sum(n.values()) == 5


LONE = ["La é le de de. ", "una óí. óí. óí. ", "et de è è è è è et. ", "du. du. Ê Ê Ê du. ", "la ñ, el so s co ó. ", "CHUNGAU!! Ü.!! und Dieüauß ÖÜ.!! UND TEÄAU!! "]


REPEATED = ["EREINSCH!! EINTZ!! DEM.!! VERSSÄ!! DIE. " * 9, "Équereç treêê avec. Vipa êieroi èç. " + "En èèé. " * 60, "ÜSCH!! STVER!! UNGACHÖ!! ERÜ,!! Ü!! FÜR!! ÜÖÜ!! " * 8, "la de èèé. " * 5]


@pytest.mark.parametrize("text", REPEATED)
def test_a_repeated_word_proves_no_other_alphabet(text):
    assert charsets.decoded(text.encode("latin1"))[:2] == (text, "ISO-8859-1"), charsets.ranked(text.encode("latin1"))[:4]


@pytest.mark.parametrize("text", LONE)
def test_lone_accented_letters_are_western(text):
    assert charsets.decoded(text.encode("latin1"))[:2] == (text, "ISO-8859-1"), charsets.ranked(text.encode("latin1"))[:4]


def test_encoding_counts_of_odd_numbers(spark, tmp_path):
    """Against the query's SQL, with ids that are null and negative."""
    import duckdb

    from lexiforge.plans import models

    rows = [(n, t) for n, t in enumerate(LONE * 3)] + [(None, "é а"), (-1, "é б"), (-2, "plain"), (5, ""), (7, None), (2, "ж")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in models.encoding_counts(spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(db.execute(models.ORACLES["encoding_counts"]).fetchall())
