"""The LaTeX reader on cases written by hand, on drawn trees whose text is known, and its query's source."""

import random

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import latex

CASES = [
    ("A \\emph{lost} word.", "A word .", "good"),
    ("a\nb\n\n\nc", "a b\n\nc", "good"),
    ("a\\par b", "a\n\nb", "good"),
    ("let $x_{\\text{if $y$}}$ be", "let _inline_math_ be", "good"),
    ("$a$\n$$b$$ \\[c\\] then \\(d\\).", "_inline_math_ then _inline_math_ .", "good"),
    ("$a$\n\n$$b$$", "_inline_math_\n\n_display_math_", "good"),
    ("\\begin{document}\\begin{theorem}[one] x\\end{theorem}\\end{document} after", "one x", "good"),
    ("a \\begin{align*} x \\begin{theorem} y \\end{theorem} $z$ \\cmd \\end{align*} b", "a b", "good"),
    ("\\begin{itemize}\\item one\n\\item[x] two\\end{itemize}", "_item_ one _item_ two", "good"),
    ("\\begin{itemize}\\item one\n\nb\\end{itemize} c", "_item_ one\n\nb c", "recovered"),
    ("\\begin{cases}a & b \\\\ c\\end{cases}", "case a b c end", "good"),
    ("\\begin{tabbing} a \\> b \\end{tabbing}", "a b", "good"),
    ("a \\end{thm} b", "a b", "recovered"),
    ("\\begin{lemma} a", "a", "unclosed"),
    ("a \\cmd{ b\n\nc", "a\n\nc", "recovered"),
    ("a $ b\n\nc", "a _inline_math_\n\nc", "recovered"),
    ("\\cmd[a}b] c", "b c", "recovered"),
    ("Poincar\\'e, Erd\\H{o}s {\\ae} it's Riemann-Hilbert 3.14 007 % gone", "Poincare Erdos ae its Riemann-Hilbert 3.14 007", "good"),
    ("\\input{ part.tex } a", "a", "good"),
    ("", "", "good"),
    (" \n\n ", "", "good"),
]


@pytest.mark.parametrize("raw,text,status", CASES)
def test_reader(raw, text, status):
    row = latex._Reader(raw).row()
    assert (row[0], row[-1]) == (text, status)


def test_errors_stop():
    row = latex._Reader("a \\end{thm} " * 5000).row()
    assert row[-1] == "stopped" and len(row[-2]) == latex.ERRORS


def drawn(rng, depth, kept):
    """A source and the pieces of its text."""
    raw, out = [], []
    for _ in range(rng.randint(1, 5)):
        pick = rng.randint(0, 6 if depth else 2)
        word = "".join(rng.choice("abcxyz") for _ in range(3))
        inner, pieces = drawn(rng, depth - 1, kept and pick != 5) if pick > 2 else ("", [])
        if pick <= 1:
            raw.append(word + rng.choice([" ", "\n", ", ", " % note $ { \\end{x}\n"]))
            out += [word]
        elif pick == 2:
            raw.append(f"\\{word}[{word}]{{{word} {{$x$}} }}, ")
        elif pick == 3:
            raw.append(f"\\begin{{lemma}} {inner} \\end{{lemma}} ")
            out += pieces
        elif pick == 4:
            raw.append(f"{{ {inner} }} ")
            out += pieces
        elif pick == 5:
            raw.append(f"\\begin{{figure}} {inner} \\end{{figure}} ")
        else:
            raw.append(f"and $ x^{{ {word} $y$ }} $, ")
            out += ["and", "_inline_math_"]
    return "".join(raw), out


def test_trees_read_back():
    rng = random.Random(5)
    for _ in range(300):
        raw, pieces = drawn(rng, 4, True)
        row = latex._Reader(raw).row()
        assert row[0].split() == pieces and row[-1] == "good", raw


def test_columns(spark):
    rows = spark.createDataFrame([(1, "a\n\nb \\input{f} \\x{y}"), (2, None), (3, "")], "id int, text string")
    got = {r["id"]: r["r"] for r in rows.select("id", latex.latex_record(F.col("text")).alias("r")).collect()}
    assert got[2] is None and got[3]["text"] == "" and got[1]["inputs"] == ["f"] and got[1]["commands"] == ["x"]
    assert sorted(map(tuple, latex.latex_paragraphs(rows).collect())) == [(1, 0, "a"), (1, 1, "b")]
    assert latex.latex_paragraphs(rows.limit(0)).count() == 0


def test_long_text_is_linear():
    row = latex._Reader("\\a{ " * 200_000 + "\n\nend").row()
    assert row[0] == "end" and row[-1] == "recovered"


def test_paragraphs_read_a_source_once(spark):
    """The condition on the text once read every source a second time."""
    rows = spark.createDataFrame([(n, f"One {n}.\n\nTwo.") for n in range(600)] + [(600, ""), (601, None)], "id int, text string")
    out = latex.latex_paragraphs(rows)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert out.count() == 1200 and {r["id"] for r in out.collect()} == set(range(600))
