"""Text of LaTeX sources: a push-down automaton over tokens, with a stack of environments and a bound on errors.

Rules. A comment, a line break command and table marks are blank. A formula is one marker, and formulas with
nothing but line ends between them are one marker, the first's. A command takes the groups in brackets and braces
that follow it, over one line end at most, and leaves its name. A theorem-like environment, a list and a quotation
keep their text; any other environment leaves its name only, whatever is nested in it. `\\begin{document}` opens
nothing and `\\end{document}` ends the text. Two line ends are a paragraph; `\\par` is one too.

Errors. An `\\end` of another name is left out; a paragraph within a list ends the list; a group or a formula that is
not closed ends with its paragraph; a bracket that closes a brace, or the reverse, closes it. After ERRORS errors
reading stops with status `stopped`. Environments open at the end give status `unclosed`; otherwise it is `good`,
or `recovered` if there was an error.

Defined cases: null is null; an empty text is empty and good; included files are listed, not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERRORS = 1000
#: Sources whose results a task holds at once.
PART = 256
INLINE, DISPLAY, ITEM = "_inline_math_", "_display_math_", "_item_"

# The environments by what becomes of them, the characters that count as blanks and as marks.
THEOREMS = ("def", "definition", "Definition", "thm", "theorem", "Theorem", "lemma", "remark", "prop", "proposition", "Proposition", "axiom", "Axiom", "hyp", "hypothesis", "Hypothesis", "cor", "corollary", "Corollary")
LISTS = ("itemize", "enumerate", "cases")
QUOTED = ("center", "flushleft", "flushright", "minipage", "quotation", "quote", "verse", "tabbing", "multline", "split")
KEPT = THEOREMS + LISTS + QUOTED
TABS = ("=", ">", "+", "-")
BLANKS = r" \t\f\r~@&\"#*="
ACCENTED = r"\\['`^\"~=]\p{L}|\\[cvuH]\{\p{L}\}|\{\\(?:oe|ae|ss|aa|AA|o|O|AE|OE|l|L)\}"

_WORD = rf"(?:[\p{{L}}\p{{M}}]|{ACCENTED})+"
_NAME = rf"[{BLANKS}]*\{{[{BLANKS}]*"
#: The first kind that fits is the longest one, as they stand.
_TOKEN = regex.compile(
    rf"(?P<blank>[{BLANKS}]+|\\\\\*?|%[^\n]*)|(?P<eol>\n)|(?P<word>{_WORD}(?:-{_WORD})*'?s?)|(?P<number>[0-9]+(?:\.[0-9]+)?)|(?P<stop>[.?!])"
    rf"|(?P<begin>\\begin{_NAME}(?P<opened>[A-Za-z]+\*?)[{BLANKS}]*\}})|(?P<end>\\end{_NAME}(?P<closed>[A-Za-z]+\*?)[{BLANKS}]*\}})"
    r"|(?P<input>\\(?:input|include)[ \t\f\r]*\{[ \t\f\r]*(?P<file>[^} \t\f\r\n]*)[ \t\f\r]*\})"
    r"|(?P<open>[\[{]|\\[\[(])|(?P<close>[\]}]|\\[\])])|(?P<dollar>\$\$?)|\\(?P<command>[A-Za-z]+|[^\n])|(?P<mark>.)"
)
_ACCENT = regex.compile(r"\\['`^\"~=]|\\[cvuH]\{|[\\{}']")
_MATES = {"]": "[", "}": "{", "\\]": "\\[", "\\)": "\\("}

SCHEMA = "text string, n_inline int, n_display int, commands array<string>, environments array<string>, inputs array<string>, errors array<string>, status string"


class _Stop(Exception):
    """Too many errors."""


class _Reader:
    """The run over one text; `out` holds its pieces, None between paragraphs."""

    def __init__(self, raw: str):
        self.tokens = [m for m in _TOKEN.finditer(raw) if m.lastgroup != "blank"]
        self.at, self.stack, self.out = 0, [], []  # the stack holds names and whether their text is kept
        self.formula, self.ends, self.inline, self.display = False, 0, 0, 0
        self.commands, self.environments, self.inputs, self.errors = [], [], [], []

    def wrong(self, what: str) -> None:
        self.errors.append(what)
        if len(self.errors) >= ERRORS:
            raise _Stop

    def put(self, piece: str) -> None:
        """A piece, after a paragraph break if two line ends came before; an empty one only keeps formulas apart."""
        if self.ends > 1 and self.out and self.out[-1] is not None:
            self.out.append(None)
        self.ends = 0
        if piece:
            self.out.append(piece)

    def breaks(self) -> bool:
        """Whether a paragraph ends here."""
        return [m.lastgroup for m in self.tokens[self.at : self.at + 2]] == ["eol", "eol"]

    def skip(self, left: str, counted: tuple[str, ...]) -> None:
        """Goes past the group whose left delimiter was read; `counted` delimiters nest in it."""
        levels = [left]
        while levels:
            if self.at == len(self.tokens) or self.breaks():
                return self.wrong(f"{left} is not closed")
            kind, token = self.tokens[self.at].lastgroup, self.tokens[self.at][0]
            self.at += 1
            if kind == "dollar" and "$" in counted and levels[-1] == token:
                levels.pop()
            elif (kind == "dollar" and "$" in counted) or (kind == "open" and token in counted):
                levels.append(token)
            elif kind == "close" and _MATES[token] in counted:
                if levels[-1] != _MATES[token]:
                    self.wrong(f"{token} closes {levels[-1]}")
                levels.pop()

    def groups(self) -> None:
        """Goes past the groups after a command."""
        while True:
            after = self.at + (self.at < len(self.tokens) and self.tokens[self.at].lastgroup == "eol")
            left = self.tokens[after][0] if after < len(self.tokens) else ""
            if left not in ("[", "{"):
                return
            self.at = after + 1
            self.skip(left, ("{",) if left == "{" else ("{", "["))

    def math(self, left: str, kept: bool) -> None:
        self.skip(left, ("$", "{", "\\[", "\\("))
        if not kept:
            return
        if not self.formula or self.ends > 1:
            wide = left in ("$$", "\\[")
            self.put(DISPLAY if wide else INLINE)
            self.display, self.inline = self.display + wide, self.inline + (not wide)
        self.formula, self.ends = True, 0

    def begin(self, name: str, kept: bool) -> str:
        if kept:
            self.environments.append(name)
        self.stack.append((name, kept and name in KEPT))
        return "case" if kept and name == "cases" else ""

    def end(self, name: str) -> str:
        if not self.stack or self.stack[-1][0] != name:
            self.wrong(f"{name} ends, {self.stack[-1][0] if self.stack else 'nothing'} is open")
            return ""
        kept = self.stack.pop()[1]
        return "end" if kept and name == "cases" else ""

    def line(self, top: str, kept: bool) -> None:
        if top in LISTS and self.breaks():
            self.wrong(f"a paragraph ends within {top}")
            self.stack = [e for e in self.stack if e[0] not in LISTS]
        self.at += 1
        self.ends += kept

    def command(self, name: str, top: str, kept: bool) -> str:
        self.groups()
        if top in LISTS and name == "item":
            return ITEM if kept else ""
        if kept and not (top == "tabbing" and name in TABS):
            self.commands.append(name)
        return ""

    def run(self) -> str:
        """Reads all tokens; the status."""
        while self.at < len(self.tokens):
            m, (top, kept) = self.tokens[self.at], self.stack[-1] if self.stack else ("", True)
            kind, piece = m.lastgroup, ""
            if kind == "eol":
                self.line(top, kept)
                continue
            if kind in ("word", "number", "mark"):  # nearly all tokens
                self.at += 1
                if kept:
                    piece = "" if kind == "mark" else m[0]
                    self.put(piece if piece.isalnum() else _ACCENT.sub("", piece))
                    self.formula = False
                continue
            self.at += 1
            if kind == "dollar" or m[0] in ("\\[", "\\("):
                self.math(m[0], kept)
                continue
            if m["command"] == "par":
                self.ends += 2 * kept
                continue
            if "document" in (m["opened"], m["closed"]):
                if m["closed"]:
                    break
            elif kind == "begin":
                piece = self.begin(m["opened"], kept)
            elif kind == "end":
                piece = self.end(m["closed"])
            elif kind == "command":
                # Line ends within or before its groups come after it.
                piece = self.command(m["command"], top, kept)
            elif kind == "input" and kept:
                self.inputs.append(m["file"])
            elif kind == "stop":
                piece = "."
            if kept:
                self.put(piece)
                self.formula = False
        return "unclosed" if self.stack else "recovered" if self.errors else "good"

    def row(self) -> tuple:
        try:
            status = self.run()
        except _Stop:
            status = "stopped"
        paragraphs = " ".join("\n\n" if p is None else p for p in self.out).replace(" \n\n ", "\n\n").removesuffix(" \n\n")
        return paragraphs, self.inline, self.display, self.commands, self.environments, self.inputs, self.errors, status


def _read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for texts in batches:
        for begin in range(0, len(texts), PART):
            yield pd.DataFrame([(None,) * len(names) if raw is None else _Reader(raw).row() for raw in texts.iloc[begin : begin + PART]], columns=names, dtype=object)


def latex_record(raw: Column) -> Column:
    """The text of a source, its paragraphs parted by an empty line, with what was met on the way; null for null."""
    return F.when(raw.isNotNull(), F.pandas_udf(_read, SCHEMA)(raw))


def latex_paragraphs(articles: DataFrame, raw: str = "text") -> DataFrame:
    """Every column but the source, `paragraph` (from 0) and `words` of its text; a source without text has no row."""
    kept = [F.col(f"`{c}`") for c in articles.columns if c != raw]
    # Exploded as one row, so that no condition reads the source again.
    read = articles.select(*kept, F.explode(F.array(latex_record(F.col(raw))["text"])).alias(raw)).where(F.col(raw) != "")
    return read.select(*kept, F.posexplode(F.split(raw, "\n\n")).alias("paragraph", "words"))
