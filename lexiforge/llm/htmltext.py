"""Operator 7: main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass calls a block good, bad
or open by link density, stop-word density, length and the element it stands in: a block
of links is bad, a long one that holds stop words as running text does is good, a short
or unclear one is open. In the second pass open blocks take the label of the nearest
decided blocks before and after, of the same article if they stand in one, whose ends
count as good; where the two differ, a block is good if it lies in the article or is long
enough, or a heading. So within an article links alone drop nothing, and only what is named
as something else goes. Where a page's longer blocks hold few stop words of any of the languages,
length and links decide without them.

Attributes are read as browsers do: a quote counts only behind an equals sign. Every
character is read a bounded number of times. An element that is left out with all it holds
(a form, a menu, ...) ends at its own end tag; if an element around it ends first, it was
never closed and its text is judged like any other.

Defined cases: null or empty html has empty text; a page cut off in the middle counts as
closed at its end; unknown elements are transparent; comments, scripts, styles,
forms and the like are skipped with all they hold; a script or style without an end hides
the rest; repeated rows repeat; an empty table gives an empty result; other columns are
kept by `extract`, but for those named text and n_chars in any case, which it replaces.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import with_batches

SHORT, LONG = 70, 200
LINKS_BAD, LINKS_SOME = 0.5, 0.2
STOP_HIGH, STOP_LOW = 0.30, 0.12

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a about after all also an and are as at be because been before but by can could do for from had has have he her him his how if in into is it its just like
    more most my no not of on one only or other our out over said she so some than that the their them then there these they this to two up was we were what when
    where which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für hat hatte ich ihr im in ist ja kann mich
    mir mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wer werden wie wir wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et eu il ils je la le les leur lui mais me même mon ne nous on ont ou où par pas plus pour qu que qui
    sa se ses son sont sur tout très tu un une vous
    al como con cuando de del donde el ella en entre era es esta este fue ha hasta hay la las lo los más me mi muy no nos o para pero por porque que se según ser si
    sin sobre su sus también tiene todo un una y ya yo""".split()
)
#: Elements whose whole content is left out.
SKIPPED = frozenset("script style noscript template svg iframe object embed applet form select textarea button input option datalist head canvas audio video map dialog menu".split())
RAW = frozenset("script style textarea title iframe noscript template xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no main text unless an article encloses them as its own header.
FRAMES = frozenset("nav aside footer header".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words of class, id and role attributes that name something beside the main text: as a part of a name,
#: as a whole name, and as a whole name of what stands in no article (in one, the block itself decides).
_PART_NAMES = r"ads?|adv|advert\w*|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|popup|modal|newsletter|subscribe\w*|sidebar\w*|menus?|nav\w*|breadcrumbs?|footer\w*|masthead|topbar|comments?|comment-?list|replies|disqus|related|recommended|social|login|signup|pagination|pager|copyright|disclaimer|complementary|contentinfo|navigation"
_WHOLE_NAMES = r"notices?|alerts?|aside|respond|reply|toolbar|skip"
_OUTER_NAMES = r"side|foot|header|discussion|share|sharing|widgets?|search|tags"
ASIDE_NAMES = re.compile(rf"(?:^|[\s_-])(?:{_PART_NAMES})(?:$|[\s_\d-])|(?:^|\s)(?:{_WHOLE_NAMES})[\d_-]*(?:$|\s)", re.I)
OUTER_NAMES = re.compile(rf"(?:^|\s)(?:{_OUTER_NAMES})[\d_-]*(?:$|\s)", re.I)
#: An article so named is what a reader wrote.
READER_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies)(?:$|[\s_\d-])", re.I)
#: Headings, paragraphs and list items have names for their looks.
UNNAMED = frozenset("html body p li h1 h2 h3 h4 h5 h6".split())
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story|text)(?:$|[\s_-])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Attributes up to the end of a tag; quoted values only follow an equals sign.
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_ATTR = re.compile(r"""([^\s=/"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(\S++)))?+""")
_TOLD = frozenset(("class", "id", "role", "style", "hidden", "aria-hidden"))
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")
_DENSE = re.compile("[\u2e80-\ud7ff\uf900-\ufaff\uff00-\uffef]")


def weight(text: str) -> int:
    """Length of a text, in which a character of the scripts without blanks counts as three."""
    return len(text) if text.isascii() else len(text) + 2 * len(_DENSE.findall(text))


class Block:
    """A run of text; `inside` is the number of the article it stands in, 0 for none."""

    __slots__ = ("text", "linked", "inside", "frame", "heading", "label", "weight", "stops", "words")

    def __init__(self, text: str, linked: int, inside: int, frame: bool, heading: bool):
        self.text, self.linked, self.inside, self.frame, self.heading, self.label = text, linked, inside, frame, heading, ""
        self.weight, self.stops, self.words = weight(text), 0, 0
        if not frame and self.weight >= SHORT:  # of shorter ones length and links decide
            words = _WORD.findall(text.lower())
            self.stops, self.words = sum(w in STOP_WORDS for w in words), len(words)


class _Open:
    """An open element: what held outside it, and if it is left out, the blocks, parts and linked characters before it."""

    __slots__ = ("name", "main", "frame", "link", "heading", "before")

    def __init__(self, name: str, main: int, frame: bool, link: bool, heading: bool, before: tuple[int, int, int] | None):
        self.name, self.main, self.frame, self.link, self.heading, self.before = name, main, frame, link, heading, before


class Reader:
    """Cuts one page into blocks."""

    def __init__(self, page: str):
        self.page, self.found, self.parts, self.linked = page, [], [], 0
        self.stack: list[_Open] = []
        self.count: dict[str, int] = {}
        self.main, self.frame, self.link, self.heading, self.articles = 0, False, False, False, 0
        self.plain = False  # a quote is never closed: tags end at the next bracket
        self.endless: set[str] = set()  # raw elements of which no end tag follows

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.found.append(Block(text, min(self.linked, len(text)), self.main, self.frame, self.heading))
            self.parts.clear()
        self.linked = 0

    def add(self, raw: str) -> None:
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.link:
                self.linked += len(text.strip())

    def tag_end(self, at: int) -> tuple[str, int] | None:
        """(attributes, place behind the tag) of the tag whose name ends at `at`."""
        if not self.plain:
            m = _REST.match(self.page, at)
            if m:
                return m[1], m.end()
            self.plain = True
        close = self.page.find(">", at)
        return None if close < 0 else (self.page[at:close], close + 1)

    def close(self, depth: int, own: bool) -> None:
        """Ends the elements from `depth` on, the first of them by its own tag or not."""
        for element in self.stack[depth:]:
            self.count[element.name] -= 1
        first = self.stack[depth]
        if own and first.before is not None:
            blocks, parts, linked = first.before
            if len(self.found) == blocks:  # an element within a block
                del self.parts[parts:]
                self.linked = linked
            else:
                self.parts.clear()
                self.linked = 0
            del self.found[blocks:]
        self.main, self.frame, self.link, self.heading = first.main, first.frame, first.link, first.heading
        del self.stack[depth:]

    def end_tag(self, name: str) -> None:
        if name in BLOCKS or name in SKIPPED:
            self.flush()
        if not self.count.get(name):
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth].name == name:
                self.close(depth, True)
                return
            if name not in BLOCKS and name not in SKIPPED and self.stack[depth].name in BLOCKS:
                # An inline element that ends in another block than it began in ends with its block.
                return

    def start_tag(self, name: str, told: str, at: int) -> int:
        if name in ("br", "wbr"):
            self.parts.append("\n" if name == "br" else "")
            return at
        if name in BLOCKS or name in SKIPPED:
            self.flush()
        attrs: dict[str, str] = {}
        for m in _ATTR.finditer(told):
            key = m[1].lower()
            if key in _TOLD and key not in attrs:
                attrs[key] = m[2] or m[3] or m[4] or ""
        if name in VOID:
            return at
        own_end = told.endswith("/")
        if name in RAW and not (name == "title" and any(self.count.get(n) for n in ("body", "article", "main"))):
            return self.skip_raw(name, at)
        away = name in SKIPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(HIDDEN.search(attrs.get("style", "")))
        if own_end and (away or name not in BLOCKS):
            return at
        if name == "p" and self.count.get("p"):  # a paragraph ends where the next begins
            for depth in range(len(self.stack) - 1, -1, -1):
                if self.stack[depth].name == "p":
                    self.close(depth, True)
                    break
                if self.stack[depth].name in BLOCKS:
                    break
        self.stack.append(_Open(name, self.main, self.frame, self.link, self.heading, (len(self.found), len(self.parts), self.linked) if away else None))
        self.count[name] = self.count.get(name, 0) + 1
        names = f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}"
        begins = name in ("article", "main") and not self.frame
        if name not in UNNAMED and names.strip():
            if name in ("article", "main"):
                self.frame = self.frame or (name == "article" and bool(READER_NAMES.search(names)))
                begins = begins and not self.frame
            elif ASIDE_NAMES.search(names) or (not self.main and OUTER_NAMES.search(names)):
                self.frame = True
            elif MAIN_NAMES.search(names) and name in BLOCKS and not self.frame:
                begins = True
        if name in FRAMES and not (name == "header" and self.main):
            self.frame = True
        if begins and not self.main:
            self.articles += 1
            self.main = self.articles
        self.link = self.link or name == "a"
        self.heading = self.heading or (len(name) == 2 and name[0] == "h" and name[1] in "123456")
        return at

    def skip_raw(self, name: str, at: int) -> int:
        if name not in self.endless:
            m = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(self.page, at)
            if m:
                return m.end()
            self.endless.add(name)
        return len(self.page) if name in ("script", "style") else at

    def blocks(self) -> list[Block]:
        page, at, end = self.page, 0, len(self.page)
        while at < end:
            lt = page.find("<", at)
            if lt < 0:
                self.add(page[at:])
                break
            self.add(page[at:lt])
            if page.startswith("<!--", lt):
                close = page.find("-->", lt + 4)
                at = end if close < 0 else close + 3
                continue
            if page.startswith(("<!", "<?"), lt):
                close = page.find(">", lt)
                at = end if close < 0 else close + 1
                continue
            m = _NAME.match(page, lt + 1)
            if not m:
                self.parts.append("<")
                at = lt + 1
                continue
            told = self.tag_end(m.end())
            if told is None:  # no tag ends any more: what follows is a tag that was cut off
                break
            name, at = m[2].lower(), told[1]
            if m[1]:
                self.end_tag(name)
            else:
                at = self.start_tag(name, told[0], at)
        self.flush()
        for element in self.stack:  # what is left out and still open at the end of the page
            if element.before is not None:
                del self.found[element.before[0] :]
                break
        return self.found


def blocks_of(page: str) -> list[Block]:
    """The blocks of text of a page in order, without what is skipped."""
    return Reader(page).blocks()


def first_label(block: Block, framed: bool, known: bool) -> str:
    """good, bad or open, by the block alone; `framed`: the page has an article; `known`: it is written in a language of the stop words, else length and links decide."""
    n, inside = block.weight, block.inside > 0
    links = block.linked / len(block.text)
    if block.frame or (links > LINKS_BAD and not inside):
        return "bad"
    share = block.stops / block.words if block.words else 0.0
    if inside:
        return "good" if n >= SHORT and (share >= STOP_LOW or not known) and links <= LINKS_SOME else "open"
    if framed:
        return "bad" if n < LONG or links > LINKS_SOME or (known and share < STOP_LOW) else "open"
    if n < SHORT:
        return "bad" if links > LINKS_SOME else "open"
    if n > LONG and (share >= STOP_HIGH if known else links <= LINKS_SOME):
        return "good"
    return "open" if share >= STOP_LOW or not known else "bad"


def language_known(blocks: list[Block]) -> bool:
    """Whether the longer blocks that aren't links hold stop words as one of the languages does; a page without any counts as known."""
    long = [b for b in blocks if not b.frame and b.weight >= SHORT and b.linked <= LINKS_SOME * len(b.text)]
    return not long or sum(b.stops for b in long) >= STOP_LOW * max(1, sum(b.words for b in long))


def classify(blocks: list[Block]) -> None:
    """Sets label to good or bad."""
    framed = any(b.inside and not b.frame for b in blocks)
    known = language_known(blocks)
    for b in blocks:
        b.label = first_label(b, framed, known)

    def decided(order: list[Block]) -> list[str]:
        """The label of the nearest decided block before each in this order."""
        out, last, place = [], "bad", 0
        for b in order:
            if b.inside != place:
                last, place = "good" if b.inside else "bad", b.inside
            out.append(last)
            if b.label != "open" and not b.frame:
                last = b.label
        return out

    before, after = decided(blocks), decided(blocks[::-1])[::-1]
    for b, one, two in zip(blocks, before, after):
        if b.label == "open":
            b.label = one if one == two else "good" if b.inside or b.weight >= SHORT or b.heading else "bad"


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of pages (all if None), text and n_chars."""

    def make(pages_of: pa.Array) -> list[pa.Array]:
        texts = [main_text(h) for h in pages_of.to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return with_batches(pages, pages.columns if keep is None else keep, [F.col("html")], "text string, n_chars long", make)


def op7_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
