"""Layout-aware text of HTML pages.

A page is read into a tree with the tags that HTML leaves out (implied ends of
paragraphs, list items, cells, rows and so on; unknown end tags ignored; open
elements closed at the end).  The tree is then laid out as a browser would show
it without pictures: all visible text and nothing else, blocks on lines of their
own, blank lines around paragraphs and headings, list markers with indentation,
preformatted text as it stands, table cells aligned in columns.

Invisible are: head matter, scripts, styles, templates, fallback content of
embedded media, all but the summary of closed details, and what the page's own
styles (``page_styles``) hide: ``display:none`` with all it holds, ``visibility``
hidden or collapse until an element inside is visible again.  ``hidden`` elements
and closed dialogs are not displayed unless the page's styles display them.
Of form fields the value is text, save those of passwords, ticks, sliders,
colours, files and pictures.

Formulas (math) are inline text, without their annotations.  Of inline pictures
(svg) the labels (``text``) and HTML inside ``foreignObject`` are shown where the
picture stands; titles, descriptions and definitions are not, nor text that only
a ``use`` element repeats from them.

Both passes use explicit stacks of at most ``MAX_DEPTH``; time and memory are
linear in the page (table padding is bounded by ``MAX_PAD`` per cell).

Defined results: a null page gives an empty text, as does a page without visible
text; repeated rows and null ids keep a row each; an empty table gives an empty
result; a page may be of any length."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import arrow_map
from attrition.llm.page_styles import Styles

#: Cells wider than this start the next cell without padding.
MAX_PAD = 60
GAP = "  "
#: As in browsers, elements nested deeper than this stand side by side.
MAX_DEPTH = 512

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
INVISIBLE = frozenset("head script style template noscript title meta link base iframe object video audio canvas map datalist noembed noframes".split())
#: Inside an svg, text shows within the first only, and nothing of the second shows.
SVG_SHOWN = frozenset("text foreignobject".split())
SVG_UNSHOWN = frozenset("desc defs metadata symbol clippath mask marker pattern".split())
#: Input elements whose value is not text on the page.
VALUE_UNSHOWN = frozenset("hidden password checkbox radio file image color range".split())
MATH_UNSHOWN = frozenset("annotation annotation-xml mphantom".split())
#: Parts that browsers draw apart.
SPACED = frozenset("text mtr mtd".split())
BLANK_AROUND = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dl figure ul ol menu table fieldset".split())
BLOCK = BLANK_AROUND | frozenset("html body address article aside center details dialog dd div dt figcaption footer form header hgroup hr legend li main nav search section summary caption option optgroup tr tbody thead tfoot".split())
#: A start tag closes an open paragraph.
CLOSES_P = BLOCK - frozenset("html body option optgroup caption tr tbody thead tfoot legend".split())
#: A start tag of the first kind closes open elements of the second, up to one of the third.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "body": (("head",), ()),
}
#: Inside these elements of an svg or formula stands HTML again.
INTEGRATION = frozenset("foreignobject desc mi mo mn ms mtext annotation-xml".split())
#: A start tag of HTML that ends an open svg or formula.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: End tags and implied ends of paragraphs don't reach past these.
SCOPE = frozenset("td th caption table html body template button".split())

_TOKEN = re.compile(r"<!--(?:>|->)|<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>|</[^A-Za-z>][^>]*>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")


class Node:
    """An element; children are nodes and strings."""
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: str = "") -> None:
        self.name, self.attrs, self.children = name, attrs, []

    def attributes(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for m in _ATTR.finditer(self.attrs):
            out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        return out


def build_tree(html: str) -> Node:
    """The page's element tree."""
    root = Node("html")
    stack = [root]

    opened: Counter[str] = Counter()

    def push(node: Node) -> None:
        if len(stack) >= MAX_DEPTH:
            cut(len(stack) - 1)
        stack.append(node)
        opened[node.name] += 1

    def cut(n: int) -> None:
        opened.subtract(x.name for x in stack[n:])
        del stack[n:]

    def close_through(names: tuple[str, ...], stop: tuple[str, ...] | frozenset[str]) -> None:
        """Close open elements up to the outermost of ``names`` inside ``stop``."""
        if not any(opened[x] for x in names):
            return
        found = None
        for n in range(len(stack) - 1, 0, -1):
            if stack[n].name in names:
                found = n
            elif stack[n].name in stop:
                break
        if found is not None:
            cut(found)

    def foreign() -> int:
        """The place of the open svg or formula that a tag here belongs to, or 0."""
        if opened["svg"] or opened["math"]:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].name in ("svg", "math"):
                    return n
                if stack[n].name in INTEGRATION:
                    break
        return 0

    def end(name: str) -> None:
        """Close the innermost open element of that name, if the scope allows."""
        if not opened[name]:
            return
        for n in range(len(stack) - 1, 0, -1):
            if stack[n].name == name:
                cut(n)
                return
            if stack[n].name in SCOPE and name not in SCOPE and name not in ("tr", "tbody", "thead", "tfoot"):
                return

    at, last = 0, html.rfind(">") + 1
    while at < len(html):
        # behind the last bracket no tag ends, and the search need not look for one
        m = _TOKEN.search(html, at, last)
        if m is None:
            stack[-1].children.append(html[at:].partition("<!--")[0])
            break
        if m.start() > at:
            stack[-1].children.append(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA[") and (foreign() or stack[-1].name in INTEGRATION and (opened["svg"] or opened["math"])):
                stop = html.find("]]>", m.start())
                stop = len(html) if stop < 0 else stop
                stack[-1].children.append(html[m.start() + 9:stop].replace("&", "&amp;"))
                at = stop + 3
                continue
            if m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>")):
                break  # a comment without end hides the rest
            continue
        name = m[2].lower()
        if m[1]:
            if name == "p" and not opened["p"]:
                stack[-1].children.append(Node("p"))  # a lone </p> is an empty paragraph
            elif name == "br":
                stack[-1].children.append(Node("br"))
            elif name not in ("html", "body"):
                end(name)
            continue
        if name == "html":
            continue
        within = foreign()
        if within and name in BREAKOUT:
            cut(within)
            within = 0
        if name in CLOSES_P:
            close_through(("p",), SCOPE)
        if name in IMPLIED:
            close_through(*IMPLIED[name])
        if name[0] == "h" and name[1:].isdigit() and stack[-1].name[0] == "h" and stack[-1].name[1:].isdigit():
            cut(len(stack) - 1)
        node = Node(name, m[3])
        stack[-1].children.append(node)
        if m[3].endswith("/") and (within or name in ("svg", "math")):
            continue  # these may close themselves
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            stop = close.start() if close else len(html)
            node.children.append(html[at:stop])
            at = html.find(">", stop) + 1 if close else stop
            at = at or len(html)
        elif name not in VOID and not (m[3].endswith("/") and name in ("path", "circle", "rect", "use")):
            push(node)
    return root


def read_styles(root: Node) -> Styles:
    """The page's style sheets, in order."""
    styles = Styles()
    stack: list[Node] = [root]
    while stack:
        node = stack.pop()
        if node.name == "style":
            styles.add_sheet("".join(x for x in node.children if isinstance(x, str)), node.attributes().get("media", ""))
        else:
            stack += [x for x in reversed(node.children) if isinstance(x, Node)]
    return styles


def displayed(node: Node, parent: Node | None, styles: Styles, drawn: bool, seen: bool) -> tuple[bool, bool]:
    """(whether an element is displayed, whether its own text is visible); ``seen``:
    whether its parent's is."""
    if node.name in INVISIBLE:
        return False, False
    if parent is not None and parent.name == "details" and node.name != "summary" and "open" not in parent.attributes():
        return False, False
    if not node.attrs and not styles.rules:
        return node.name != "dialog", seen
    a = node.attributes() if node.attrs else {}
    said = styles.of(node.name, a)
    if drawn:
        said = {k: a[k].strip().lower() for k in ("display", "visibility") if k in a} | said
    away = "hidden" in a or node.name == "dialog" and "open" not in a
    shown = said.get("display", "none" if away else "") != "none"
    visibility = said.get("visibility", "inherit")
    return shown, seen if visibility in ("inherit", "unset", "revert") else visibility not in ("hidden", "collapse")


class Lines:
    """Text flowing into lines."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.now: list[str] = []
        self.space = False  # a collapsed space waits for the next word
        self.blank = 0  # newlines wanted before the next text
        self.indent: list[str] = []
        self.marker = ""

    def text(self, s: str, pre: bool) -> None:
        if pre:
            for n, part in enumerate(s.split("\n")):
                if n:
                    self.need(1, force=True)
                if part:
                    self._put(part)
            return
        s = _SPACE.sub(" ", s)
        if s == " " or not s:
            self.space = self.space or bool(s and self.now and not self.blank)
            return
        if s[0] == " ":
            self.space = self.space or bool(self.now and not self.blank)
        body = s.strip(" ")
        self._put((" " if self.space and self.now and not self.blank else "") + body)
        self.space = s[-1] == " "

    def _put(self, s: str) -> None:
        if self.blank:
            self._newline()
        if not self.now:
            self.now.append("".join(self.indent) + self.marker)
            if self.marker:
                self.indent[-1] = " " * len(self.marker)
                self.marker = ""
        self.now.append(s)

    def _newline(self) -> None:
        if self.now:
            self.done.append("".join(self.now).rstrip(" "))
            self.now = []
        if self.done:
            self.done += [""] * (self.blank - 1)
        self.blank, self.space = 0, False

    def need(self, n: int, force: bool = False) -> None:
        """At least ``n`` line ends before the next text; ``force``: one more."""
        if force:
            self.blank = self.blank + 1 if self.now or self.done else 0
        elif self.now or self.done:
            self.blank = max(self.blank, n)
        self.space = False

    def mark(self, marker: str) -> None:
        self.need(1)
        self.indent.append("")
        self.marker = marker

    def unmark(self) -> None:
        if self.marker:  # an empty item still shows
            self._put("")
        self.indent.pop()
        self.need(1)

    def lines(self) -> list[str]:
        self.blank = 0
        if self.now:
            self.done.append("".join(self.now).rstrip(" "))
            self.now = []
        return self.done


def _span(node: Node, name: str) -> int:
    value = node.attributes().get(name, "")
    return max(1, min(int(value), 1000)) if value.isascii() and value.isdigit() and len(value) < 6 else 1


def lay_table(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table; a cell is (lines, columns, rows)."""
    placed: list[list[tuple[int, list[str]]]] = []
    taken: dict[int, int] = {}  # column → rows still covered by a cell above
    widths: dict[int, int] = {}
    for row in rows:
        column, out, fresh = 0, [], {}
        for lines, across, down in row:
            while taken.get(column, 0):
                column += 1
            out.append((column, lines))
            if across == 1:
                widths[column] = max(widths.get(column, 0), min(MAX_PAD, max(map(len, lines), default=0)))
            if down > 1:
                fresh.update(dict.fromkeys(range(column, column + across), down))
            column += across
        taken = {c: n - 1 for c, n in (taken | fresh).items() if n > 1}
        placed.append(out)
    used = sorted(widths.keys() | {c for row in placed for c, _ in row})
    starts, at = {}, 0
    for c in used:
        starts[c] = at
        at += widths.get(c, 0) + len(GAP)
    result = []
    for row in placed:
        for n in range(max((len(x) for _, x in row), default=0)):
            line = ""
            for c, lines in row:
                if n < len(lines) and lines[n]:
                    line = line.ljust(starts[c]) if len(line) < starts[c] or not line else line + GAP
                    line += lines[n]
            result.append(line.rstrip(" "))
    return result


class _Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.open_row = False


def render(html: str | None) -> str:
    """The visible text of a page."""
    if not html:
        return ""
    root = build_tree(html)
    styles = read_styles(root)
    page = Lines()
    outs, tables, lists = [page], [], []
    pre = formulas = 0
    seen = [True]  # for each open element, whether its text is visible
    drawn: list[bool] = []  # for each open svg, and part of one that shows text: whether it does
    # (node, parent, leaving)
    work: list[tuple[Node | str, Node | None, bool]] = [(root, None, False)]
    while work:
        node, parent, leaving = work.pop()
        out = outs[-1]
        if isinstance(node, str):
            if parent.name == "details" and "open" not in parent.attributes():
                continue
            if drawn and not drawn[-1] or not seen[-1]:
                continue
            out.text(unescape(node) if "&" in node and parent.name not in ("xmp",) else node, bool(pre))
            continue
        name = node.name
        if not leaving:
            shown, visible = displayed(node, parent, styles, bool(drawn) or name == "svg", seen[-1])
            if not shown:
                continue
            if drawn and name in SVG_UNSHOWN or formulas and name in MATH_UNSHOWN:
                continue
            if name == "br":
                out.need(1, force=True)
                continue
            if name == "hr":
                out.need(1)
                continue
            if name == "input" and visible and node.attrs:
                a = node.attributes()
                if a.get("type", "").strip().lower() not in VALUE_UNSHOWN:
                    out.text(a.get("value", ""), False)
            if name in VOID:
                continue
            work.append((node, parent, True))
            seen.append(visible)
            if name == "svg" or drawn and name in SVG_SHOWN:
                drawn.append(name != "svg")
            formulas += name == "math"
            if (drawn or formulas) and name in SPACED:
                out.text(" ", False)
            if name == "table":
                out.need(1)
                tables.append(_Table())
                outs.append(Lines())
            elif name == "tr" and tables:
                tables[-1].rows.append([])
                tables[-1].open_row = True
            elif name in ("td", "th") and tables:
                if not tables[-1].open_row:
                    tables[-1].rows.append([])
                    tables[-1].open_row = True
                outs.append(Lines())
            elif name in ("ul", "ol", "menu"):
                out.need(1 if lists else 2)
                start = node.attributes().get("start", "") if node.attrs else ""
                lists.append([name, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif name == "li":
                if lists and lists[-1][0] == "ol":
                    out.mark(f"{lists[-1][1]}. " if visible else "")
                    lists[-1][1] += 1
                else:
                    out.mark("- " if visible else "")
            elif name == "dd":
                out.need(1)
                out.indent.append("  ")
            elif name in BLOCK:
                out.need(2 if name in BLANK_AROUND else 1)
            if name in ("pre", "textarea", "xmp"):
                pre += 1
            children = node.children
            if name == "switch" and drawn:  # the first alternative
                children = [x for x in children if isinstance(x, Node)][:1]
            work += [(child, node, False) for child in reversed(children)]
            continue
        seen.pop()
        if (drawn or formulas) and name in SPACED:
            out.text(" ", False)
        formulas -= name == "math"
        if name == "svg" or drawn and name in SVG_SHOWN:
            drawn.pop()
        if name in ("pre", "textarea", "xmp"):
            pre -= 1
        if name == "table":
            around = outs.pop().lines()  # captions and stray text come first
            inner = lay_table(tables.pop().rows)
            out = outs[-1]
            out.need(2 if not tables else 1)
            for line in [*around, *inner]:
                if line:
                    out._put(line)
                    out.need(1)
                elif out.now or out.done:
                    out.blank += 1
            out.need(2 if not tables else 1)
        elif name == "tr" and tables:
            tables[-1].open_row = False
        elif name in ("td", "th") and tables:
            lines = outs.pop().lines()
            tables[-1].rows[-1].append((lines, _span(node, "colspan") if node.attrs else 1, _span(node, "rowspan") if node.attrs else 1))
        elif name in ("ul", "ol", "menu"):
            lists.pop()
            out.need(1 if lists else 2)
        elif name == "li":
            out.unmark()
        elif name == "dd":
            out.indent.pop()
            out.need(1)
        elif name in BLOCK:
            out.need(2 if name in BLANK_AROUND else 1)
    return "\n".join(page.lines())


def html_text(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, text) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a page at a time, so that a batch's pages aren't all held decoded
            for begun in range(0, batch.num_rows, 64):
                part = batch.slice(begun, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([render(h.as_py()) for h in part.column(1)], pa.string())], names=["key", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return arrow_map(pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{html}`").cast("string").alias("html")), run, f"key {kind}, text string")


def text_table(pages: DataFrame) -> DataFrame:
    """One row per page: its text and some measures of it."""
    return html_text(pages).select(F.col("key").alias("page_id"), "text", F.length("text").cast("long").alias("n_chars"),
                                   F.size(F.filter(F.split("text", "\n", -1), lambda x: x != "")).cast("long").alias("n_lines"))
