"""Layout-aware text of HTML pages.

A tree is built with HTML's implied tags (a paragraph ends where a block begins, an
item where the next begins, and so on), void elements and raw-text elements. The
renderer walks the tree and emits all visible text: blocks stand on lines of their
own, paragraphs and headings are set apart by a blank line, list items carry their
marker and nesting (up to `DEEPEST` steps of indent), table cells are padded to the width of
their columns, those that span columns or rows included.

Invisible: head (but for nothing else than the title, which is not page text),
script, style, template, noscript, elements with an attribute named hidden (but until-found), display:none
declarations of a style attribute, what visibility:hidden covers up to a nested visibility:visible, an svg's title, desc, metadata and
defs, comments and declarations. Of a select the shown options are visible: the last selected
one or else the first that is not disabled; of a list box (multiple or size) all.

Cases: null or empty HTML gives empty text. Unclosed, misnested and deeply nested
tags never fail; the walk doesn't recurse, and finds what a tag closes by the places of open
tags, not by walking up. Text outside any tag is page text. Repeated rows are rendered each.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from wayfold.llm.frames import text_batches

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object math datalist audio video canvas".split())
SVG_UNSEEN = frozenset("desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient".split())
BLOCK = frozenset(
    "address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
ENDS_P = BLOCK - frozenset("html body tr td th tbody thead tfoot caption li dt dd legend summary".split()) | {"hr"}
#: An opening tag on the left closes, up to the nearest scope element, those on the right.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: Steps of indent that are drawn, and spans as HTML bounds them.
DEEPEST, MOST_COLUMNS, MOST_ROWS = 32, 1000, 65534
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
_QUOTED = re.compile(r"\"(?:[^\"\\]|\\.)*(?:\"|\Z)|'(?:[^'\\]|\\.)*(?:'|\Z)", re.DOTALL)
#: Attribute strings without these words can't hide anything.
_MAYBE = re.compile(r"hidden|style", re.IGNORECASE)
_START = re.compile(r"(?:^|\s)start\s*=\s*[\"']?(-?\d{1,9})", re.IGNORECASE)
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []


class Open:
    """The open elements, and the places of each tag among them."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        """Close the elements from a place on."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        """The place of the innermost open element of some tags; 0 without one."""
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def end(self, ends: set[str], scope: set[str]) -> None:
        """Close the outermost of `ends` that is open inside the nearest `scope`, or table cell unless cells are meant."""
        inner = self.last(scope if "td" in ends else scope | {"td", "th"})
        found = [p[k] for t in ends if (p := self.places[t]) and (k := bisect_right(p, inner)) < len(p)]
        if found:
            self.cut(min(found))

    def close(self, name: str) -> None:
        """What a closing tag does; it reaches out of a table cell only to parts of tables."""
        if name in ("html", "body"):
            return
        place = self.last((name,))
        if place and (name in ("table", "tr", "tbody", "thead", "tfoot") or place >= self.last(("td", "th", "table"))):
            self.cut(place)
        elif name == "p":  # a closing tag alone makes an empty paragraph
            self.nodes[-1].kids.append(Node("p"))

    def open(self, name: str) -> None:
        """Close what an opening tag implies to be over."""
        if name in ENDS_P:
            self.end({"p"}, {"table", "button", "caption", "html"})
        if name in CLOSES:
            self.end(*CLOSES[name])
        elif self.nodes[-1].tag == "head" and name not in HEAD_ONLY and name != "head" or name in HEADINGS and self.nodes[-1].tag in HEADINGS:
            self.cut(len(self.nodes) - 1)

    def text(self, raw: str) -> None:
        if self.nodes[-1].tag == "head" and raw.strip():
            self.cut(len(self.nodes) - 1)
        self.nodes[-1].kids.append(entities.unescape(raw) if "&" in raw else raw)


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def parse(source: str) -> Node:
    """The tree of a page. Text children are plain strings."""
    root = Node("html")
    tree = Open(root)
    at, size = 0, len(source)
    while at < size:
        m = _TOKEN.search(source, at)
        if m is None:
            tree.text(source[at:])
            break
        if m.start() > at:
            tree.text(source[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            tree.close(name)
        elif name in ("html", "body") and any(n.tag == name for n in tree.nodes[:3]):
            root.attrs += m[3] if name == "html" else ""
        else:
            attrs = m[3]
            drawn = (attrs.endswith("/") or name in SVG_UNSEEN) and tree.last(("svg", "math")) > 0
            if drawn and name in SVG_UNSEEN:  # defines what is drawn elsewhere or not at all
                attrs = f" hidden {attrs}"
            tree.open(name)
            node = Node(name, attrs)
            tree.nodes[-1].kids.append(node)
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
                node.kids.append(source[at : end.start() if end else size])
                at = end.end() if end else size
            elif name not in VOID and not (attrs.endswith("/") and (drawn or name in ("svg", "math"))):
                tree.push(node)
    return root


class Lines:
    """Finished lines, and the line that is being written."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.now: list[str] = []
        self.gap = False  # a blank line is due
        self.blank = True  # the line so far ends in white space or is empty
        self.lead = ""  # a marker before the next text
        self.depth = 0  # steps of indent

    def write(self, text: str, keep: bool = False) -> None:
        if keep:
            first, *more = text.split("\n")
            self._put(first)
            for line in more:
                self.end(force=True)
                self._put(line)
            return
        text = _BLANKS.sub(" ", text)
        if self.blank:
            text = text.lstrip(" ")
        if text:
            self._put(text)
            self.blank = text[-1] == " "

    def _put(self, text: str) -> None:
        if not text:
            return
        if not self.now:
            if self.gap and self.done:
                self.done.append("")
            self.gap = False
            indent = "  " * min(self.depth, DEEPEST)
            self.now.append(indent[: len(indent) - len(self.lead)] + self.lead if self.lead else indent)
            self.lead = ""
        self.now.append(text)
        self.blank = False

    def end(self, apart: bool = False, force: bool = False) -> None:
        if self.now or force:
            self.done.append("".join(self.now).rstrip())
            self.now = []
        self.blank = True
        self.gap = self.gap or apart

    def text(self) -> str:
        self.end()
        return "\n".join(self.done).strip("\n")


def attributes(raw: str) -> dict[str, str]:
    """Names in lower case and values; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _declared(style: str) -> dict[str, str]:
    """The declarations of a style attribute: the last of each property, or the important one."""
    last: dict[str, tuple[bool, str]] = {}
    for part in _QUOTED.sub("''", _COMMENT.sub(" ", style)).split(";"):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        head, bang, tail = value.rpartition("!")
        important = bool(bang) and tail.strip() == "important"
        value = head.strip() if important else value
        if colon and value and (important or not last.get(name, (False, ""))[0]):
            last[name] = important, value
    return {name: value for name, (_, value) in last.items()}


def _shown(node: Node, visible: bool = True) -> bool | None:
    """Whether a node's own text is visible where its parent's is `visible`; None where the node is not rendered at all."""
    if node.tag in UNSEEN:
        return None
    if not node.attrs or not _MAYBE.search(node.attrs):
        return visible
    named = attributes(node.attrs)
    if named.get("hidden", "until-found").strip().lower() != "until-found":
        return None
    style = _declared(named.get("style", ""))
    if style.get("display") == "none":
        return None
    return {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility", ""), visible)


def _seen(node: Node) -> bool:
    return bool(_shown(node))


def _span(node: Node, name: str, most: int) -> int:
    raw = attributes(node.attrs).get(name, "").strip() if name in node.attrs.lower() else ""
    return min(most, int(raw[:6])) or 1 if raw[:6].isdecimal() else 1


def _options(select: Node) -> list[Node]:
    """The options that a select shows."""
    options, stack = [], [(kid, False) for kid in reversed(select.kids)]
    while stack:
        kid, off = stack.pop()
        if isinstance(kid, str):
            continue
        if kid.tag == "option":
            options.append((kid, off))
        elif _seen(kid):
            off = off or kid.tag == "optgroup" and "disabled" in attributes(kid.attrs)
            stack += [(k, off) for k in reversed(kid.kids)]
    named = attributes(select.attrs)
    size = named.get("size", "")
    if "multiple" in named or size.isdecimal() and int(size) > 1:
        return [o for o, _ in options if _seen(o)]
    chosen = [o for o, _ in options if "selected" in attributes(o.attrs)]
    free = [o for o, off in options if not off and "disabled" not in attributes(o.attrs)]
    return chosen[-1:] or free[:1]


def render(root: Node) -> str:
    """All visible text below a node."""
    out, stack = Lines(), []
    #: Entered and left nodes, and whether text is visible there; a table's cells are rendered by Lines of their own.
    stack.append((root, False, True))
    lists: list[list] = []
    tables: list[dict] = []
    outs = [out]
    pre = 0
    while stack:
        node, left, visible = stack.pop()
        out = outs[-1]
        if isinstance(node, str):
            if visible and not (tables and tables[-1]["cell"] is None and not node.strip()):
                out.write(node, keep=pre > 0)
            continue
        tag = node.tag
        if not left:
            visible = _shown(node, visible)
            if visible is None:
                continue
            if not visible and tag in ("select", "textarea"):
                continue
            if tag == "br":
                out.end(force=True)
                continue
            if tag == "hr":
                out.end(apart=True)
                continue
            if tag == "img":
                continue
            if tag == "text":  # of an svg, placed by itself
                out.write(" ")
            if tag == "select":
                out.write(" ")
                for k, option in enumerate(_options(node)):
                    if k:
                        out.end()
                    label = attributes(option.attrs).get("label", "")
                    shown, kids = [], list(reversed(option.kids))
                    while kids:
                        kid = kids.pop()
                        if isinstance(kid, str):
                            shown.append(kid)
                        elif _seen(kid):
                            kids += reversed(kid.kids)
                    out.write(label or "".join(shown))
                out.write(" ")
                continue
            if tag == "textarea":
                out.write(entities.unescape(node.kids[0]) if node.kids else "", keep=True)
                continue
            if tag in BLOCK:
                out.end(apart=tag in APART and not (tag in ("ul", "ol") and lists))
            if tag in ("ul", "ol", "menu"):
                begin = _START.search(node.attrs)
                lists.append([tag, int(begin[1]) if begin else 1])
                out.depth += 1
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                out.lead = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                if not lists:
                    out.depth += 1
            elif tag in ("dd", "blockquote"):
                out.depth += 1
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                tables.append({"rows": [], "cell": None, "lists": lists, "pre": pre})
                lists, pre = [], 0
            elif tables and tag == "tr" and tables[-1]["cell"] is None:
                tables[-1]["rows"].append([])
            elif tables and tag in ("td", "th") and tables[-1]["cell"] is None:
                tables[-1]["cell"] = node
                if not tables[-1]["rows"]:
                    tables[-1]["rows"].append([])
                outs.append(Lines())
            stack.append((node, True, visible))
            stack += [(kid, False, visible) for kid in reversed(node.kids)]
        else:
            if tables and tables[-1]["cell"] is node:
                outs.pop()
                tables[-1]["rows"][-1].append((out.text(), _span(node, "colspan", MOST_COLUMNS), _span(node, "rowspan", MOST_ROWS)))
                tables[-1]["cell"] = None
                continue
            if tag in BLOCK:
                out.end(apart=tag in APART and not (tag in ("ul", "ol") and len(lists) > 1))
            if tag in ("ul", "ol", "menu"):
                lists.pop()
                out.depth -= 1
            elif tag == "li":
                out.lead = ""
                if not lists:
                    out.depth -= 1
            elif tag in ("dd", "blockquote"):
                out.depth -= 1
            elif tag == "pre":
                pre -= 1
            elif tag == "table":
                table = tables.pop()
                lists, pre = table["lists"], table["pre"]
                _rows(out, table["rows"])
                out.end(apart=True)
    return outs[0].text()


def _rows(out: Lines, rows: list[list[tuple[str, int, int]]]) -> None:
    """Cells (text, columns, rows) side by side, each column as wide as its widest line; a cell of several lines spreads down.

    A cell that spans rows stands in its first one and keeps its columns free below.
    """
    placed: list[list[tuple[int, int, list[str]]]] = []
    widths: list[int] = []
    taken: dict[int, int] = {}  # columns that a cell above still spans, and for how many rows
    wide: list[tuple[int, int, int]] = []
    for row in rows:
        at, cells = 0, []
        for text, columns, down in row:
            while at in taken:
                at += 1
            lines = text.split("\n")
            cells.append((at, columns, lines))
            width = max(map(len, lines))
            widths += [0] * (at + columns - len(widths))
            if columns == 1:
                widths[at] = max(widths[at], width)
            else:
                wide.append((at, columns, width))
            if down > 1:
                taken.update(dict.fromkeys(range(at, at + columns), down))
            at += columns
        placed.append(cells)
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
    for at, columns, width in wide:  # what the columns don't hold, the last one takes
        widths[at + columns - 1] += max(0, width - sum(widths[at : at + columns]) - 2 * (columns - 1))
    starts = [0]
    for w in widths:
        starts.append(starts[-1] + w + 2)
    for cells in placed:
        if not any(any(lines) for _, _, lines in cells):
            continue
        for k in range(max(len(lines) for _, _, lines in cells)):
            line = ""
            for at, _, lines in cells:
                if k < len(lines) and lines[k]:
                    line = line.ljust(starts[at]) + lines[k]
            out.end()
            out.write(line.rstrip(), keep=True)
            out.end(force=not line.strip())


def text_of(source: str | None) -> str:
    return render(parse(source)) if source else ""


SCHEMA = "page_id long, text string, n_chars long, n_lines long"


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: its visible text, the text's code points and lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())],
                names=["page_id", "text", "n_chars", "n_lines"],
            )

    return text_batches(pages).select(pages[id_col].cast("long").alias("page_id"), pages[html_col].cast("string").alias("html")).mapInArrow(run, SCHEMA)
