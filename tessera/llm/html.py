"""Layout-aware text of HTML pages.

A tokenizer feeds a tree builder that supplies implied tags (a new paragraph ends an open one, a
new row an open cell, content the head, and so on); the renderer then walks the tree by display rules. All visible text is
emitted: blocks stand on lines of their own with blank lines between paragraphs, list items are
marked and indented, preformatted text keeps its white space, and the cells of a table are
aligned in columns. Tokenizer, builder and renderer take time in proportion to the page, and nest without recursion:
indentation stops growing at ``INDENT`` characters, and tables within ``ALIGNED`` tables, or wider than ``WIDE``
characters, are not aligned, all of which changes blanks alone.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._blobs import trim

# Element names of the HTML standard by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
IN_HEAD = frozenset("base basefont bgsound link meta title script style noscript template noframes".split())
HIDDEN = frozenset("script style head title meta link template noscript iframe noembed noframes object audio video canvas svg math datalist area base param source track".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul caption tr tbody thead tfoot xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl menu dir table figure hr fieldset".split())
ENDS_P = BLOCK - frozenset("html body optgroup option caption tr tbody thead tfoot legend".split())
#: A start tag closes the nearest open element of the first set, unless one of the second stands above it.
IMPLIED = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th caption colgroup", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "tbody": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "thead": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "tfoot": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "option": ("option", "select datalist"),
    "optgroup": ("option optgroup", "select"),
}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
SCOPE = frozenset("table td th caption button object template".split())

INDENT, ALIGNED, WIDE = 80, 16, 4000
#: The limits of the standard for the spans of a cell.
MOST_COLUMNS, MOST_ROWS = 1000, 65534

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_BETWEEN = re.compile(r"[\s/]*")
_KEY = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_ZEROS = re.compile(r"(&#[xX]?)0{8,}")
_HUGE = re.compile(r"&#(?:[xX]0*[1-9a-fA-F][0-9a-fA-F]{6,}|0*[1-9][0-9]{7,});?")
_NUMBER = re.compile(r"\s*([+-]?)0*([0-9]+)", re.A)
_VISIBILITY = re.compile(r"visibility:(visible|hidden|collapse)")
_NO_ATTRIBUTES: dict[str, str] = {}


def unescape(x: str) -> str:
    """Character references decoded; numbers beyond Unicode are U+FFFD, however long."""
    if "&" not in x:
        return x
    if "&#" in x:
        x = _HUGE.sub("�", _ZEROS.sub(r"\g<1>0", x))
    return entities.unescape(x)


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []


class _Open:
    """The open elements, and for each name where in the stack it is open."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, k: int) -> None:
        for node in self.stack[k:]:
            self.places[node.name].pop()
        del self.stack[k:]

    def nearest(self, *names: str) -> int:
        """The innermost place of any of the names, or 0."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def outermost(self, names: frozenset[str], above: int) -> int:
        """The outermost place of any of the names above a place, or 0."""
        found = []
        for n in names:
            places = self.places.get(n, ())
            k = bisect_right(places, above)
            if k < len(places):
                found.append(places[k])
        return min(found, default=0)


def _tag(page: str, at: int) -> tuple[int, dict[str, str], bool] | None:
    """From behind a tag's name: where the tag ends, its attributes, and whether a slash closes it; None if it doesn't end."""
    attributes = _NO_ATTRIBUTES
    while True:
        start, at = at, _BETWEEN.match(page, at).end()
        if at >= len(page):
            return None
        if page[at] == ">":
            return at + 1, attributes, "/" in page[start:at]
        key = _KEY.match(page, at)
        at = key.end()
        value = ""
        if equals := _EQUALS.match(page, at):
            at = equals.end()
            quote = page[at : at + 1]
            if quote in ("'", '"') and quote:
                end = page.find(quote, at + 1)
                if end < 0:
                    return None
                value, at = page[at + 1 : end], end + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        if attributes is _NO_ATTRIBUTES:
            attributes = {}
        attributes.setdefault(key[0].lower(), unescape(value))


def parse(page: str) -> Node:
    """The tree of a page; text nodes are str. Any input gives a tree, and nothing is lost: a tag that does not end is text."""
    root = Node("html", _NO_ATTRIBUTES)
    open_, at, size, began = _Open(root), 0, len(page), False

    def text(x: str) -> None:
        nonlocal began
        if x and not x.isspace():
            began = True
            if k := open_.nearest("head"):
                open_.cut(k)
        if x:
            open_.stack[-1].children.append(x)

    while at < size:
        less = page.find("<", at)
        if less < 0:
            text(page[at:])
            break
        if less > at:
            text(page[at:less])
        if page.startswith("<!--", less):
            end = page.find("-->", less + 2)
            at = size if end < 0 else max(end, less + 1) + 3
            continue
        if page[less + 1 : less + 2] in ("!", "?") and less + 1 < size:
            end = page.find(">", less)
            at = size if end < 0 else end + 1
            continue
        name = _NAME.match(page, less + 1)
        if not name:
            text("<")
            at = less + 1
            continue
        found = _tag(page, name.end())
        if found is None:
            text(page[less:])
            break
        at, attributes, closed = found
        closing, name = name[1], name[2].lower()
        if closing:
            if name in ("html", "body", "br") and (k := open_.nearest("head")):
                open_.cut(k)
            _close(open_, name)
            continue
        if name in ("html", "body"):
            root.attributes = {**attributes, **root.attributes}
            if name == "body":
                began = True
                if k := open_.nearest("head"):
                    open_.cut(k)
            continue
        if name == "head":
            if not began:
                began = True
                node = Node(name, attributes)
                root.children.append(node)
                open_.push(node)
            continue
        if (k := open_.nearest("head")) and name not in IN_HEAD and not open_.nearest("template"):
            open_.cut(k)
        if name not in IN_HEAD:
            began = True
        if name in ENDS_P:
            k = open_.nearest("p")
            if k > open_.nearest(*SCOPE):
                open_.cut(k)
        if name in IMPLIED:
            ends, scope = IMPLIED[name]
            if k := open_.outermost(ends, open_.nearest(*scope)):
                open_.cut(k)
        node = Node(name, attributes)
        open_.stack[-1].children.append(node)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else size])
            stop = page.find(">", end.end()) if end else -1
            at = stop + 1 if stop >= 0 else size
        elif not (closed and name in ("svg", "math")):
            open_.push(node)
    return root


def _close(open_: _Open, name: str) -> None:
    """An end tag closes the nearest element of its name within its table cell; without one it is ignored."""
    k = open_.nearest(name)
    if not k:
        return
    if name not in ("table", "tr", "tbody", "thead", "tfoot") and open_.nearest("td", "th", "caption") > k:
        return
    if name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") and open_.nearest("table") > k:
        return
    open_.cut(k)


def gone(node: Node) -> bool:
    """Whether neither the element nor anything in it is displayed."""
    if node.name in HIDDEN:
        return True
    a = node.attributes
    if not a:
        return False
    if "hidden" in a or (node.name == "input" and a.get("type", "").lower() == "hidden") or (node.name == "dialog" and "open" not in a):
        return True
    return "display:none" in _style(a)


def _style(a: dict[str, str]) -> str:
    return re.sub(r"\s+", "", a["style"].lower()) if "style" in a else ""


def seen(node: Node, before: bool) -> bool:
    """Whether text of the element is visible, which what is in it inherits but may change."""
    found = _VISIBILITY.findall(_style(node.attributes)) if node.attributes else None
    return found[-1] == "visible" if found else before


class _Writer:
    """Lines of text; blanks collapse and vertical space is the most that its neighbours ask for.

    Within an indented part space above its first line and below its last one is left out.
    """

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.indent, self.mark, self.started = 0, "", None, False
        self.outer: list[tuple] = []

    def text(self, x: str) -> None:
        x = _BLANKS.sub(" ", x)
        if not self.line or self.line[-1].endswith(" "):
            x = x.lstrip(" ")
        if x:
            self.line.append(x)

    def end(self, space: int = 0) -> None:
        """Ends the line; ``space`` blank lines follow before the next."""
        done = "".join(self.line).rstrip(" ")
        self.line = []
        if done:
            self._add(done)
        if self.started:
            self.gap = max(self.gap, space)

    def rows(self, lines: list[str], space: int = 0) -> None:
        self.end(space)
        for x in lines:
            self._add(x)
        if lines:
            self.gap = max(self.gap, space)

    def _add(self, x: str) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        self.lines.append((self.indent if self.mark is None else self.mark) + x if x else x)
        if x:
            self.mark = None
        self.started = True

    def push(self, mark: str) -> None:
        """Indents what follows by a mark, which stands before the first line."""
        self.end()
        self.outer.append((self.indent, self.mark, self.started, self.gap))
        base = self.indent if self.mark is None else self.mark
        self.mark = base + mark if len(base) < INDENT else base
        if len(self.indent) < INDENT:
            self.indent += " " * len(mark)
        self.started = False

    def pop(self, space: int = 0) -> None:
        self.end()
        indent, mark, started, gap = self.outer.pop()
        self.indent = indent
        if self.started:
            self.gap = space
        else:
            self.mark, self.started, self.gap = mark, started, gap


def _width(x: str) -> int:
    return len(x) if x.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in x)


def _number(x: str | None, default: int, least: int, most: int) -> int:
    """The number at the start of an attribute, within its limits."""
    found = _NUMBER.match(x or "")
    if not found:
        return default
    value = int(found[2][:10]) if len(found[2]) < 11 else most
    return min(max(-value if found[1] == "-" else value, least), most)


def _table(node: Node, shown: bool, depth: int) -> Iterator:
    """Rows of cells padded to the width of their columns; a cell of several lines fills as many rows of text.

    Yields (children, visible, depth) to be rendered and is sent their lines.
    """
    captions, rows, todo = [], [], [(c, shown) for c in reversed(node.children)]
    while todo:
        c, visible = todo.pop()
        if isinstance(c, str):
            if not c.isspace():
                captions.extend((yield [c], visible, depth))
        elif gone(c):
            continue
        elif c.name == "tr":
            visible = seen(c, visible)
            rows.append([(k, visible) for k in c.children if not (isinstance(k, str) and k.isspace())])
        elif c.name in ("tbody", "thead", "tfoot"):
            visible = seen(c, visible)
            todo += [(k, visible) for k in reversed(c.children)]
        elif c.name not in ("colgroup", "col"):
            captions.extend((yield [c], visible, depth))
    grid: list[dict[int, list[str]]] = []
    taken: dict[int, tuple[int, int]] = {}
    widths: dict[int, int] = {}
    for r, row in enumerate(rows):
        cells, column = {}, 0
        for c, visible in row:
            plain = isinstance(c, str)
            if not plain and gone(c):
                continue
            while (above := taken.get(column)) and above[0] >= r:
                column = above[1]
            if not plain and c.name in ("td", "th"):
                lines = yield c.children, seen(c, visible), depth
                span = _number(c.attributes.get("colspan"), 1, 1, MOST_COLUMNS)
                deep = _number(c.attributes.get("rowspan"), 1, 0, MOST_ROWS) or MOST_ROWS
            else:
                lines, span, deep = (yield [c], visible, depth), 1, 1
            cells[column] = lines
            widths[column] = max([widths.get(column, 0), *map(_width, lines)])
            if deep > 1:
                taken[column] = r + deep - 1, column + span
            column += span
        grid.append(cells)
    places, total = {}, 0
    for c in sorted(widths):
        places[c] = total
        total += widths[c] + 2 if widths[c] else 0
    out = captions
    for cells in grid:
        for k in range(max([len(x) for x in cells.values()], default=0)):
            line, used = [], 0
            for c, lines in cells.items():
                if k < len(lines) and lines[k]:
                    pad = places[c] - used if total <= WIDE else 2 if line else 0
                    line.append(" " * pad + lines[k])
                    used = places[c] + _width(lines[k])
            out.append("".join(line).rstrip())
    return out


def _plain(node: Node, shown: bool) -> str:
    out, todo = [], [(c, shown) for c in reversed(node.children)]
    while todo:
        c, visible = todo.pop()
        if isinstance(c, str):
            if visible:
                out.append(c)
        elif c.name == "br":
            out.append("\n")
        elif not gone(c):
            visible = seen(c, visible)
            if c.name in ("img", "input") and visible:
                out.append(_replaced(c))
            todo += [(k, visible) for k in reversed(c.children)]
    return "".join(out)


def _replaced(c: Node) -> str:
    """The text that stands for an image or in a field."""
    if c.name == "img":
        return c.attributes.get("alt", "")
    return c.attributes.get("value", "") if c.attributes.get("type", "text").lower() not in ("checkbox", "radio", "password", "file", "color", "range") else ""


def _lines(children: list, shown: bool, depth: int) -> Iterator:
    """The lines of some nodes within ``depth`` tables, by a stack of open elements.

    Each has its children left, whether its text is visible, what follows it, and the number of its next item if it is a list (a
    plain one counts from None). Yields what a table asks for, and is sent its lines.
    """
    out = _Writer()
    nothing = lambda: None
    stack: list[list] = [[iter(children), shown, nothing, False, None]]
    while stack:
        frame = stack[-1]
        left, visible, leave, is_list, number = frame
        c = next(left, None)
        if c is None:
            stack.pop()
            leave()
            continue
        if isinstance(c, str):
            if is_list:
                if not c.isspace():
                    out.end()
                    if visible:
                        out.text(unescape(c))
                    out.end()
            elif visible:
                out.text(unescape(c))
            continue
        name = c.name
        if name == "br":
            if out.line:
                out.end()
            elif out.started:
                out.gap = max(out.gap, 1)
            continue
        if gone(c):
            continue
        inner = seen(c, visible)
        if is_list:
            if name != "li":
                out.push("  ")
                stack.append([iter([c]), visible, out.pop, False, None])
                continue
            if number is not None:
                number = _number(c.attributes.get("value"), number, -(1 << 31), (1 << 31) - 1)
                frame[4] = number + 1
            out.push("- " if number is None else f"{number}. ")
            stack.append([iter(c.children), inner, out.pop, False, None])
        elif name == "table" and depth < ALIGNED:
            table, found = _table(c, inner, depth + 1), None
            try:
                while True:
                    found = yield table.send(found)
            except StopIteration as done:
                out.rows(done.value, 1)
        elif name in ("pre", "xmp"):
            text = unescape(_plain(c, inner)) if name == "pre" else _plain(c, inner)
            out.rows([x.rstrip() for x in text.removeprefix("\n").rstrip().split("\n")] if text.strip() else [], 1)
        elif name in ("ul", "ol", "menu", "dir"):
            out.end(1)
            first = _number(c.attributes.get("start"), 1, -(1 << 31), (1 << 31) - 1) if name == "ol" else None
            stack.append([iter(c.children), inner, lambda: out.end(1), True, first])
        elif name in ("blockquote", "dd"):
            space = int(name == "blockquote")
            out.end(space)
            out.push("  ")
            stack.append([iter(c.children), inner, lambda space=space: out.pop(space), False, None])
        elif name in ("img", "input"):
            if inner:
                out.text(_replaced(c))
        elif name == "hr":
            out.end(1)
        elif name in BLOCK or name == "table":
            space = int(name in SPACED)
            out.end(space)
            stack.append([iter(c.children), inner, lambda space=space: out.end(space), False, None])
        elif name in ("td", "th"):
            out.text(" ")
            stack.append([iter(c.children), inner, lambda: out.text(" "), False, None])
        elif name == "textarea":
            if inner:
                out.text(unescape(_plain(c, True)))
        elif name == "q":
            if inner:
                out.text("“")
            stack.append([iter(c.children), inner, (lambda: out.text("”")) if inner else nothing, False, None])
        else:
            stack.append([iter(c.children), inner, nothing, False, None])
    out.end()
    return out.lines


def render(node: Node) -> list[str]:
    """The lines of a tree. Tables ask for the lines of their cells, which are rendered on a stack of their own."""
    running, sent = [_lines(node.children, seen(node, True), 0)], None
    while True:
        try:
            asked = running[-1].send(sent)
            running.append(_lines(*asked))
            sent = None
        except StopIteration as done:
            running.pop()
            sent = done.value
            if not running:
                return sent


def _title(tree: Node) -> str | None:
    todo = [tree]
    while todo:
        node = todo.pop()
        if node.name == "title":
            return _BLANKS.sub(" ", unescape("".join(node.children))).strip()
        if node.name not in ("svg", "math"):
            todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    return None


def read(page: str | None) -> tuple[str | None, str]:
    """The title, if there is one, and the visible text of a page; null gives an empty text."""
    if not page:
        return None, ""
    tree = parse(page.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "�"))
    return _title(tree), "" if gone(tree) else "\n".join(render(tree))


def text_of(page: str | None) -> str:
    return read(page)[1]


def title_of(page: str | None) -> str | None:
    return read(page)[0]


def _run(column: str, keep: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles, texts = [], []
            for page in batch.column(len(keep)):
                title, text = read(page.as_py())
                titles.append(title)
                texts.append(text)
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(titles, pa.string()), pa.array(texts, pa.string())], names=[*keep, "title", "text"])
        trim()

    return run


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``title`` and ``text`` in place of the html column, and of columns of these names in any case.

    A row for each row, repeated ones too. A null or empty page has an empty text and a null title; a page
    without markup is its text. Whole pages are read, whatever their length, each once, in time proportional to it; an
    empty table gives an empty result.
    """
    keep = [c for c in pages.columns if c.lower() not in (column.lower(), "title", "text")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in keep)
    return pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").cast("string").alias("_page")).mapInArrow(_run(column, keep), f"{schema}, title string, text string" if schema else "title string, text string")
