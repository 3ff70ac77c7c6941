"""Layout-aware HTML rendering: a tree builder with implied tags, and a renderer of what is visible.

The builder closes and opens what HTML lets authors leave out (``p``, ``li``, ``dt``, ``tr``, ``td``,
``option``, ``tbody``), keeps raw text apart, repairs end tags that match nothing, and puts before a table what
stands in it outside of its cells. The renderer leaves out what a page does not show: ``head``, scripts, styles,
templates and ``noscript``, comments; what plugins, frames and players replace (``object``, ``iframe``, ``audio``,
``video``, ``canvas``); the names and definitions of drawings and the annotations of formulas; options that are not
chosen; ``hidden``, ``display:none`` and ``visibility:hidden``, in attributes or by style rules of the page
whose selectors are a tag, classes and an id (others, and media other than screens, are not applied). It sets
blocks apart, marks list items by bullets or numbers with their depth, keeps white space in ``pre``, and lays
table cells out in columns. Columns in which no cell begins take no room; no more than 1,000 blanks align a cell; tables in more than eight others stand cell under cell.

Defined results: a null or empty page has an empty text. Pages are read whole, unclosed or broken as
they may be, in time that grows with their length; a tag that the page's end cuts off is dropped, as browsers do. Nesting
beyond 400 levels is flattened, its text kept. Repeated rows give equal rows. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_rows

MAX_DEPTH = 400
# The elements of HTML by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist area title desc metadata defs annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption ul".split()
)
#: Blocks with an empty line around them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr article section".split())
CLOSES_P = BLOCK - {"body", "html", "option", "optgroup", "caption", "legend"}
LISTS = frozenset("ul ol menu dir".split())
#: A new element -> the open ones that it ends, and those beyond which it does not look.
IMPLIED = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: Parts of a table -> the open elements that they belong into.
PARTS = {
    "td": ("tr", "tbody", "thead", "tfoot", "table"), "th": ("tr", "tbody", "thead", "tfoot", "table"), "tr": ("tbody", "thead", "tfoot", "table"),
    "tbody": ("table",), "thead": ("table",), "tfoot": ("table",), "caption": ("table",), "colgroup": ("table",), "col": ("colgroup", "table"),
}
#: Where only parts of a table may stand, and what else is left there.
BETWEEN_CELLS = frozenset("table tbody thead tfoot tr".split())
KEPT_BETWEEN = frozenset("style script template".split())
MOST_WIDE, MOST_HIGH = 1000, 65534
#: Blanks that align a cell, at most: beyond it a line would grow with all columns before.
MOST_GAP = 1000
#: Tables within tables that are laid out in columns: each lays the lines of those in it anew.
MOST_TABLES = 8

_NAME = re.compile(r"[a-zA-Z][^\t\n\f\r />]*+")
_MORE = re.compile(r"""[\t\n\f\r /]*+(?:(>)|([^\t\n\f\r />][^\t\n\f\r />=]*+)(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:"([^"]*+)("?)|'([^']*+)('?)|([^\t\n\f\r >]*+)))?)""")
_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_RULE = re.compile(r"([^{}]*+)\{([^{}]*+)\}")
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
_SHOWING = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children", "parent")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag = tag
        self.parent: Node | None = None
        self.attributes = attributes or {}
        self.children: list[Node | str] = []


def _tag(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """The attributes from ``at`` on, whether the tag is closed before the page's end, and where it ends."""
    out: dict[str, str] = {}
    while m := _MORE.match(page, at):
        at = m.end()
        if m[1]:
            return out, True, at
        if (m[3] is not None and not m[4]) or (m[5] is not None and not m[6]):
            break  # a quote that nothing closes
        if (name := m[2].lower()) not in out:
            out[name] = html.unescape(m[3] or m[5] or m[7] or "")
    return out, False, len(page)


class _Builder:
    def __init__(self) -> None:
        self.root = Node("")
        self.stack = [self.root]
        self.opened: Counter[str] = Counter()

    def push(self, node: Node) -> None:
        if len(self.stack) < MAX_DEPTH:
            self.stack.append(node)
            self.opened[node.tag] += 1

    def cut(self, depth: int) -> None:
        """Close all elements from this depth on."""
        for node in self.stack[depth:]:
            self.opened[node.tag] -= 1
        del self.stack[depth:]

    def put(self, child: Node | str, part: bool = False) -> None:
        """Into the open element; before the table, if only cells and rows may stand here."""
        here = self.stack[-1]
        if here.tag in BETWEEN_CELLS and not part and not (isinstance(child, str) and child.isspace()) and (depth := self.nearest({"table"})):
            table = self.stack[depth]
            here = table.parent
            at = len(here.children) - self.opened["table"]  # it is last, but for the tables around it
            if at < 0 or here.children[at] is not table:
                at = next(i for i in range(len(here.children) - 1, -1, -1) if here.children[i] is table)
            here.children.insert(at, child)
        else:
            here.children.append(child)
        if isinstance(child, Node):
            child.parent = here

    def nearest(self, tags, walls=()) -> int:
        """The depth of the innermost open element of these; 0 where a wall comes first, or nothing."""
        if not any(self.opened[t] for t in tags):
            return 0
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag in tags:
                return depth
            if self.stack[depth].tag in walls:
                break
        return 0

    def open(self, node: Node, part: bool = False) -> None:
        self.put(node, part)
        self.push(node)

    def end(self, tag: str) -> None:
        if tag == "p" and not self.opened["p"]:
            self.put(Node("p"))
        elif tag == "br":
            self.put(Node("br"))
        else:
            walls = set() if tag in ("body", "html", "template") else {"table", "template"} if tag in PARTS or tag == "table" else {"table", "td", "th", "caption", "template"}
            if depth := self.nearest({tag}, walls):
                self.cut(depth)

    def start(self, tag: str, attributes: dict[str, str]) -> Node | None:
        """The new element; None where HTML has no second one, or none outside of a table."""
        stack = self.stack
        if tag in ("html", "body") and self.opened[tag]:
            return None
        if tag in PARTS and not self.nearest(PARTS[tag], {"template"}):
            self.put(" ", True)
            return None
        if tag == "body" or (len(stack) > 1 and stack[-1].tag == "head" and tag not in VOID | RAW | {"noscript", "template"}):
            if depth := self.nearest({"head"}):
                self.cut(depth)
        node = Node(tag, attributes)
        if tag in PARTS:
            self.cut(self.nearest(PARTS[tag]) + 1)
            if tag in ("td", "th") and stack[-1].tag != "tr":
                self.open(Node("tr"), True)
            (self.put if tag in VOID else self.open)(node, True)
            return node
        if tag in CLOSES_P and (depth := self.nearest({"p"}, ("table", "td", "th", "caption", "button", "object"))):
            self.cut(depth)
        if tag in IMPLIED:
            ends, walls = IMPLIED[tag]
            lowest = 0
            for depth in range(len(stack) - 1, 0, -1) if any(self.opened[t] for t in ends) else ():
                if stack[depth].tag in walls:
                    break
                if stack[depth].tag in ends:
                    lowest = depth
            if lowest:
                self.cut(lowest)
        if stack[-1].tag in BETWEEN_CELLS and (tag in KEPT_BETWEEN or tag == "form"):
            self.put(node, True)
            if tag == "template":
                self.push(node)
        elif tag in VOID or tag in RAW:
            self.put(node)
        else:
            self.open(node)
        return node


def build(page: str) -> Node:
    """The tree of a page; its root has no name. Each character is read once or twice."""
    tree, at, size = _Builder(), 0, len(page)
    while at < size:
        less = page.find("<", at)
        if less < 0:
            less = size
        if less > at:
            tree.put(html.unescape(page[at:less]))
        if less + 1 >= size:
            if less < size:
                tree.put("<")
            break
        follows = page[less + 1]
        ends = follows == "/"
        named = _NAME.match(page, less + 2 if ends else less + 1)
        if named:
            attributes, closed, at = _tag(page, named.end())
            if not closed:
                break
            tag = named[0].lower()
            if ends:
                tree.end(tag)
            elif (node := tree.start(tag, attributes)) and tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\t\n\f\r />])", re.I).search(page, at) if tag != "plaintext" else None
                body = page[at : end.start() if end else size]
                node.children.append(html.unescape(body) if tag in ("title", "textarea") else body)
                at = _tag(page, end.end())[2] if end else size
        elif follows in "!?/":
            comment = _COMMENT.match(page, less)
            close = page.find(">", less)
            at = comment.end() if comment else close + 1 if close >= 0 else size
        else:
            tree.put("<")
            at = less + 1
    return tree.root


class Styles:
    """What the rules of a page and its attributes say of an element: whether it is there, and whether it is seen."""

    def __init__(self, root: Node):
        self.rules: dict[str, list[tuple[tuple, str, set[str], set[str], dict[str, tuple[str, bool]]]]] = {}
        todo, count = [root], 0
        while todo:
            node = todo.pop()
            if node.tag == "style" and _SPACE.sub("", node.attributes.get("media", "all")).lower() in ("", "all", "screen"):
                for text in node.children:
                    count = self._read(str(text), count)
            todo += [c for c in reversed(node.children) if not isinstance(c, str)]

    def _read(self, text: str, count: int) -> int:
        text = re.sub(r"/\*.*?(?:\*/|\Z)", " ", text, flags=re.S)
        if "@" in text:  # rules for other media, and what is not a rule
            text = self._without_at_rules(text)
        for selectors, body in _RULE.findall(text):
            said = {m[1].lower(): (m[2].lower(), bool(m[3])) for m in _SHOWING.finditer(body)}
            for selector in selectors.split(",") if said else ():
                m = _SELECTOR.fullmatch(selector.strip())
                if not m or not m[0]:
                    continue
                names = re.findall(r"[.#][\w-]+", m[2])
                classes, ids = {n[1:] for n in names if n[0] == "."}, {n[1:] for n in names if n[0] == "#"}
                tag = (m[1] or "*").lower()
                count += 1
                key = f"#{min(ids)}" if ids else f".{min(classes)}" if classes else tag
                self.rules.setdefault(key, []).append(((len(ids), len(classes), tag != "*", count), tag, classes, ids, said))
        return count

    @staticmethod
    def _without_at_rules(text: str) -> str:
        out, at = [], 0
        for m in re.finditer(r"@[^{};]*+(?:;|\{|\Z)", text):
            if m.start() < at:
                continue
            out.append(text[at : m.start()])
            at = m.end()
            if m[0].endswith("{"):
                depth, begun = 1, at
                for brace in re.finditer(r"[{}]", text[at:]):
                    depth += 1 if brace[0] == "{" else -1
                    if not depth:
                        break
                at = begun + brace.end() if depth == 0 else len(text)
                if re.fullmatch(r"@media\s+(?:only\s+)?(?:screen|all)\s*\{", m[0], re.I):
                    out.append(text[begun : at - 1])
        return "".join([*out, text[at:]])

    def said(self, node: Node) -> dict[str, str]:
        """``display`` and ``visibility`` as far as anything says them."""
        a = node.attributes
        own = {m[1].lower(): (m[2].lower(), bool(m[3])) for m in _SHOWING.finditer(a["style"])} if "style" in a else {}
        if not self.rules:
            return {k: v for k, (v, _) in own.items()}
        classes = set(a["class"].split()) if "class" in a else set()
        keys = [node.tag, "*", *(f".{c}" for c in classes), *([f"#{a['id']}"] if "id" in a else [])]
        found: dict[str, tuple] = {}
        for key in keys:
            for rank, tag, wanted, ids, said in self.rules.get(key, ()):
                if tag in ("*", node.tag) and wanted <= classes and ids <= {a.get("id")}:
                    for k, (value, strong) in said.items():
                        found[k] = max(found.get(k, ((False, False, (0, 0, 0, 0)), "")), ((strong, False, rank), value))
        for k, (value, strong) in own.items():
            found[k] = max(found.get(k, ((False, False, (0, 0, 0, 0)), "")), ((strong, True, (0, 0, 0, 0)), value))
        return {k: value for k, (_, value) in found.items()}

    def shows(self, node: Node, seen: bool) -> tuple[bool, bool]:
        """Whether an element takes part in the layout, and whether its text is seen (inherited unless said)."""
        a = node.attributes
        if node.tag in UNSEEN or (node.tag == "input" and a.get("type", "").lower() == "hidden") or (node.tag == "dialog" and "open" not in a):
            return False, False
        said = self.said(node) if a or self.rules else {}
        there = said.get("display", "none" if "hidden" in a else "") != "none"
        return there, {"visible": True, "hidden": False, "collapse": False}.get(said.get("visibility", ""), seen)


def width(text: str) -> int:
    """Columns that a text takes on a screen: wide characters two, marks none."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Lines:
    """Lines as they come: pending space and pending empty lines are settled by what follows."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.indent = ""
        self.mark = ""

    def words(self, text: str) -> None:
        text = text.replace("­", "")
        parts = _SPACE.sub(" ", text)
        body = parts.strip(" ")
        if not body:
            self.space = self.space or bool(parts and self.line)
            return
        lead = parts[0] == " " or self.space
        self._open()
        if lead and len(self.line) > 1:
            self.line.append(" ")
        self.line.append(body)
        self.space = parts[-1] == " "

    def _open(self) -> None:
        if not self.line:
            if self.gap and self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
            self.line.append(self.indent[: len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent)
            self.mark = ""
            self.space = False

    def end(self, gap: int = 1) -> None:
        """End the line; the next begins after ``gap - 1`` empty lines at least."""
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False
        self.gap = max(self.gap, gap)

    def hard_break(self) -> None:
        if self.line:
            self.end()
        else:
            self._open()
            self.end()

    def raw(self, text: str) -> None:
        """Preformatted text."""
        if self.space and len(self.line) > 1:
            self.line.append(" ")
        self.space = False
        for i, part in enumerate(text.split("\n")):
            if i:
                self.hard_break()
            if part:
                self._open()
                self.line.append(part.expandtabs(8))

    def text(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


def _span(cell: Node, name: str, most: int) -> int:
    value = cell.attributes.get(name, "1").strip()
    return min(most, max(1, int(value[:9]))) if value.isascii() and value.isdigit() else 1


class _Held:
    """Columns that cells of earlier rows still take: pieces, each up to its row, and the runs that adjoining pieces make.

    A piece is put in once and taken out once, so rows cost what changes in them, not what is held.
    """

    def __init__(self):
        self.pieces: list[int] = []
        self.of: dict[int, tuple[int, int]] = {}  # first column of a piece: column after it, row up to which it is held
        self.due: list[tuple[int, int]] = []
        self.first: list[int] = []
        self.last: list[int] = []

    def free_from(self, x: int) -> int:
        """The first column from ``x`` on that is not taken."""
        i = bisect_right(self.first, x) - 1
        return max(x, self.last[i]) if i >= 0 else x

    def release(self, y: int) -> None:
        """Let go of what is held up to row ``y``."""
        while self.due and self.due[0][0] <= y:
            row, a = heappop(self.due)
            if self.of.get(a, (0, 0))[1] != row:
                continue  # was cut for a longer one
            b, _ = self.of.pop(a)
            del self.pieces[bisect_left(self.pieces, a)]
            i = bisect_right(self.first, a) - 1
            left, right = (self.first[i], a), (b, self.last[i])
            rest = [r for r in (left, right) if r[0] < r[1]]
            self.first[i : i + 1] = [r[0] for r in rest]
            self.last[i : i + 1] = [r[1] for r in rest]

    def _put(self, a: int, b: int, row: int) -> None:
        if a < b:
            self.pieces.insert(bisect_left(self.pieces, a), a)
            self.of[a] = (b, row)
            heappush(self.due, (row, a))

    def take(self, a: int, b: int, row: int) -> None:
        """Hold ``a`` to ``b`` up to ``row``; where columns are held already, the later row counts. ``a`` itself is free."""
        at, i = a, bisect_left(self.pieces, a)
        while i < len(self.pieces) and self.pieces[i] < b:
            p = self.pieces[i]
            end, until = self.of[p]
            if until >= row:
                self._put(at, p, row)
                at = max(at, end)
            else:
                del self.pieces[i], self.of[p]
                self._put(b, end, until)
            i = bisect_left(self.pieces, max(p + 1, at))
        self._put(at, b, row)
        i, j = bisect_left(self.last, a), bisect_right(self.first, b)
        if i < j:
            a, b = min(a, self.first[i]), max(b, self.last[j - 1])
        self.first[i:j] = [a]
        self.last[i:j] = [b]


class _Renderer:
    def __init__(self, root: Node):
        self.styles = Styles(root)
        self.tables = 0

    def children(self, node: Node, out: _Lines, depth: int, pre: bool, seen: bool) -> None:
        for child in node.children:
            self.render(child, out, depth + 1, pre, seen)

    def rows(self, table: Node, seen: bool) -> list[list[tuple[Node, bool]]]:
        """The cells of a table's own rows with whether they are seen, head first and foot last."""
        groups: dict[str, list[list[tuple[Node, bool]]]] = {"thead": [], "tbody": [], "tfoot": []}

        def there(parent: Node, seen: bool, tags):
            for child in parent.children:
                if not isinstance(child, str) and child.tag in tags:
                    shown, child_seen = self.styles.shows(child, seen)
                    if shown:
                        yield child, child_seen

        for child, child_seen in there(table, seen, ("tr", *groups)):
            for row, row_seen in [(child, child_seen)] if child.tag == "tr" else there(child, child_seen, ("tr",)):
                groups[child.tag if child.tag in groups else "tbody"].append(list(there(row, row_seen, ("td", "th"))))
        return [r for g in groups.values() for r in g]

    def table(self, node: Node, out: _Lines, depth: int, seen: bool) -> None:
        for child in node.children:
            if not isinstance(child, str) and child.tag not in ("tr", "thead", "tbody", "tfoot", "colgroup", "col"):
                self.render(child, out, depth + 1, False, seen)  # captions
                out.end()
        grid: list[list[tuple[int, int, list[str]]]] = []
        held = _Held()
        for y, cells in enumerate(self.rows(node, seen)):
            row, x = [], 0
            held.release(y)
            for cell, cell_seen in cells:
                x = held.free_from(x)
                if self.tables >= MOST_TABLES:
                    out.end()
                    self.children(cell, out, depth, False, cell_seen)
                    continue
                inner = _Lines()
                self.tables += 1
                self.children(cell, inner, depth, False, cell_seen)
                self.tables -= 1
                wide, high = _span(cell, "colspan", MOST_WIDE), _span(cell, "rowspan", MOST_HIGH)
                row.append((x, wide, [line for line in inner.text().split("\n") if line]))
                if high > 1:
                    held.take(x, x + wide, y + high)
                x += wide
            grid.append(row)
        widths: dict[int, int] = {}
        for row in grid:
            for x, wide, lines in row:
                widths[x] = max(widths.get(x, 0), *map(width, lines)) if wide == 1 and lines else widths.get(x, 0)
        used = sorted(widths)
        for row in grid:  # cells over more columns widen the last of them
            for x, wide, lines in row:
                if wide > 1 and lines:
                    over = used[bisect_left(used, x) : bisect_left(used, x + wide)]
                    widths[over[-1]] += max(0, max(map(width, lines)) + 2 - sum(widths[c] + 2 for c in over))
        starts, at = {}, 0
        for x in used:
            starts[x] = at
            at += widths[x] + 2
        for row in grid:
            placed: list[list[tuple[int, str]]] = []
            for x, _, lines in row:
                placed += [[] for _ in range(len(lines) - len(placed))]
                for k, text in enumerate(lines):
                    placed[k].append((starts[x], text))
            for texts in placed:
                line, column = [], 0
                for start, text in texts:
                    gap = max(start - column, 2 if line else 0)
                    line += [" " * min(gap, MOST_GAP), text]
                    column += gap + width(text)
                out._open()
                out.line.append("".join(line))
                out.end()

    def items(self, node: Node, out: _Lines, depth: int, pre: bool, seen: bool, indent: str) -> None:
        ordered = node.tag == "ol"
        start = node.attributes.get("start", "1").strip()
        number = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
        for child in node.children:
            if isinstance(child, str) or child.tag != "li":
                self.render(child, out, depth + 1, pre, seen)
                continue
            shown, child_seen = self.styles.shows(child, seen)
            if not shown:
                continue
            value = child.attributes.get("value", "").strip()
            number = int(value) if ordered and re.fullmatch(r"-?[0-9]{1,9}", value) else number
            out.end()
            bullet = f"{number}. " if ordered else "- "
            number += 1
            out.indent = indent + " " * len(bullet)
            out.mark = bullet if child_seen else ""
            self.children(child, out, depth, pre, child_seen)
            out.end()
            out.indent, out.mark = indent, ""

    def chosen(self, node: Node) -> list[tuple[str, bool]]:
        """The labels of a control's options, and whether they are chosen."""
        found, todo = [], list(reversed(node.children))
        while todo:
            child = todo.pop()
            if isinstance(child, str):
                continue
            if child.tag == "option":
                texts, inner = [], [child]
                while inner:
                    n = inner.pop()
                    if isinstance(n, str):
                        texts.append(n)
                    else:
                        inner += reversed(n.children)
                found.append((child.attributes.get("label") or "".join(texts), "selected" in child.attributes))
            else:
                todo += reversed(child.children)
        size = node.attributes.get("size", "1")
        if "multiple" in node.attributes or (size.isascii() and size.isdigit() and int(size[:9]) > 1):
            return found
        return [next((f for f in reversed(found) if f[1]), found[0])] if found else []

    def render(self, node: Node | str, out: _Lines, depth: int, pre: bool, seen: bool) -> None:
        if isinstance(node, str):
            if seen:
                (out.raw if pre else out.words)(node)
            return
        there, seen = self.styles.shows(node, seen)
        if not there:
            return
        tag = node.tag
        if tag == "br":
            out.hard_break()
            return
        if tag == "wbr" or (tag in VOID and tag not in ("hr", "img", "input")):
            return
        if tag in ("img", "input"):
            button = node.attributes.get("type", "text").lower() in ("submit", "button", "reset")
            value = node.attributes.get("alt" if tag == "img" else "value", "")
            if seen and (tag == "img" or button):
                out.words(value)
            return
        if tag in ("select", "textarea"):
            if not seen:
                return
            if tag == "textarea":
                out.raw("".join(c for c in node.children if isinstance(c, str)).removeprefix("\n"))
            for i, (label, _) in enumerate(self.chosen(node) if tag == "select" else ()):
                if i:
                    out.end()
                out.words(label)
            return
        nested = tag in LISTS and depth > 0 and bool(out.indent)
        gap = 2 if tag in SPACED and not nested else 1
        if tag in BLOCK:
            out.end(gap if out.lines or out.line else 0)
        if tag == "hr":
            out.end(2)
            return
        indent, mark = out.indent, out.mark
        if tag == "table":
            self.table(node, out, depth, seen)
        elif tag in LISTS:
            self.items(node, out, depth, pre, seen, indent)
        else:
            if tag in ("blockquote", "dd"):
                out.indent = indent + "  "
            if tag == "q" and seen:
                out.words("“")
            self.children(node, out, depth, pre or tag == "pre", seen)
            if tag == "q" and seen:
                out.space = False
                out.words("”")
        out.indent = indent
        if mark and not out.mark:
            mark = ""
        out.mark = mark
        if tag in BLOCK:
            out.end(gap)


def title(root: Node) -> str:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "title":
            return _SPACE.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip()
        todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    return ""


def render(page: str | None) -> tuple[str, str]:
    """``title, text`` of a whole page."""
    if not page:
        return "", ""
    root = build(page)
    out, renderer = _Lines(), _Renderer(root)
    for child in root.children:
        renderer.render(child, out, 0, False, True)
    return title(root), out.text()


ADDS = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType())])


def extract(pages: DataFrame, key: str = "page_id", page: str = "html", url: str | None = "url") -> DataFrame:
    """One row a page: its key, its address where there is one, its title and its visible text."""
    kept = [pages[key].alias("page_id"), *([pages[url].alias("url")] if url else [])]
    rows = pages.select(*kept, pages[page].alias("html"))

    def make():
        def run(batch):
            made = [render(p) for p in batch]
            return {"title": [t for t, _ in made], "text": [x for _, x in made], "n_lines": [x.count("\n") + 1 if x else 0 for _, x in made]}

        return run

    return map_rows(rows, make, "html", ADDS, ["page_id", *(["url"] if url else [])])
