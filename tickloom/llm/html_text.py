"""Layout-aware text of HTML pages: a tree with implied tags, visibility rules, and a renderer for blocks, lists and tables."""

from __future__ import annotations

import re
from collections.abc import Generator, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style template noscript iframe object canvas audio video datalist input".split())
#: Parts of a drawing that are not drawn.
UNDRAWN = frozenset("desc defs metadata symbol clippath mask marker pattern".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table caption thead tbody tfoot tr td th ul".split()
)
#: Blocks set off by an empty line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote article section figure".split())
#: For each tag that may be open: the start tags that imply its end.
_BLOCK_ENDS_P = BLOCK - {"body", "html", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "legend", "summary"}
IMPLIED_END = {
    "p": _BLOCK_ENDS_P, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr", "thead", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "thead", "tbody", "tfoot"}, "th": {"td", "th", "tr", "thead", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "caption": {"thead", "tbody", "tfoot", "tr"},
}
#: Elements that an implied end does not reach through.
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "caption": {"table"}, "p": {"td", "th", "table", "button", "caption"}, "option": {"select"}}
#: Start tags that leave a head open; any other one, and text, ends it.
HEAD = frozenset("base link meta title style script noscript template".split())
_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*([a-z-]+)", re.IGNORECASE)
_VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*([a-z]+)", re.IGNORECASE)
_COMMENT, _AT_RULE = re.compile(r"/\*.*?\*/", re.DOTALL), re.compile(r"@[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\})")
_RULE, _SIMPLE = re.compile(r"([^{}]+)\{([^{}]*)\}"), re.compile(r"\s*([A-Za-z][\w-]*)?([.#][\w-]+)?\s*$")
#: HTML's own bounds on the columns and rows of a cell.
MOST_COLUMNS, MOST_ROWS = 1000, 65_534
BULLET = "- "


class Node:
    """An element; ``shown`` is whether it has a box at all, ``visible`` whether its own text can be seen."""

    __slots__ = ("tag", "attrs", "kids", "shown", "visible")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.kids, self.shown, self.visible = tag, attrs, [], True, True

    @property
    def contents(self) -> list:
        """Elements, and the text if it can be seen; the elements may be visible where their parent is not."""
        return self.kids if self.visible else [kid for kid in self.kids if not isinstance(kid, str)]


class Tree(HTMLParser):
    """Builds a tree; an end tag closes up to its element if that is open, and is dropped otherwise."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.count: dict[str, int] = {"html": 1}
        self.styles: list[str] = []

    def imply_ends(self, tag: str) -> None:
        for ended in [t for t, starts in IMPLIED_END.items() if tag in starts and self.count.get(t)]:
            for i in range(len(self.open) - 1, 0, -1):
                name = self.open[i].tag
                if name == ended:
                    self.cut(i)
                    break
                if name in WALLS[ended]:
                    break

    def end_head(self, tag: str = "") -> None:
        """A head without an end tag ends at a start tag or text of the body; what stands in a template or noscript is no part of it."""
        if self.count.get("head") and tag not in HEAD and not self.count.get("template") and not self.count.get("noscript") and (self.open[-1].tag == "head" or tag in BLOCK):
            self.cut(next(i for i, node in enumerate(self.open) if node.tag == "head"))

    def cut(self, i: int) -> None:
        for node in self.open[i:]:
            self.count[node.tag] -= 1
        del self.open[i:]

    def add(self, tag: str, attrs: dict) -> Node:
        node = Node(tag, attrs)
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1
        return node

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            return
        self.end_head(tag)
        self.imply_ends(tag)
        top = self.open[-1].tag
        if tag in ("td", "th") and top in ("table", "thead", "tbody", "tfoot"):
            self.add("tr", {})
        self.add(tag, dict(attrs))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes void elements only

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or tag in ("html", "body"):
            return
        if not self.count.get(tag):
            if tag == "p":
                self.handle_starttag("p", [])
                self.cut(len(self.open) - 1)
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self.cut(i)
                return
            if tag not in ("table", "td", "th", "tr") and self.open[i].tag in ("td", "th") and tag not in ("thead", "tbody", "tfoot"):
                return  # a cell keeps stray end tags to itself

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "style":
            self.styles.append(data)
        if self.open[-1].tag == "head" and data.strip():
            self.end_head()
        self.open[-1].kids.append(data)


def parsed(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    tree.close()
    decide_visibility(tree.root, style_rules("".join(tree.styles)))
    return tree.root


def style_rules(css: str) -> dict[str, list[tuple[str, str]]]:
    """Declarations that bear on visibility, by simple selector (name, .class, #id, or a name with one of these); others and at-rules are left out."""
    rules: dict[str, list[tuple[str, str]]] = {}
    for selectors, body in _RULE.findall(_AT_RULE.sub("", _COMMENT.sub("", css))):
        found = [(name, m[1].lower()) for name, pattern in (("display", _DISPLAY), ("visibility", _VISIBILITY)) if (m := pattern.search(body))]
        for selector in selectors.split(",") if found else ():
            if (m := _SIMPLE.match(selector)) and (m[1] or m[2]):
                rules.setdefault((m[1] or "").lower() + (m[2] or ""), []).extend(found)
    return rules


def decide_visibility(root: Node, rules: dict[str, list[tuple[str, str]]]) -> None:
    """Sets ``shown`` and ``visible`` of all elements: rules by name, class and id, then the element's own style; visibility is inherited."""
    stack = [(root, True)]
    while stack:
        node, visible = stack.pop()
        a, style = node.attrs, {}
        node.shown = not (node.tag in UNSEEN or node.tag in UNDRAWN or "hidden" in a or node.tag == "dialog" and "open" not in a)
        if rules:
            marks = ["", *(f".{c}" for c in (a.get("class") or "").split()), *([f"#{a['id']}"] if a.get("id") else [])]
            for mark in marks:
                style |= dict(rules.get(mark, ())) if mark else {}
                style |= dict(rules.get(node.tag + mark, ()))
        own = a.get("style") or ""
        style |= {name: m[1].lower() for name, pattern in (("display", _DISPLAY), ("visibility", _VISIBILITY)) if (m := pattern.search(own))}
        if style.get("display") == "none":
            node.shown = False
        node.visible = {"visible": True, "hidden": False, "collapse": False}.get(style.get("visibility", ""), visible)
        stack += [(kid, node.visible) for kid in node.kids if not isinstance(kid, str)]


class Page:
    """Lines being written: inline text joins the current line, blocks start new ones, and spaced blocks ask for an empty line."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False  # an empty line is due
        self.space = False  # a blank is due
        self.indent: list[str] = []
        self.mark = ""

    def word(self, text: str) -> None:
        parts = text.split()
        if not parts:
            self.space |= bool(text) and bool(self.now)
            return
        joined = " ".join(parts)
        if self.now and (self.space or text[0].isspace()):
            joined = " " + joined
        self.now.append(joined)
        self.space = text[-1].isspace()

    def verbatim(self, text: str) -> None:
        for i, line in enumerate(text.split("\n")):
            if i:
                self.end_line(keep_empty=True)
            if line:
                self.now.append(line)
        self.space = False

    def end_line(self, keep_empty: bool = False) -> None:
        if self.now or keep_empty:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            lead = "".join(self.indent)
            if self.mark:
                lead, self.mark = lead[: len(lead) - len(self.mark)] + self.mark, ""
            self.lines.append((lead + "".join(self.now)).rstrip())
        self.now, self.space = [], False

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


Render = Generator["Render", "str | list[str]", "str | list[str]"]


def run(render: Render):
    """The result of a render whose yields are renders it waits for; a stack stands in for recursion, so tables may be nested as deep as a page makes them."""
    waiting, value = [render], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(value))
            value = None
        except StopIteration as done:
            waiting.pop()
            value = done.value
    return value


def rendered(root: Node) -> Render:
    """Text of the visible part of a tree."""
    page, stack, lists, pre = Page(), [(root, False)], [], 0
    while stack:
        node, leaving = stack.pop()
        if isinstance(node, str):
            page.verbatim(node) if pre else page.word(node)
            continue
        tag = node.tag
        if leaving:
            page.end_line()
            page.gap |= tag in SPACED and not (tag in ("ul", "ol") and len(lists) > 1)
            if tag in ("ul", "ol", "menu"):
                lists.pop()
            elif tag in ("li", "dd", "blockquote"):
                page.indent.pop()
                page.mark = ""
            elif tag == "pre":
                pre -= 1
            continue
        if not node.shown:
            continue
        if tag == "br":
            page.end_line(keep_empty=True)
        elif tag == "hr":
            page.end_line()
            page.gap = True
        elif tag == "img":
            page.word(f" {node.attrs['alt']} ") if node.visible and node.attrs.get("alt") else None
        elif tag == "table":
            page.end_line()
            page.gap = True
            for line in (yield table_lines(node)):
                page.now = [line]
                page.end_line(keep_empty=True)
            page.gap = True
        elif tag in BLOCK:
            page.end_line()
            page.gap |= tag in SPACED and not (tag in ("ul", "ol") and lists)
            if tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start") or ""
                lists.append([tag == "ol", int(start) if start.lstrip("-").isdigit() and len(start) < 10 else 1])
            elif tag == "li":
                page.mark = BULLET
                if lists and lists[-1][0]:
                    page.mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                page.indent.append(" " * len(page.mark))
            elif tag in ("dd", "blockquote"):
                page.indent.append("    ")
            elif tag == "pre":
                pre += 1
            stack.append((node, True))
            stack += [(kid, False) for kid in reversed(node.contents)]
        else:
            if tag in ("button", "label", "option", "optgroup", "textarea", "select", "text"):
                page.space = bool(page.now)
            if tag in ("option", "optgroup", "textarea", "select", "text"):
                stack.append((" ", False))
            if tag == "optgroup" and node.visible and node.attrs.get("label"):
                page.word(f"{node.attrs['label']} ")
            stack += [(kid, False) for kid in reversed(node.contents)]
    return page.text()


def ancestors(top: Node, tags: tuple[str, ...]) -> set[int]:
    """Identities of the elements under ``top`` that hold an element of ``tags``, tables within it left out."""
    found, stack = set(), [(kid, (top, None)) for kid in top.kids]
    while stack:
        node, above = stack.pop()
        if isinstance(node, str):
            continue
        if node.tag in tags:
            while above and id(above[0]) not in found:
                found.add(id(above[0]))
                above = above[1]
        elif node.tag != "table":
            stack += [(kid, (node, above)) for kid in node.kids]
    return found


def parted(top: Node, tags: tuple[str, ...], groups: tuple[str, ...] = ()) -> tuple[list[Node], list[list[Node | str]]]:
    """The visible elements of ``tags`` under ``top``, reached through groups and whatever else holds them; and the runs of all other visible nodes between."""
    way, wanted, runs = ancestors(top, tags), [], [[]]
    stack: list[Node | str | None] = list(reversed(top.contents))
    while stack:
        kid = stack.pop()
        if kid is None:
            runs.append([])
        elif isinstance(kid, str):
            runs[-1].append(kid)
        elif kid.shown:
            if kid.tag in tags:
                wanted.append(kid)
                runs.append([])
            elif kid.tag in groups or id(kid) in way:
                runs.append([])
                stack += [None, *reversed(kid.contents)]
            elif kid.tag == "caption":
                runs += [[kid], []]
            else:
                runs[-1].append(kid)
    return wanted, runs


def whole(value: str | None, most: int) -> int:
    """A span as browsers read it: 1 if it is no positive number, and no more than ``most``."""
    return min(int(value[:9]), most) if value and value.isascii() and value.isdecimal() and int(value[:9]) > 0 else 1


def table_lines(table: Node) -> Render:
    """A table's caption and all text outside its cells, then its rows with cells padded to their columns' widths; cells of several lines keep them.

    Columns in which no cell starts take no room, however wide the cells across them.
    """
    table_rows, runs = parted(table, ("tr",), ("thead", "tbody", "tfoot"))
    rows = [parted(row, ("td", "th")) for row in table_rows]
    out = []
    for strays in [*runs, *(x for _, in_row in rows for x in in_row)]:
        if text := (yield rendered_inside(strays)):
            out += text.split("\n")
    grid, down = [], {}
    for row, _ in rows:
        cells, at = {}, 0
        for cell in row:
            while down.get(at, 0):
                down[at] -= 1
                at += 1
            cells[at] = (yield rendered_inside(cell.contents)).split("\n")
            across, deep = whole(cell.attrs.get("colspan"), MOST_COLUMNS), whole(cell.attrs.get("rowspan"), MOST_ROWS)
            for c in range(at, at + across):
                if deep > 1:
                    down[c] = deep - 1
            at += across
        for c in [c for c in down if c >= at and down[c]]:
            down[c] -= 1
        if any(any(x) for x in cells.values()):
            grid.append(cells)
    columns = sorted({c for cells in grid for c in cells})
    widths = [max((len(x) for cells in grid for x in cells.get(c, [""])), default=0) for c in columns]
    for cells in grid:
        for i in range(max(len(x) for x in cells.values())):
            line = [(cells[c][i] if c in cells and i < len(cells[c]) else "").ljust(w) for c, w in zip(columns, widths)]
            out.append(" | ".join(line).rstrip())
    return out


def rendered_inside(kids: list) -> Render:
    holder = Node("div", {})
    holder.kids = kids
    return rendered(holder)


def html_to_text(html: str | None) -> str:
    return run(rendered(parsed(html))) if html else ""


def text_column():
    """Column function HTML -> visible text; null gives the empty text."""

    @F.pandas_udf("string")
    def render(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in parts:
            yield pd.Series([html_to_text(p) for p in pages], dtype=object)

    return render


def extract_text(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the visible text in ``into`` (replacing a column of that name).

    Null and empty pages have the empty text; pages of any length and nesting
    are rendered whole.  Rows are independent: repeated rows, ties and empty
    tables need no rule; other columns pass through, null or not.
    """
    return pages.withColumn(into, text_column()(F.col(html)))


def digest_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, the visible text and its lines, words and SHA-256, of every page."""
    out = extract_text(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long").alias("n_words"), F.sha2("text", 256).alias("text_sha256"))
