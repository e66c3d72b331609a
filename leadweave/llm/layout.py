"""Visible text of HTML pages with its layout: block spacing, lists, preformatted text and aligned tables.

A tree is built from the tags, with the end tags and parents that HTML implies. A walk over it leaves out what a
browser doesn't show and writes all other text. Nothing is recursive, so that nesting may be of any depth.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.llm.words import chunks

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Raw elements without character references, and elements whose white space is kept.
VERBATIM = frozenset("xmp plaintext".split())
KEPT = frozenset("pre xmp plaintext listing".split())
HIDDEN = frozenset("head script style template title iframe noembed noframes datalist audio video canvas object desc defs symbol metadata annotation annotation-xml".split())
BLOCKS = {
    **dict.fromkeys("p h1 h2 h3 h4 h5 h6 ul ol dl pre xmp plaintext listing blockquote table figure fieldset".split(), 2),
    **dict.fromkeys("div section article main header footer nav aside address form li dt dd tr caption details summary figcaption body html hr legend menu option optgroup text".split(), 1),
}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p plaintext pre listing xmp section table ul".split())
#: Elements within which the end tag of an element around them has no effect, unless that is one of them.
SPECIAL = frozenset(BLOCKS) - {"option", "optgroup", "text", "legend"} | frozenset("td th tbody thead tfoot head template object applet marquee button select noscript".split())
#: Formatting elements, which end within a block that they have been opened around.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: What may stand in a head; any other start tag, and text, end it.
IN_HEAD = frozenset("title meta link base basefont bgsound style script noscript noframes template".split())
IN_NOSCRIPT = frozenset("basefont bgsound link meta noframes style".split())
#: Open elements that a start tag ends, and the elements beyond which it ends none.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    **{t: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
}

#: A quote opens a value only after an equals sign; what has no end runs to the page's end.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+>?|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?)*+)(?P<close>>?)|(?P<text>[^<]++|<)""",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_NO_BOX = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


#: Levels of lists and quotes that are indented, and of tables that are aligned; deeper ones stand below those.
INDENTS, TABLES = 16, 8
#: Characters up to which a cell counts for its column's width, and the widest table that is aligned.
WIDE_CELL, WIDE_TABLE = 60, 400


class Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: str = ""):
        self.name, self.attrs, self.children = name, attrs, []


def build_tree(html: str) -> Node:
    """The element tree; children are nodes and strings. Takes time in proportion to the page, at any depth."""
    root = Node("")
    stack = [root]
    where: dict[str, list[int]] = defaultdict(list)  # places of the open elements of each name
    special: list[int] = []  # places of the open special elements

    def top(names) -> int:
        return max((where[n][-1] for n in names if where[n]), default=0)

    def cut(k: int) -> None:
        for node in stack[k:]:
            where[node.name].pop()
        while special and special[-1] >= k:
            special.pop()
        del stack[k:]

    def close(names, stop) -> bool:
        """Ends the innermost open element of the names, unless one of `stop` lies within it."""
        k = top(names)
        if k and k >= top(stop):
            cut(k)
            return True
        return False

    def put(node: Node) -> None:
        where[node.name].append(len(stack))
        if node.name in SPECIAL:
            special.append(len(stack))
        stack.append(node)

    def in_head() -> int:
        """The place of the head that is open, with nothing or a noscript within it; else 0."""
        k = len(stack) - 1
        return k if stack[k].name == "head" else k - 1 if stack[k].name == "noscript" and stack[k - 1].name == "head" else 0

    at = 0
    while m := _TOKEN.match(html, at):
        at = m.end()
        if (text := m["text"]) is not None:
            if (k := in_head()) and unescape(text).strip(" \t\n\r\f"):
                cut(k)
            stack[-1].children.append(text)
            continue
        if m["name"] is None:
            continue
        if not m["close"]:  # the page ends within a tag
            break
        name = m["name"].lower()
        if m["end"]:
            if name == "br" or name == "p" and not where["p"]:
                stack[-1].children.append(Node(name))
            elif name not in SPECIAL and where[name] and special and special[-1] > where[name][-1] and not (name in FORMATTING and hides(stack[where[name][-1]])):
                pass  # the block goes on; formatting that hides nothing may go on within it, too
            else:
                close({name}, {"td", "th", "table"} - {name} if name not in ("tr", "tbody", "thead", "tfoot", "table", "body", "html") else ())
            continue
        if (k := in_head()) and name not in (IN_HEAD if k == len(stack) - 1 else IN_NOSCRIPT):
            if name in ("head", "html"):  # repeated, without effect
                continue
            cut(k)
        if name in CLOSES_P:
            close({"p"}, {"td", "th", "table", "li", "button"})
        if name in IMPLIED_END:
            while close(*IMPLIED_END[name]):
                pass
        if name in ("td", "th") and stack[-1].name != "tr":
            row = Node("tr")
            stack[-1].children.append(row)
            put(row)
        if name == "body":
            close({"head"}, ())
        node = Node(name, m["attrs"] or "")
        stack[-1].children.append(node)
        if name == "plaintext":  # nothing ends it
            node.children.append(html[at:].replace("&", "&amp;"))
            break
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            inner = html[at : end.start() if end else len(html)]
            node.children.append(inner.replace("&", "&amp;") if name in VERBATIM else inner)
            at = end.end() if end else len(html)
        elif name not in VOID and not (m["attrs"] or "").endswith("/"):
            put(node)
    return root


def attributes(node: Node) -> dict[str, str]:
    """The element's attributes, names in lower case; the first of a name counts."""
    out: dict[str, str] = {}
    for k, v in _ATTR.findall(node.attrs) if node.attrs else ():
        out.setdefault(k.lower(), unescape(v[1:-1] if v[:1] in ("'", '"') and v[-1:] == v[:1] else v))
    return out


def has_box(node: Node, attrs: dict[str, str]) -> bool:
    """Whether a browser lays the element out: not by its kind, the hidden attribute, or its own style."""
    if node.name in HIDDEN or node.name == "input":
        return False
    if "hidden" in attrs or node.name == "dialog" and "open" not in attrs:
        return False
    return not _NO_BOX.search(attrs.get("style", ""))


def visibility(attrs: dict[str, str], outer: bool) -> bool:
    """Whether text directly in the element shows: by its own style, or as in the element around it."""
    found = _VISIBILITY.findall(attrs.get("style", ""))
    return found[-1].lower() == "visible" if found else outer


def hides(node: Node) -> bool:
    """Whether the element's own attributes have to do with what shows."""
    attrs = attributes(node)
    return not has_box(node, attrs) or bool(_VISIBILITY.search(attrs.get("style", "")))


def _span(attrs: dict[str, str], name: str, most: int) -> int:
    digits = re.match(r"\s*([0-9]{1,6})", attrs.get(name, ""))
    return min(max(int(digits[1]), 1), most) if digits else 1


class _Page:
    """Lines being written, and how many line breaks the next text has to have before it."""

    def __init__(self):
        self.out, self.breaks, self.space, self.mark, self.indents = [], 0, False, "", []

    def indent(self) -> str:
        return "".join(self.indents[:INDENTS])

    def block(self, breaks: int) -> None:
        self.breaks, self.space = max(self.breaks, breaks), False

    def put(self, text: str, kept: bool = False) -> None:
        if not kept:
            words = _SPACE.sub(" ", text)
            if words == " " or not words:
                self.space = self.space or bool(words)
                return
            lead, text, tail = words[0] == " ", words.strip(" "), words[-1] == " "
        else:
            lead = tail = False
        pad = self.indent()
        if self.breaks or not self.out:
            if self.out:
                self.out.append("\n" * self.breaks)
            if self.mark and len(self.indents):
                self.out.append("".join(self.indents[: min(len(self.indents), INDENTS) - 1]) + self.mark)
            else:
                self.out.append(pad)
            self.mark = ""
        elif self.space or lead:
            self.out.append(" ")
        self.out.append(text.replace("\n", "\n" + pad) if kept else text)
        self.breaks, self.space = 0, tail

    def text(self) -> str:
        return "".join(self.out)


class _Table:
    """A table being read: rows of (column, columns spanned, text), and the columns that longer cells still hold."""

    def __init__(self):
        self.rows, self.held, self.at = [], {}, 0

    def row(self) -> None:
        self.held = {k: n - 1 for k, n in self.held.items() if n > 1}
        self.rows.append([])
        self.at = 0

    def cell(self, text: str, columns: int, rows: int) -> None:
        while self.at in self.held:
            self.at += 1
        text = " ".join(text.split())
        if text:
            self.rows[-1].append((self.at, columns, text))
        if rows > 1:
            self.held |= dict.fromkeys(range(self.at, self.at + columns), rows)
        self.at += columns

    def text(self) -> str:
        """Each column as wide as its widest cell, two spaces between; cells of several columns may widen their last one."""
        width: dict[int, int] = {}
        for row in self.rows:
            for k, n, text in row:
                width[k] = max(width.get(k, 0), len(text) if n == 1 and len(text) <= WIDE_CELL else 1)
        aligned = 3 * len(width) <= WIDE_TABLE
        if aligned:
            for k, n, text in (cell for row in self.rows for cell in row if cell[1] > 1):
                under = [c for c in width if k <= c < k + n]
                width[max(under)] += max(min(len(text), WIDE_CELL) + 2 - sum(width[c] + 2 for c in under), 0)
        starts, total = {}, 0
        for k in sorted(width):
            starts[k], total = total, total + width[k] + 2
        aligned = aligned and total <= WIDE_TABLE
        lines = []
        for row in filter(None, self.rows):
            line = ""
            for k, _, text in row:
                if aligned:
                    line = line.ljust(starts[k])
                line += ("  " if line and not line.endswith("  ") else "") + text
            lines.append(line)
        return "\n".join(lines)


def render(html: str | None) -> str:
    """All visible text of a page in the order of the page; null is empty.

    Visible is what a browser would show without scripts and style sheets, once details and lists of options are opened:
    so noscript shows, and so do the texts of drawings and formulas, but for their descriptions. Columns are told
    apart by spans of cells and rows; the text of a cell stands on one line. Lists and quotes are indented to a depth
    of INDENTS, tables aligned to a depth of TABLES and a width of WIDE_TABLE, so that neither work nor output grows
    with the square of a page; text beyond them is written all the same.
    """
    pages, tables, lists, kept, flat, seen = [_Page()], [], [], 0, 0, [True]
    todo: list[tuple] = [("go", build_tree(html or ""), True)]
    while todo:
        act, node, more = todo.pop()
        page = pages[-1]
        if isinstance(node, str):
            if node and seen[-1]:
                text = unescape(node).replace("\r\n", "\n")
                page.put(text.strip("\n") if kept else text, bool(kept) and bool(text.strip("\n")))
            continue
        name = node.name
        if act == "go":
            attrs = attributes(node)
            if not has_box(node, attrs):
                continue
            if name == "br":
                page.breaks, page.space = page.breaks + 1, False
                continue
            if name in BLOCKS:  # a list within a list has no blank lines around it
                page.block(1 if name in ("ul", "ol") and lists else BLOCKS[name])
            end = None
            seen.append(visibility(attrs, seen[-1]))
            if name == "hr":
                if seen[-1]:
                    page.put("---")
            elif name in ("ul", "ol", "menu"):
                lists.append(0 if name == "ol" else None)
            elif name == "li":
                if lists and lists[-1] is not None:
                    lists[-1] += 1
                page.mark = f"{lists[-1]}. " if lists and lists[-1] is not None else "- "
                page.indents.append(" " * len(page.mark))
            elif name in ("dd", "blockquote"):
                page.indents.append("  ")
            elif name in KEPT:
                kept += 1
            elif name == "table":
                if len(tables) < TABLES:
                    tables.append(_Table())
                    end = "table"
                else:
                    flat += 1
                    end = "flat"
            elif name == "tr" and tables and not flat:
                tables[-1].row()
            elif name in ("td", "th"):
                if tables and tables[-1].rows and not flat:
                    pages.append(_Page())
                    end = (_span(attrs, "colspan", 1000), _span(attrs, "rowspan", 65534))
                else:
                    page.space = True
            todo.append(("end", node, end))
            todo.extend(("go", c, None) for c in reversed(node.children))
        else:
            seen.pop()
            if name in ("ul", "ol", "menu"):
                lists.pop()
            elif name == "li" or name in ("dd", "blockquote"):
                page.indents.pop()
                page.mark = ""
            elif name in KEPT:
                kept -= 1
            elif isinstance(more, tuple):
                tables[-1].cell(pages.pop().text(), *more)
                continue
            elif more == "flat":
                flat -= 1
            elif more == "table":
                if body := tables.pop().text():
                    page.block(2)
                    page.put(body, True)
            if name in BLOCKS:
                page.block(1 if name in ("ul", "ol") and lists else BLOCKS[name])
    return pages[0].text()


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, text: one row for each row of `pages` (page_id, html); whole pages, null or empty html gives empty text.

    Repeated and null ids stay rows of their own; columns other than these two are not read, whatever their names.
    Very long and very deep pages take time in proportion to their size. An empty table gives an empty one.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in chunks(batches, "html"):
            texts = [render(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], names=["page_id", "text"])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, text string")


def op6_layout(spark, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    found = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
