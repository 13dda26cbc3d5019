"""Normalised HTML: a page's tree as browsers complete it, written out again.

Implied ``html``, ``head`` and ``body`` are added, elements that a new one ends are closed, cells get their rows and
table bodies, formatting that a block cut off is taken up again behind it, attribute values are
quoted and characters escaped.  What is normalised stays as it is when normalised again.
"""

from __future__ import annotations

from html import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleaner.functions.html import BLOCK_TAGS, IMPLIED_ENDS, VOID_TAGS, Markup

# Fixed values of the HTML standard: what may stand in the head, what formats text, what holds raw
# text, and what formatting does not reach across.
HEAD_TAGS = frozenset("base link meta noscript script style template title".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
RAW_TAGS = frozenset("iframe noembed noframes plaintext script style xmp".split())
BARRIERS = frozenset("applet button caption marquee object td template th".split())
TABLE_PARTS = frozenset("tbody tfoot thead".split())
#: Like formatting elements that are taken up again at most, and all of them; browsers stop there as well.
MOST_ALIKE, MOST_ACTIVE, MOST_OPEN = 3, 32, 512


class _Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs=()):
        self.tag, self.children = tag, []
        self.attrs: dict[str, str] = {}
        self.add(attrs)

    def add(self, attrs) -> None:
        for name, value in attrs:
            if not any(c in name for c in "\"'<>=/ \t\n\r\f"):
                self.attrs.setdefault(name, value or "")


class _Tree(Markup):
    def __init__(self):
        super().__init__()
        self.doctype, self.before = "", []
        self.html, self.head, self.body = _Node("html"), _Node("head"), _Node("body")
        self.stack: list[_Node] = [self.head]
        self.active: list[_Node | None] = []  # formatting to take up again; None where it stops

    @property
    def in_head(self) -> bool:
        return self.stack[0] is self.head

    def _start_body(self):
        if self.in_head:
            self.stack, self.active = [self.body], []

    def handle_decl(self, decl):
        if decl.lower().startswith("doctype") and not self.doctype and self.in_head and not self.head.children:
            self.doctype = "<!DOCTYPE" + decl[7:] + ">"

    def handle_comment(self, data):
        data = data.replace("--", "- -").replace(">", "&gt;")
        at_start = self.in_head and len(self.stack) == 1 and not self.head.children
        (self.before if at_start else self.stack[-1].children).append(_Comment(data))

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "head", "body"):
            if tag == "body":
                self._start_body()
            {"html": self.html, "head": self.head, "body": self.body}[tag].add(attrs)
            return
        if self.in_head and (tag not in HEAD_TAGS or len(self.stack) > 1):
            self._start_body()
        if not self.in_head:
            self._make_room(tag)
        node = _Node(tag, attrs)
        self.stack[-1].children.append(node)
        if tag in VOID_TAGS or len(self.stack) >= MOST_OPEN:
            return
        self.stack.append(node)
        if tag in BARRIERS:
            self.active.append(None)
        elif tag in FORMATTING and not self.in_head:
            self._activate(node)

    def _activate(self, node):
        alike = [n for n in self._reachable() if n.tag == node.tag and n.attrs == node.attrs]
        if len(alike) >= MOST_ALIKE or len(self._reachable()) >= MOST_ACTIVE:
            self.active.remove(alike[0] if len(alike) >= MOST_ALIKE else self._reachable()[0])
        self.active.append(node)

    def _reachable(self):
        """Active formatting since the last barrier, oldest first."""
        start = max((k + 1 for k, n in enumerate(self.active) if n is None), default=0)
        return self.active[start:]

    def _make_room(self, tag):
        if tag in BLOCK_TAGS:
            self._end({"p"}, BARRIERS | {"table"})
        if tag in IMPLIED_ENDS:
            kinds, containers = IMPLIED_ENDS[tag]
            self._end(kinds, containers | ({"table"} if tag == "tr" else set()))
        if tag == "tr":
            self._end({"td", "th", "tr"}, {"table"} | TABLE_PARTS)
        if tag in TABLE_PARTS:
            self._end(TABLE_PARTS, {"table"})
        if tag in ("td", "th", "tr") and self.stack[-1].tag == "table":
            self._push("tbody")
        if tag in ("td", "th") and self.stack[-1].tag in TABLE_PARTS:
            self._push("tr")
        if tag == "a":  # links do not hold links
            for open_link in [n for n in self._reachable() if n.tag == "a"]:
                self._end_formatting(open_link)
        if tag not in BLOCK_TAGS:
            self._take_up()

    def _push(self, tag):
        node = _Node(tag)
        self.stack[-1].children.append(node)
        self.stack.append(node)

    def _take_up(self):
        """Open active formatting again that a block has closed."""
        if self.stack[-1].tag in ("table", "tr") or self.stack[-1].tag in TABLE_PARTS:
            return
        for old in self._reachable():
            if old not in self.stack and len(self.stack) < MOST_OPEN:
                node = _Node(old.tag, old.attrs.items())
                self.active[self.active.index(old)] = node
                self.stack[-1].children.append(node)
                self.stack.append(node)

    def _end(self, kinds, containers):
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag in kinds:
                self._close(depth)
                return
            if self.stack[depth].tag in containers:
                return

    def _close(self, depth):
        while len(self.stack) > depth:
            if self.stack.pop().tag in BARRIERS:
                while self.active and self.active.pop() is not None:
                    pass

    def _end_formatting(self, node):
        if node in self.active:
            self.active.remove(node)
        if node in self.stack:
            self._close(self.stack.index(node))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("html", "head", "body"):
            return
        if tag in FORMATTING:
            found = [n for n in self._reachable() if n.tag == tag]
            if found:
                self._end_formatting(found[-1])
                return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag == tag:
                self._close(depth)
                return
            if self.stack[depth].tag in BARRIERS and tag not in ("table", "tr") and tag not in TABLE_PARTS:
                break
        if tag in ("p", "br"):  # these stand for an empty element
            self.handle_starttag(tag, [])
            if tag == "p":
                self.handle_endtag(tag)

    def handle_data(self, data):
        if self.in_head and len(self.stack) == 1:
            if not data.strip():
                return
            self._start_body()
        if not self.in_head and self.stack[-1].tag not in RAW_TAGS:
            if not self.body.children and not data.strip():
                return
            self._take_up()
        children = self.stack[-1].children
        if children and isinstance(children[-1], str):
            children[-1] += data
        else:
            children.append(data)


class _Comment:
    __slots__ = ("data",)

    def __init__(self, data: str):
        self.data = data


def _written(tree: _Tree) -> str:
    tree.html.children = [tree.head, tree.body]
    out = [tree.doctype]
    todo: list = [tree.html, *reversed(tree.before)]
    raw = 0
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):
            out.append(f"</{node[0]}>")
            raw -= node[0] in RAW_TAGS
        elif isinstance(node, str):
            out.append(node if raw else escape(node, quote=False).replace("\xa0", "&nbsp;"))
        elif isinstance(node, _Comment):
            out.append(f"<!--{node.data}-->")
        else:
            attrs = "".join(f' {k}="{escape(v, quote=False).replace(chr(34), "&quot;")}"' for k, v in node.attrs.items())
            out.append(f"<{node.tag}{attrs}>")
            if node.tag not in VOID_TAGS:
                raw += node.tag in RAW_TAGS
                todo.append((node.tag,))
                todo += reversed(node.children)
    return "".join(out)


def normalised(html: str) -> str:
    """One page, normalised."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return _written(tree)


@F.pandas_udf(StringType())
def _normalise(pages: pd.Series) -> pd.Series:
    def one(page):
        try:
            return None if page is None else normalised(page)
        except Exception:  # one page that cannot be parsed must not end the job
            return None

    return pd.Series([one(page) for page in pages], dtype=object)


def normalised_html(html: Column) -> Column:
    """Normalised HTML of a column of pages; null for a null page and for one that cannot be parsed."""
    return _normalise(html)
