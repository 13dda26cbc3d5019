"""Text of chosen HTML elements, as one vectorised function over pages."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Mapping
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Fixed values of the HTML standard: elements without content, and elements that start a block.
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre "
    "section table tbody td tfoot th thead title tr ul".split()
)
# Fixed values of the HTML standard: an opening tag ends an open element of these kinds,
# unless one of the stated containers lies between.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
}
# Letters, digits and hyphens have no named character reference, only numbered ones.
PLAIN_CLASS = re.compile(r"[a-z0-9-]*")


class Markup(HTMLParser):
    """A reader of whole pages that takes any markup as it comes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)

    def updatepos(self, i, j):
        return j  # line numbers are of no use here

    def parse_marked_section(self, i, report=1):
        # CDATA holds text, any other marked section is a comment
        if not self.rawdata.startswith("<![CDATA[", i):
            return self.parse_bogus_comment(i)
        end = self.rawdata.find("]]>", i)
        self.handle_data(self.rawdata[i + 9 : end if end >= 0 else None])
        return end + 3 if end >= 0 else len(self.rawdata)

    # A page is fed whole, so markup without an end lasts to the end of the page.  Taken up
    # again behind its first character, it would be searched once per such character.

    def parse_comment(self, i, report=1):
        return self._or_all(super().parse_comment(i, report))

    def parse_bogus_comment(self, i, report=1):
        return self._or_all(super().parse_bogus_comment(i, report))

    def parse_pi(self, i):
        return self._or_all(super().parse_pi(i))

    def parse_html_declaration(self, i):
        return self._or_all(super().parse_html_declaration(i))

    def parse_starttag(self, i):
        return self._or_all(super().parse_starttag(i))

    def parse_endtag(self, i):
        return self._or_all(super().parse_endtag(i))

    def _or_all(self, end):
        return end if end >= 0 else len(self.rawdata)


class _Selector(Markup):
    """Collects the text of every element whose tag and whole class attribute match."""

    def __init__(self, wanted: Mapping[str, tuple[str, str]]):
        super().__init__()
        self.wanted = wanted
        self.stack: list[tuple[str, int]] = []  # open tags, each with the texts it opened
        self.places: dict[str, list[int]] = defaultdict(list)  # stack positions by tag
        self.open: list[list[str]] = []
        self.found: dict[str, list[list[str]]] = {name: [] for name in wanted}

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self._end_implied({"p"}, {"table", "button", "object"})
        if tag in IMPLIED_ENDS:
            self._end_implied(*IMPLIED_ENDS[tag])
        if tag in BLOCK_TAGS or tag == "br":
            self._add(" ")
        opened = 0
        for name in self._names(tag, attrs):
            pieces: list[str] = []
            self.found[name].append(pieces)
            self.open.append(pieces)
            opened += 1
        if tag not in VOID_TAGS:
            self.places[tag].append(len(self.stack))
            self.stack.append((tag, opened))
        elif opened:
            del self.open[-opened:]

    def _names(self, tag, attrs):
        """Names of the selectors that the element matches."""
        value = next((v for k, v in attrs if k == "class"), None)
        if value is None:
            return []
        value = value.strip().lower()
        return [n for n, (wanted_tag, wanted_class) in self.wanted.items() if tag == wanted_tag and value == wanted_class]

    def handle_startendtag(self, tag, attrs):
        # the slash means nothing on HTML elements that have content
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        depth = self._last({tag})
        if depth >= 0:
            self._close(depth)

    def handle_data(self, data):
        if self.open and self.stack[-1][0] not in ("script", "style"):
            self._add(data)

    def _add(self, data):
        for pieces in self.open:
            pieces.append(data)

    def _last(self, tags):
        return max((self.places[tag][-1] for tag in tags if self.places[tag]), default=-1)

    def _close(self, depth):
        while len(self.stack) > depth:
            tag, opened = self.stack.pop()
            self.places[tag].pop()
            if opened:
                del self.open[-opened:]

    def _end_implied(self, kinds, containers):
        depth = self._last(kinds)
        if depth > self._last(containers):
            self._close(depth)


def select_page(html: str, wanted: Mapping[str, tuple[str, str]]) -> dict[str, list[str]]:
    """Normalised texts of the wanted elements of one page, in document order."""
    classes = [cls for _, cls in wanted.values()]
    lowered = html.lower()
    encoded = "&#" if all(PLAIN_CLASS.fullmatch(c) for c in classes) else "&"
    if encoded not in html and not any(c in lowered for c in classes):
        return {name: [] for name in wanted}
    parser = _Selector(wanted)
    parser.feed(html)
    parser.close()
    return {
        name: [" ".join("".join(pieces).split()) for pieces in elements]
        for name, elements in parser.found.items()
    }


def select_texts(html: Column, wanted: Mapping[str, tuple[str, str]]) -> Column:
    """Struct of text arrays, one per named (tag, class) selector; a page is parsed once.

    The class attribute must equal the value as a whole, in any letter case.  The arrays
    are null for a null page and for one that cannot be parsed.
    """
    chosen = {name: (tag.lower(), cls.strip().lower()) for name, (tag, cls) in wanted.items()}
    fields = [StructField(name, ArrayType(StringType())) for name in chosen]

    nothing = dict.fromkeys(chosen)

    def select_or_nothing(page):
        try:
            return nothing if page is None else select_page(page, chosen)
        except Exception:  # one page that cannot be parsed must not end the job
            return nothing

    def select_batch(pages: pd.Series) -> pd.DataFrame:
        rows = [select_or_nothing(page) for page in pages]
        return pd.DataFrame(rows, columns=list(chosen), dtype=object)

    # non-deterministic only in name: it keeps a filter on the result from running it twice
    parsed = F.pandas_udf(select_batch, StructType(fields)).asNondeterministic()
    # a page without the class and without characters that could spell it is not for Python:
    # it goes there as an empty one, which has the same elements, namely none
    plain = all(PLAIN_CLASS.fullmatch(c) for _, c in chosen.values())
    lowered = F.lower(html)
    may_hold = F.contains(html, F.lit("&#" if plain else "&"))
    for cls in sorted({c for _, c in chosen.values()}):
        may_hold = may_hold | F.contains(lowered, F.lit(cls))
    return parsed(F.when(may_hold, html).when(html.isNotNull(), F.lit("")))


def select_text(html: Column, tag: str, cls: str) -> Column:
    """Texts of all elements with that tag and class."""
    return select_texts(html, {"texts": (tag, cls)})["texts"]


def joined(texts: Column) -> Column:
    """Element texts joined by one space; empty if there are none."""
    return F.ltrim(F.array_join(F.coalesce(texts, F.array().cast("array<string>")), " "))
