"""Text of elements chosen by compiled selectors.

A selector is a list, parted by commas, of steps such as ``tag``, ``.class``, ``#id``, ``[a]``, ``[a=v]``, ``[a~=v]`` and
their combinations, joined by a blank (below) or ``>`` (right below).  All selectors of a call become one state
machine: a bit each step, carried along the stack of open elements, so that a page is read
once and an element costs the same wherever it stands.  Names and values match in any letter case.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from gleaner.functions.html import _Selector

NAME = r"[A-Za-z_][\w-]*"
VALUE = r"\"[^\"]*\"|'[^']*'|[\w-]+"
PART = re.compile(rf"\#(?P<id>{NAME})|\.(?P<cls>{NAME})|\[\s*(?P<attr>{NAME})\s*(?:(?P<how>~?=)\s*(?P<value>{VALUE})\s*)?\]")
STEP = re.compile(rf"(?P<tag>{NAME}|\*)?(?P<parts>(?:{re.sub(r'\?P<[a-z]+>', '', PART.pattern)})*)")

Test = Callable[[dict], bool]


class Step(NamedTuple):
    tag: str  # empty for any
    tests: list[Test]
    child: bool  # right below the step before, not anywhere below

    def fits(self, tag: str, attrs: dict) -> bool:
        return self.tag in ("", tag) and all(test(attrs) for test in self.tests)


def _test(part: re.Match) -> Test:
    name, value = part["attr"], part["value"]
    if part["id"]:
        name, how, value = "id", "=", part["id"]
    elif part["cls"]:
        name, how, value = "class", "~=", part["cls"]
    else:
        how = part["how"]
        value = value[1:-1] if value and value[0] in "\"'" else value
    name = name.lower()
    if how is None:
        return lambda attrs: name in attrs
    value = value.lower()
    if how == "=":
        return lambda attrs: attrs.get(name, "").strip() == value and name in attrs
    return lambda attrs: value in attrs.get(name, "").split()


def compiled(selector: str) -> list[list[Step]]:
    """The chains of steps of a selector; one that is not understood raises ValueError."""
    chains = []
    for text in re.split(r",(?![^\[]*\])", selector):
        chain, child, at, text = [], False, 0, text.strip()
        while at < len(text):
            step = STEP.match(text, at)
            if not step or step.end() == at:
                raise ValueError(f"selector not understood: {selector!r}")
            tag = (step["tag"] or "*").lower()
            chain.append(Step("" if tag == "*" else tag, [_test(m) for m in PART.finditer(step["parts"])], child))
            joint = re.compile(r"\s*(>)\s*|\s+|$").match(text, step.end())
            if not joint or (joint[1] and joint.end() == len(text)):
                raise ValueError(f"selector not understood: {selector!r}")
            child, at = bool(joint[1]), joint.end()
        if not chain:
            raise ValueError(f"selector not understood: {selector!r}")
        chains.append(chain)
    return chains


class _Machine(_Selector):
    """Bits of the steps that end at each open element, and of those that end at or above it."""

    def __init__(self, steps: list[Step], firsts: int, names: dict[int, list[str]], wanted: list[str]):
        super().__init__(dict.fromkeys(wanted))
        self.steps, self.firsts, self.last_bits = steps, firsts, names
        self.masks: list[tuple[int, int]] = []

    def _names(self, tag, attrs):
        del self.masks[len(self.stack):]  # elements that have ended, or never had content
        parent, above = self.masks[-1] if self.masks else (0, 0)
        values = {}
        for k, v in attrs:
            values.setdefault(k, (v or "").lower())
        here = 0
        for k, step in enumerate(self.steps):
            bit = 1 << k
            reached = bit & self.firsts or (bit >> 1) & (parent if step.child else above)
            if reached and step.fits(tag, values):
                here |= bit
        self.masks.append((here, above | here))
        found = dict.fromkeys(n for bit, names in self.last_bits.items() if here & bit for n in names)
        return list(found)


def css_page(html: str, selectors: Mapping[str, list[list[Step]]]) -> dict[str, list[str]]:
    """Normalised texts of the chosen elements of one page, in document order."""
    steps, firsts, names = [], 0, {}
    for name, chains in selectors.items():
        for chain in chains:
            firsts |= 1 << len(steps)
            steps += chain
            names.setdefault(1 << (len(steps) - 1), []).append(name)
    machine = _Machine(steps, firsts, names, list(selectors))
    machine.feed(html)
    machine.close()
    return {n: [" ".join("".join(p).split()) for p in elements] for n, elements in machine.found.items()}


def css_texts(html: Column, selectors: Mapping[str, str]) -> Column:
    """Struct of text arrays, one per named selector; a page is parsed once for all.

    The arrays are null for a null page and for one that cannot be parsed.
    """
    chosen = {name: compiled(selector) for name, selector in selectors.items()}
    fields = [StructField(name, ArrayType(StringType())) for name in selectors]
    nothing = dict.fromkeys(selectors)

    def select(page):
        try:
            return nothing if page is None else css_page(page, chosen)
        except Exception:  # one page that cannot be parsed must not end the job
            return nothing

    def select_batch(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([select(page) for page in pages], columns=list(chosen), dtype=object)

    return F.pandas_udf(select_batch, StructType(fields)).asNondeterministic()(html)
