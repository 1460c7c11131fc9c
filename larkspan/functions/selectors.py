"""Element selectors over pages (F3, S7, S8): all fields of a page in one streaming pass, without a document tree.

A selector is a list of compounds (tag, #id, .class, [attribute], with = ~= ^= $= *= |=, values quoted or not) joined by blanks (inside), > (child), + (next
element) or ~ (later element of one parent); commas separate alternatives. While the page is read, every open element knows which prefixes of the
selectors end at it, as the bits of one number, and which end at elements around it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Elements without content, and those that the start of another one ends (up to the elements that hold them).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("ul ol dl table thead tbody tfoot select".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_COMPOUND = re.compile(r"""\s*([>+~])?\s*((?:\*|[A-Za-z][\w-]*)?(?:[#.][\w-]+|\[\s*[\w:-]+\s*(?:[~^$*|]?=\s*(?:"[^"]*"|'[^']*'|[^\]\s]+)\s*)?\])*)""")
_PART = re.compile(r"""([#.])([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*|]?=)\s*("[^"]*"|'[^']*'|[^\]\s]+)\s*)?\]""")
_TESTS = {
    "=": lambda has, want: has == want,
    "~=": lambda has, want: bool(want) and want in has.split(),
    "^=": lambda has, want: bool(want) and has.startswith(want),
    "$=": lambda has, want: bool(want) and has.endswith(want),
    "*=": lambda has, want: bool(want) and want in has,
    "|=": lambda has, want: has == want or has.startswith(want + "-"),
    "has": lambda has, want: has == want or want in has.split(),
    None: lambda has, want: True,
}


@dataclass(frozen=True)
class Step:
    """How a compound follows the one before (None: it is the first), its tag, and its tests (attribute, operator, value)."""

    after: str | None
    tag: str | None
    tests: tuple

    def fits(self, tag: str, attributes: dict[str, str]) -> bool:
        return (self.tag is None or self.tag == tag) and all(a in attributes and _TESTS[op](attributes[a], v) for a, op, v in self.tests)


def compiled(selector: str | tuple) -> list[list[Step]]:
    """The alternatives of a selector. A tuple is (tag, attribute, value), each may be None; the value is the attribute's or one of its words."""
    if not isinstance(selector, str):
        tag, attribute, value = selector
        return [[Step(None, tag, () if attribute is None else ((attribute, None if value is None else "has", value),))]]
    out = []
    for one in re.split(r""",(?=(?:[^"']|"[^"]*"|'[^']*')*$)""", selector):
        steps, at, one = [], 0, one.strip()
        while at < len(one):
            found = _COMPOUND.match(one, at)
            if not found or not found[2] or (found[1] and not steps):
                raise ValueError(f"not a selector: {selector!r}")
            tag = re.match(r"\*|[A-Za-z][\w-]*", found[2])
            tests = tuple(("id" if p[1] == "#" else "class", "=" if p[1] == "#" else "~=", p[2]) if p[1] else (p[3].lower(), p[4], (p[5] or "").strip("\"'")) for p in _PART.finditer(found[2], tag.end() if tag else 0))
            steps.append(Step((found[1] or " ") if steps else None, None if tag is None or tag[0] == "*" else tag[0].lower(), tests))
            at = found.end()
        if not steps:
            raise ValueError(f"not a selector: {selector!r}")
        out.append(steps)
    return out


@dataclass(frozen=True)
class Field:
    """What to take from the elements of a selector: their stripped text, or an attribute; of the first one, or of all."""

    selector: str | tuple
    attribute: str | None = None
    all: bool = False


class _Pass(HTMLParser):
    """One pass over a page. ``plan``: for each bit its step, whether it is a selector's last, and of which field."""

    def __init__(self, plan: list[tuple[Step, bool, int]], fields: list[Field]) -> None:
        super().__init__(convert_charrefs=True)
        self.plan, self.fields = plan, fields
        self.found: list[list] = [[] for _ in fields]
        # Open elements: tag, prefixes that end here, here or around, at the child before, at any child before, and texts that are being gathered.
        self.stack: list[list] = [["", 0, 0, 0, 0, []]]
        self.open: list[tuple[int, list[str]]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._end_implied(tag)
        parent, attributes = self.stack[-1], {}
        for k, v in attrs:
            attributes.setdefault(k, v or "")
        own, matched = 0, set()
        for bit, (step, last, field) in enumerate(self.plan):
            if step.after is not None:
                before = {" ": parent[2], ">": parent[1], "+": parent[3], "~": parent[4]}[step.after]
                if not before >> (bit - 1) & 1:
                    continue
            if step.fits(tag, attributes):
                own |= 1 << bit
                if last:
                    matched.add(field)
        parent[3], parent[4] = own, parent[4] | own
        gathered = []
        for field in sorted(matched):
            f = self.fields[field]
            if self.found[field] and not f.all:
                continue
            if f.attribute is not None:
                if f.attribute in attributes:
                    self.found[field].append([attributes[f.attribute]])
                continue
            parts: list[str] = []
            self.found[field].append(parts)
            gathered.append(parts)
        if tag not in VOID:
            self.stack.append([tag, own, parent[2] | own, 0, 0, gathered])
            self.open += [(len(self.stack), p) for p in gathered]

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def _end_implied(self, tag: str) -> None:
        if tag in ENDS_P and any(e[0] == "p" for e in self.stack):
            self._close("p")
        ends = ENDED_BY.get(tag)
        while ends:
            at = next((e[0] for e in reversed(self.stack) if e[0] in ends or e[0] in HOLDERS), None)
            if at not in ends:
                break
            self._close(at)

    def handle_endtag(self, tag: str) -> None:
        if any(e[0] == tag for e in self.stack):
            self._close(tag)

    def _close(self, tag: str) -> None:
        while self.stack.pop()[0] != tag:
            pass
        while self.open and self.open[-1][0] > len(self.stack):
            self.open.pop()

    def handle_data(self, data: str) -> None:
        for _, parts in self.open:
            parts.append(data)


def taken(html: str, fields: list[Field], plan: list[tuple[Step, bool, int]] | None = None) -> list:
    """The value of each field: a text or None, or a list of texts."""
    reader = _Pass(plan if plan is not None else planned(fields), fields)
    reader.feed(html)
    reader.close()
    texts = [["".join(p).strip() for p in parts] for parts in reader.found]
    return [t if f.all else (t[0] if t else None) for t, f in zip(texts, fields)]


def planned(fields: list[Field]) -> list[tuple[Step, bool, int]]:
    return [(step, i == len(steps) - 1, n) for n, f in enumerate(fields) for steps in compiled(f.selector) for i, step in enumerate(steps)]


def page_fields(html: Column | str, fields: dict[str, Field]) -> Column:
    """A struct with a member for each field: a string (null if there is no such element), or an array of strings in the page's order. All are found in
    one pass over each page. A null page has null fields."""
    names, wanted = list(fields), list(fields.values())
    plan = planned(wanted)
    kind = StructType([StructField(n, ArrayType(StringType()) if f.all else StringType()) for n, f in fields.items()])

    @F.pandas_udf(kind)
    def found(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in pages:
            rows = [[None] * len(wanted) if page is None else taken(page, wanted, plan) for page in s]
            yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})

    return found(F.col(html) if isinstance(html, str) else html)
