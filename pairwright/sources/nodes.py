"""Pages as nodes in page order, CSS selectors over them, and the Arrow step that reads pages with them.

The nodes below one are the stretch after it, and what it says is a stretch of the page's text; a selector's nodes are found once a page.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from pairwright.sources.captures import parse

_STEP = re.compile(r"""([a-z][a-z0-9]*)|\#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([*^]?=)"([^"]*)"(\ i)?)?\]|:not\(([^()]+)\)""", re.X)


def _step(selector: str) -> tuple[tuple[str, str] | None, Callable[[dict, str], bool]]:
    """One step of a selector: tag, #id, .class, [attr], [attr="v"], [attr*="v" i], [attr^="v"], :not(step); ahead of it the
    mark (kind, name) that all its nodes have, None if any node may match."""
    found = list(_STEP.finditer(selector))
    if "".join(m[0] for m in found) != selector:
        raise ValueError(f"selector not understood: {selector}")

    def one(m: re.Match) -> Callable[[dict, str], bool]:
        tag, ident, name, attr, op, value, fold, no = m.groups()
        if tag:
            return lambda a, t: t == tag
        if ident:
            return lambda a, t: a.get("id") == ident
        if name:
            return lambda a, t: name in a.get("class", "").split()
        if no:
            inner = _step(no)[1]
            return lambda a, t: not inner(a, t)
        if not op:
            return lambda a, t: attr in a
        value, case = (value.lower(), str.lower) if fold else (value, str)
        test = {"=": str.__eq__, "*=": str.__contains__, "^=": str.startswith}[op]
        return lambda a, t: attr in a and test(case(a[attr]), value)

    tests = [one(m) for m in found]
    marks = [(kind, m[k]) for kind, k in (("id", 2), ("class", 3), ("attr", 4), ("tag", 1)) for m in found if m[k]]
    return next(iter(marks), None), tests[0] if len(tests) == 1 else lambda a, t: all(f(a, t) for f in tests)


@functools.cache
def _chains(selectors: str) -> list[tuple[tuple[str, str] | None, list[Callable[[dict, str], bool]]]]:
    """Comma-separated selectors as the mark of their last step and their steps, the last one first; steps apart by spaces are ancestors."""
    alone = re.findall(r'(?:\[(?:[^\]"]|"[^"]*")*\]|[^,\[])+', selectors)
    each = [[_step(s) for s in re.findall(r'(?:\[(?:[^\]"]|"[^"]*")*\]|[^\s\[])+', one.strip())] for one in alone]
    return [(steps[-1][0], [test for _, test in reversed(steps)]) for steps in each]


class Page:
    """The nodes of a page by their place: tag, attrs, parent, last (the last node below), and the page's text without scripts and styles."""

    def __init__(self, html: str | None):
        self.tag, self.attrs, self.parent, self.last, self._start, self._end = [], [], [], [], [], []
        self._hits: dict[str, list[int]] = {}
        text, length = [], 0
        todo: list = [(parse(html or ""), -1)]
        while todo:
            x, parent = todo.pop()
            if isinstance(x, str):
                text.append(x)
                length += len(x)
            elif isinstance(x, int):  # all below node x is done
                self.last[x], self._end[x] = len(self.tag) - 1, length
            else:
                here = len(self.tag)
                for to, value in ((self.tag, x.name), (self.attrs, x.attrs), (self.parent, parent), (self.last, here), (self._start, length), (self._end, length)):
                    to.append(value)
                quiet = x.name in ("script", "style", "template")
                todo.append((here, parent))
                todo += [(c, here) for c in reversed(x.children) if not (quiet and isinstance(c, str))]
        self._text = "".join(text)
        self._nodes = self._marked()

    def raw(self, n: int | None) -> str:
        return "" if n is None else self._text[self._start[n] : self._end[n]]

    def text(self, n: int | None) -> str:
        return " ".join(self.raw(n).split())

    def stretch(self, n: int) -> tuple[int, int]:
        """Where the text of a node begins and ends in the page's."""
        return self._start[n], self._end[n]

    def attr(self, n: int | None, *names: str) -> str:
        """The first of these attributes that says something, or ''."""
        return "" if n is None else next((v for k in names if (v := self.attrs[n].get(k))), "")

    def _marked(self) -> dict[tuple[str, str], list[int]]:
        """The nodes of each tag, id, class and attribute, in page order."""
        out: dict[tuple[str, str], list[int]] = {}
        for n, (tag, attrs) in enumerate(zip(self.tag, self.attrs, strict=True)):
            out.setdefault(("tag", tag), []).append(n)
            for name, value in attrs.items():
                out.setdefault(("attr", name), []).append(n)
                if name == "id":
                    out.setdefault(("id", value), []).append(n)
                elif name == "class":
                    for c in set(value.split()):
                        out.setdefault(("class", c), []).append(n)
        return out

    def _below(self, steps: list[Callable[[dict, str], bool]], n: int) -> bool:
        """Whether the nodes around n match the steps, the nearest first."""
        for step in steps:
            n = self.parent[n]
            while n >= 0 and not step(self.attrs[n], self.tag[n]):
                n = self.parent[n]
            if n < 0:
                return False
        return True

    def hits(self, selectors: str) -> list[int]:
        """The nodes that one of the selectors matches, in page order; only nodes with a selector's mark are looked at."""
        found = self._hits.get(selectors)
        if found is None:
            some: set[int] = set()
            for mark, (step, *around) in _chains(selectors):
                for n in range(len(self.tag)) if mark is None else self._nodes.get(mark, ()):
                    if step(self.attrs[n], self.tag[n]) and (not around or self._below(around, n)):
                        some.add(n)
            found = self._hits[selectors] = sorted(some)
        return found

    def every(self, selectors: str, n: int = 0, own: bool = False) -> list[int]:
        """The hits below a node, or at and below it."""
        found = self.hits(selectors)
        return found[bisect_left(found, n if own else n + 1) : bisect_right(found, self.last[n])]

    def first(self, selectors: str, n: int = 0, own: bool = False) -> int | None:
        return next(iter(self.every(selectors, n, own)), None)

    def matches(self, selectors: str, n: int) -> bool:
        found = self.hits(selectors)
        at = bisect_left(found, n)
        return at < len(found) and found[at] == n

    def closest(self, selectors: str, n: int) -> int | None:
        """The node, if it matches, or the nearest node around it that does."""
        while n >= 0:
            if self.matches(selectors, n):
                return n
            n = self.parent[n]
        return None


def read_pages(pages: DataFrame, column: str, url: str | None, name: str, kind: DataType, function: Callable[[Page, str], object]) -> DataFrame:
    """The columns of pages but the HTML, and what function gives for each page (and its URL), as typed Arrow columns; a null page is an empty one."""
    kept = [f for f in pages.schema.fields if f.name not in (column, name)]
    n = len(kept)
    # columns go by their number: any name may stand in pages
    used = [*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)], F.col(f"`{column}`").alias("html"), (F.col(f"`{url}`") if url else F.lit(None).cast("string")).alias("url")]
    fields = "".join(f"c{i} {f.dataType.simpleString()}, " for i, f in enumerate(kept))
    arrow = to_arrow_type(kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, urls = batch.column(n), batch.column(n + 1)
            got = [function(Page(html[k].as_py()), urls[k].as_py() or "") for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(got, arrow)], [*(f"c{i}" for i in range(n)), "found"])

    return pages.select(*used).mapInArrow(read, f"{fields}found {kind.simpleString()}").toDF(*(f.name for f in kept), name)
