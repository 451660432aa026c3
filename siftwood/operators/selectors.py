"""Fields of pages by simple selectors: tag, .class, #id, [attribute], descendants."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html import SKIPPED, VOID

PART = re.compile(r"^([A-Za-z][\w-]*|\*)?((?:[.#][\w-]+|\[[\w-]+(?:=\"?[^\]\"]*\"?)?\])*)$")
BIT = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:=\"?([^\]\"]*)\"?)?\]")


def parsed(selector: str) -> list[tuple[str, list[tuple[str, str, str | None]]]]:
    """Steps of a selector from the outermost: (tag or '', conditions)."""
    out = []
    for step in selector.split():
        found = PART.match(step)
        if not found:
            raise ValueError(f"unknown selector: {selector}")
        bits = [("class", name, None) if sign == "." else ("id", name, None) if sign == "#" else ("attr", attr, value or None) for sign, name, attr, value in BIT.findall(found[2] or "")]
        out.append(((found[1] or "").replace("*", "").lower(), bits))
    return out


def _fits(step, tag: str, attrs: dict) -> bool:
    name, bits = step
    if name and name != tag:
        return False
    for kind, key, value in bits:
        if kind == "class" and key not in (attrs.get("class") or "").split():
            return False
        if kind == "id" and attrs.get("id") != key:
            return False
        if kind == "attr" and (key not in attrs or value is not None and attrs[key] != value):
            return False
    return True


class _Finder(HTMLParser):
    def __init__(self, steps, attribute: str | None, most: int) -> None:
        super().__init__(convert_charrefs=True)
        self.steps, self.attribute, self.most = steps, attribute, most
        self.open: list[tuple[str, dict]] = []
        self.taking: list[tuple[int, list[str]]] = []
        self.found: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        self.skip += tag in SKIPPED
        path = [*self.open, (tag, given)]
        if _fits(self.steps[-1], tag, given):
            need = len(self.steps) - 2
            for t, a in reversed(self.open):
                if need >= 0 and _fits(self.steps[need], t, a):
                    need -= 1
            if need < 0:
                if self.attribute:
                    if self.attribute in given:
                        self.found.append(given[self.attribute])
                elif tag not in VOID:
                    self.taking.append((len(path), []))
        if tag not in VOID:
            self.open = path

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in SKIPPED))
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.open = self.open[:i]
                break
        self._close()

    def _close(self):
        while self.taking and self.taking[-1][0] > len(self.open):
            self.found.append(" ".join("".join(self.taking.pop()[1]).split()))

    def handle_data(self, data):
        if not self.skip:
            for _, parts in self.taking:
                parts.append(data)

    def result(self) -> list[str]:
        self.close()
        self.open = []
        self._close()
        return [x for x in self.found if x][: self.most]


def select(html: str | None, selector: str, attribute: str | None = None, most: int = 50) -> list[str]:
    """Texts (or an attribute) of the elements that a selector names, in the order they end."""
    finder = _Finder(parsed(selector), attribute, most)
    finder.feed(html or "")
    return finder.result()


def fields(pages: DataFrame, specs: dict[str, tuple[str, str | None]], id_col: str = "page_id", html_col: str = "html", most: int = 50) -> DataFrame:
    """(page_id, field, place, value) for each field's selector; a field that a page
    lacks has one row with null place and value."""
    for selector, _ in specs.values():
        parsed(selector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for name, (selector, attribute) in specs.items():
                    got = select(text.as_py(), selector, attribute, most)
                    out += [(page, name, i, x) for i, x in enumerate(got)] or [(page, name, None, None)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int32(), pa.string()))], ["page_id", "field", "place", "value"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), html_col).mapInArrow(run, "page_id long, field string, place int, value string")
