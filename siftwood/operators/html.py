"""Page extraction with the standard library's parser, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPED = {"script", "style", "noscript", "template", "svg"}
FURNITURE = {"nav", "header", "footer", "aside", "form"}
BREAKS = {"p", "br", "li", "div", "section", "article", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "pre", "blockquote"}
VOID = {"br", "img", "meta", "link", "input", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}
MAIN_LEAST = 350


class _Page(HTMLParser):
    """Title, visible text, main text and links of a page; tolerates missing end tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.all, self.main, self.links, self.meta = [], [], [], [], {}
        self.skip = self.inside = self.furniture = 0
        self.in_title = False
        self.anchor: list | None = None
        self.open: list[str] = []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag in SKIPPED:
            self.skip += 1
        if tag in FURNITURE:
            self.furniture += 1
        if tag in ("article", "main"):
            self.inside += 1
        if tag == "title":
            self.in_title = True
        if tag == "a" and given.get("href"):
            self.anchor = [given["href"], []]
        if tag == "meta":
            name = (given.get("name") or given.get("property") or "").lower()
            if name and given.get("content"):
                self.meta.setdefault(name, given["content"].strip())
        if tag == "link" and "canonical" in (given.get("rel") or "").lower().split() and given.get("href"):
            self.meta.setdefault("canonical", given["href"].strip())
        if tag in BREAKS:
            self._add("\n")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        if tag in FURNITURE:
            self.furniture = max(0, self.furniture - 1)
        if tag in ("article", "main"):
            self.inside = max(0, self.inside - 1)
        if tag == "title":
            self.in_title = False
        if tag == "a" and self.anchor:
            self.links.append((self.anchor[0], " ".join("".join(self.anchor[1]).split())))
            self.anchor = None
        if tag in BREAKS:
            self._add("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.skip:
            if self.anchor:
                self.anchor[1].append(data)
            self._add(data)

    def _add(self, data):
        if self.in_title or self.skip:
            return
        self.all.append(data)
        if self.inside and not self.furniture:
            self.main.append(data)


def _tidy(parts: list[str]) -> str:
    lines = (" ".join(x.split()) for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x)


def read_page(html: str | None) -> dict:
    """Title, main text (the article's, or the body's where that is too short),
    visible text, links, description, canonical address and content status."""
    page = _Page()
    page.feed(html or "")
    page.close()
    visible, main = _tidy(page.all), _tidy(page.main)
    chosen = main if len(main) >= MAIN_LEAST or len(main) * 10 >= len(visible) else visible
    linked = sum(len(t) for _, t in page.links)
    status = "complete" if len(chosen) >= 600 else "short" if chosen else "unknown"
    if visible and linked > 0.7 * len(visible):
        status = "navigation_only"
    return {
        "title": " ".join("".join(page.title).split()),
        "content": chosen,
        "visible_chars": len(visible),
        "links": [{"href": h, "text": t} for h, t in page.links],
        "description": page.meta.get("description", page.meta.get("og:description", "")),
        "canonical": page.meta.get("canonical", ""),
        "content_status": status,
    }


PAGE = pa.struct([("title", pa.string()), ("content", pa.string()), ("visible_chars", pa.int64()), ("links", pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))), ("description", pa.string()), ("canonical", pa.string()), ("content_status", pa.string())])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row a page with what ``read_page`` finds; a null page is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([read_page(x) for x in batch.column(1).to_pylist()], PAGE)
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.flatten()], ["page_id", *(f.name for f in PAGE)])

    schema = "page_id long, title string, content string, visible_chars long, links array<struct<href:string,text:string>>, description string, canonical string, content_status string"
    return pages.select(F.col(id_col).cast("long").alias("page_id"), html_col).mapInArrow(run, schema)


HEADING, PAGE_HEADING = re.compile(r"#{1,6}\s+(.+)"), re.compile(r"## Page \d+\s*$")


def _segments(text: str, most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of a text's lines, ends included; longer ones by runs of words, and longer words cut."""
    for line in re.finditer(r"[^\n]*\n|[^\n]+", text):
        if line.end() - line.start() <= most:
            yield line.span()
            continue
        for run in re.finditer(rf"(?s).{{0,{most - 1}}}(?:\s|$)|.{{{most}}}", line[0]):
            if run.end() > run.start():
                yield line.start() + run.start(), line.start() + run.end()


def chunk_text(text: str, most: int = 900) -> list[tuple[int, int, str, str]]:
    """(start, end, text, heading) of runs that cover a text without a gap.

    Lines are added to a run while it has room. A full run ends behind its last
    empty line, where that leaves a third of the room, else where the next line
    begins; a page heading begins a new one. A run's heading is its own where it
    begins with one, else the last before it.
    """
    cuts, begin, gap = [0], 0, None
    for start, end in _segments(text, most):
        if start > begin and PAGE_HEADING.match(text, start, end):
            cuts.append(start)
            begin, gap = start, None
        while end - begin > most:
            begin = gap if gap is not None and gap - begin >= most // 3 else start
            cuts.append(begin)
            gap = None
        if not text[start:end].strip():
            gap = end
    ends = [*cuts[1:], len(text)]
    out, heading = [], ""
    for start, end in zip(cuts, ends, strict=True):
        if end > start:
            titles = [m[1].strip() for m in (HEADING.match(line) for line in text[start:end].split("\n")) if m]
            own = HEADING.match(text[start:end].split("\n", 1)[0])
            out.append((start, end, text[start:end], own[1].strip() if own else heading))
            heading = titles[-1] if titles else heading
    return out


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 900) -> DataFrame:
    """(doc_id, chunk, start, end, text, heading): text[start:end] is the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, i, *c) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, c in enumerate(chunk_text(t or "", most))]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "chunk", "start", "end", "text", "heading"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, chunk int, start int, end int, text string, heading string")
