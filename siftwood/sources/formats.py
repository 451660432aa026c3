"""Files of many formats as text: kinds by signature, and readers in Arrow batches."""

from __future__ import annotations

import csv
import email
import email.policy
import gzip
import io
import json
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How deep archives are read, how many members of each, and how many bytes of a member.
DEPTH, MEMBERS, MEMBER_BYTES = 2, 50, 64 << 20

# First bytes, endings and types of formats.
SIGNATURES = (
    ("pdf", "255044462D"), ("image", "89504E47"), ("image", "FFD8FF"), ("image", "474946383761"), ("image", "474946383961"),
    ("image", "424D"), ("image", "49492A00"), ("image", "4D4D002A"), ("gzip", "1F8B"), ("zip", "504B0304"),
    ("media", "494433"), ("media", "664C6143"), ("media", "4F676753"),
)
ENDINGS = {
    "captions": ("vtt", "srt"), "media": ("mp3", "wav", "flac", "ogg", "m4a", "mp4", "webm", "mov"), "eml": ("eml",), "csv": ("csv", "tsv"),
    "jsonl": ("jsonl", "ndjson"), "json": ("json", "jsonld"), "xml": ("xml", "svg", "rss", "atom"), "text": ("txt", "md", "markdown", "log", "yaml", "yml", "ics"), "rtf": ("rtf",),
}
TYPES = {
    "captions": ("text/vtt",), "eml": ("message/rfc822",), "csv": ("text/csv",), "jsonl": ("application/x-ndjson", "application/jsonl"), "json": ("application/json", "application/ld+json"),
    "xml": ("application/xml", "text/xml", "image/svg+xml", "application/rss+xml", "application/atom+xml"),
}


def kind_of(content: Column, name: Column, content_type: Column) -> Column:
    """A file's kind: by its first bytes, then by its ending or type; '' for a page and what isn't known."""
    head = F.hex(F.substring(content, 1, 16))
    lead = F.ltrim(F.decode(F.substring(content, 1, 512), "ISO-8859-1"))
    ending = F.lower(F.regexp_extract(F.regexp_replace(F.coalesce(name, F.lit("")), r"\?.*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    kind = F.lower(F.trim(F.regexp_replace(F.coalesce(content_type, F.lit("")), ";.*$", "")))
    out = F.when(F.lower(lead).rlike("^(<!doctype html|<html)"), "")
    for found, first in SIGNATURES:
        out = out.when(head.startswith(first), found)
    out = out.when(F.hex(F.substring(content, 258, 5)) == "7573746172", "tar").when(lead.startswith("WEBVTT"), "captions").when(lead.startswith("{\\rtf"), "rtf")
    out = out.when(lead.rlike(r"^[\[{]") & kind.isin("", "application/octet-stream") & ~ending.isin("jsonl", "ndjson"), "json")
    for found in dict.fromkeys([*ENDINGS, *TYPES]):
        out = out.when(ending.isin(*ENDINGS.get(found, ("",))) & (ending != "") | kind.isin(*TYPES.get(found, ("-",))), found)
    return F.coalesce(out.when(kind.rlike("^(audio|video)/"), "media").when(kind.startswith("text/") & ~kind.contains("html"), "text").otherwise(""), F.lit(""))


def decoded(data: bytes, content_type: str = "") -> str:
    """Text by its byte order mark, declared or meta charset, as UTF-8, else as Windows-1252."""
    tried = [name for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")) if data.startswith(mark)]
    said = re.search(r"charset\s*=\s*['\"]?([\w.-]+)", content_type or "", re.IGNORECASE)
    meta = re.search(rb"<meta\b[^>]*charset\s*=\s*['\"]?([\w.-]+)", data[:8192], re.IGNORECASE)
    tried += [said[1]] if said else []
    tried += [meta[1].decode("ascii", "ignore")] if meta else []
    for name in [*tried, "utf-8"]:
        try:
            return data.decode(name)
        except (UnicodeError, LookupError):
            continue
    return data.decode("windows-1252", "replace")


def _table(rows) -> str:
    cell = lambda v: " ".join(str("" if v is None else v).split("\n")).strip().replace("&", "&amp;").replace("|", "&#124;")
    return "\n".join("| " + " | ".join(cell(v) for v in row) + " |" for row in rows if any(str(v or "").strip() for v in row))


def _csv(data: bytes) -> str:
    text = decoded(data)
    try:
        dialect = csv.Sniffer().sniff(text[:4096], ",;\t|")
    except csv.Error:
        dialect = csv.excel
    return _table(csv.reader(io.StringIO(text, newline=""), dialect))


def _names(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _paragraphs(xml: bytes, block: str, leaves: tuple[str, ...]) -> str:
    """Text of the blocks of a document in order; ``leaves`` hold its characters."""
    out = []
    for node in ElementTree.fromstring(xml).iter():
        if _names(node) == block:
            said = "".join("\t" if _names(x) == "tab" else "\n" if _names(x) == "br" else x.text or "" for x in node.iter() if _names(x) in (*leaves, "tab", "br"))
            if said.strip():
                out.append(said.strip())
    return "\n".join(out)


def _all_text(xml: bytes, blocks: tuple[str, ...]) -> str:
    """All text of the blocks of a document, in order."""
    out = [" ".join("".join(n.itertext()).split()) for n in ElementTree.fromstring(xml).iter() if _names(n) in blocks]
    return "\n".join(x for x in out if x)


def _xlsx(z: zipfile.ZipFile) -> str:
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if _names(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _names(si) == "si"]
    out = []
    for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
        rows = []
        for row in (r for r in ElementTree.fromstring(z.read(name)).iter() if _names(r) == "row"):
            cells = []
            for c in row:
                value = next((x.text for x in c if _names(x) == "v"), None)
                formula = next((x.text for x in c if _names(x) == "f"), None)
                inline = "".join(t.text or "" for t in c.iter() if _names(t) == "t")
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)] if int(value) < len(shared) else ""
                cells.append(value if value is not None else inline or (f"={formula}" if formula else ""))
            rows.append(cells)
        out.append(f"## {name.rsplit('/', 1)[-1].removesuffix('.xml')}\n{_table(rows)}")
    return "\n".join(out)


def _zipped(data: bytes, depth: int) -> tuple[str, str]:
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()
    if "word/document.xml" in names:
        return "docx", _paragraphs(z.read("word/document.xml"), "p", ("t",))
    if "ppt/presentation.xml" in names:
        slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        return "pptx", "\n".join(f"## Slide {i}\n{_paragraphs(z.read(n), 'p', ('t',))}" for i, n in enumerate(slides, 1))
    if "xl/workbook.xml" in names:
        return "xlsx", _xlsx(z)
    mime = z.read("mimetype").decode("ascii", "ignore").strip() if "mimetype" in names else ""
    if "epub" in mime:
        opf = next(n for n in names if n.endswith(".opf"))
        root, folder = ElementTree.fromstring(z.read(opf)), opf.rpartition("/")[0]
        files = {i.get("id"): i.get("href") for i in root.iter() if _names(i) == "item"}
        order = [files.get(r.get("idref")) for r in root.iter() if _names(r) == "itemref"]
        return "epub", "\n".join(_all_text(z.read(f"{folder}/{n}".lstrip("/")), ("p", "h1", "h2", "h3", "li")) for n in order if n and f"{folder}/{n}".lstrip("/") in names)
    if "content.xml" in names and "opendocument" in mime:
        return "odf", _all_text(z.read("content.xml"), ("p", "h"))
    return "zip", _members(((i.filename, i.file_size, lambda i=i: z.read(i)) for i in z.infolist() if not i.is_dir()), depth)


def _members(members, depth: int) -> str:
    out = []
    for i, (name, size, data) in enumerate(members):
        if i >= MEMBERS:
            out.append(f"[more than {MEMBERS} members]")
            break
        if size > MEMBER_BYTES or depth >= DEPTH:
            out.append(f"# {name}\n[not read]")
            continue
        out.append(f"# {name}\n{read_file(data(), name, depth=depth + 1)[1]}")
    return "\n".join(out)


def _rtf(data: bytes) -> str:
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), data.decode("latin-1"))
    text = re.sub(r"\{\\\*[^{}]*\}|\{\\(?:fonttbl|colortbl|stylesheet|info)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", text)
    text = re.sub(r"\\par[d]?\b ?", "\n", text)
    return "\n".join(x for x in (" ".join(line.split()) for line in re.sub(r"\\[a-z]+-?\d* ?|[{}]", "", text).split("\n")) if x)


def _mail(data: bytes) -> str:
    m = email.message_from_bytes(data, policy=email.policy.default)
    body = m.get_body(("plain", "html"))
    head = [f"{k}: {m[k]}" for k in ("From", "To", "Date", "Subject") if m[k]]
    return "\n".join([*head, "", body.get_content().strip() if body else ""])


def sniffed(data: bytes, name: str, content_type: str) -> str:
    """As ``kind_of``, of bytes in hand: members of archives have no row of their own."""
    head = data[:16].hex().upper()
    lead = data[:512].lstrip()
    if lead.lower().startswith((b"<!doctype html", b"<html")):
        return ""
    for found, first in SIGNATURES:
        if head.startswith(first):
            return found
    if data[257:262] == b"ustar":
        return "tar"
    if lead.startswith((b"WEBVTT", b"{\\rtf")):
        return "rtf" if lead[:1] == b"{" else "captions"
    ending = re.search(r"\.([A-Za-z0-9]+)$", name.split("?")[0])
    ending, kind = ending[1].lower() if ending else "", content_type.split(";")[0].strip().lower()
    if lead[:1] in (b"{", b"[") and kind in ("", "application/octet-stream") and ending not in ENDINGS["jsonl"]:
        return "json"
    for found in dict.fromkeys([*ENDINGS, *TYPES]):
        if ending in ENDINGS.get(found, ()) or kind in TYPES.get(found, ()):
            return found
    return "media" if kind.startswith(("audio/", "video/")) else "text" if kind.startswith("text/") and "html" not in kind else ""


def read_file(data: bytes, name: str = "", content_type: str = "", depth: int = 0) -> tuple[str, str]:
    """(kind, text) of a file; of kinds without a reader here the text is empty."""
    kind = sniffed(data, name, content_type)
    if kind == "zip":
        return _zipped(data, depth)
    if kind == "gzip":
        with gzip.open(io.BytesIO(data)) as z:
            return kind, read_file(z.read(MEMBER_BYTES), name.removesuffix(".gz"), depth=depth + 1)[1] if depth < DEPTH else ""
    if kind == "tar":
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            return kind, _members([(m.name, m.size, lambda m=m: t.extractfile(m).read()) for m in t.getmembers() if m.isfile()], depth)
    if kind == "json":
        return kind, json.dumps(json.loads(decoded(data)), ensure_ascii=False, indent=1)
    if kind == "jsonl":
        return kind, "\n".join(json.dumps(json.loads(x), ensure_ascii=False) for x in decoded(data).splitlines() if x.strip())
    readers = {"csv": _csv, "eml": _mail, "rtf": _rtf, "xml": lambda d: " ".join("".join(ElementTree.fromstring(d).itertext()).split())}
    if kind in readers:
        return kind, readers[kind](data)
    return kind, "" if kind in ("pdf", "image", "media") else decoded(data, content_type)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, text, error) of every file below a path; a file that its reader
    can't read has the reason, and no text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    out.append((name.as_py(), *read_file(data.as_py() or b"", name.as_py()), None))
                except (ValueError, KeyError, OSError, EOFError, ElementTree.ParseError, zipfile.BadZipFile, tarfile.TarError) as error:
                    out.append((name.as_py(), "", "", f"{type(error).__name__}: {error}"[:200]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(4)], ["path", "kind", "text", "error"])

    return files.mapInArrow(run, "path string, kind string, text string, error string")
