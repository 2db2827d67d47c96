"""Documents that flow — HTML, EPUB, DOCX and plain text — as fragments: what markup says of a heading, a list, a table or a style is taken as it is, and nothing is guessed from a layout.

A document's elements come from a small reader of its format, in Python workers; that they are blocks, cleaned, is said by Spark's expressions. A page is a
chapter of an EPUB, PER_PAGE elements of HTML and DOCX, and TEXT_PAGE bytes of text, so that pages of EPUB and text can be read by themselves: `Documents`, a
data source, plans them as partitions and opens no more than a range of pages asks for. Formats whose pages need a renderer, such as PDF, aren't read here: their pages come as RAW_PAGE rows.
"""

from __future__ import annotations

import io
import posixpath
import re
import unicodedata
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from typing import BinaryIO
from urllib.parse import quote, unquote
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

from pagewright.functions import text as X
from pagewright.functions.steps import deep_folds, once
from pagewright.operators import tables
from pagewright.operators.pages import block, emphasis
from pagewright.schema import BLOCK, BOLD, ITALIC, RUN, SUPERSCRIPT
from pagewright.sources.docx import OFFICE, RELATIONS, WORDS

FORMATS = ("html", "htm", "xhtml", "epub", "docx", "txt")
#: Elements of a page of HTML or DOCX, bytes of a page of text, and bytes of pages that make a partition.
PER_PAGE, TEXT_PAGE, PARTITION = 200, 1 << 16, 8 << 20
ELEMENT = f"struct<kind:string,level:int,ordered:boolean,runs:array<{RUN}>,rows:array<array<string>>,src:string,alt:string>"
PAGES = f"doc_id long, page_number int, elements array<{ELEMENT}>"


def _norm(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


@dataclass
class Element:
    """kind: p, h, li, pre, table or img. runs: (text, flags, href)."""

    kind: str
    runs: list[tuple[str, int, str | None]] = field(default_factory=list)
    level: int | None = None
    ordered: bool | None = None
    rows: list[list[str]] = field(default_factory=list)
    src: str | None = None
    alt: str | None = None

    @property
    def text(self) -> str:
        return "".join(r[0] for r in self.runs)

    def row(self) -> dict:
        """As ELEMENT, text in NFKC."""
        runs = [{"text": _norm(t), "bold": bool(f & BOLD), "italic": bool(f & ITALIC), "superscript": bool(f & SUPERSCRIPT), "href": h} for t, f, h in self.runs]
        return {"kind": self.kind, "level": self.level, "ordered": self.ordered, "runs": runs, "rows": [[_norm(c) for c in r] for r in self.rows], "src": self.src, "alt": self.alt}


class _Html(HTMLParser):
    BREAKS = {"p", "div", "section", "article", "header", "footer", "nav", "aside", "main", "body", "blockquote", "figure", "figcaption", "dl", "dt", "dd", "hr", "ul", "ol", "form", "address"}
    STYLES = {"b": BOLD, "strong": BOLD, "i": ITALIC, "em": ITALIC, "sup": SUPERSCRIPT}
    SILENT = {"script", "style", "head", "template", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[Element] = []
        self.now: Element | None = None
        self.flags: dict[int, int] = dict.fromkeys((BOLD, ITALIC, SUPERSCRIPT), 0)
        self.hrefs: list[str | None] = []
        self.lists: list[str] = []
        self.silent = self.pre = 0
        self.rows: list[list[str]] | None = None

    def close_block(self) -> None:
        own, self.now = self.now, None
        if own is not None and own.text.strip():
            own.runs = [(own.text.strip("\n"), 0, None)] if own.kind == "pre" else _squeezed(own.runs)
            self.out.append(own)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in self.SILENT:
            self.silent += 1
        elif tag in self.STYLES:
            self.flags[self.STYLES[tag]] += 1
        elif tag == "a":
            self.hrefs.append(attrs.get("href") or None)
        elif tag == "table":
            self.close_block()
            self.rows = []
        elif self.rows is not None and tag == "tr":
            self.rows.append([])
        elif self.rows is not None and tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("")
        elif tag in ("ul", "ol"):
            self.close_block()
            self.lists.append(tag)
        elif tag == "li":
            self.close_block()
            self.now = Element("li", ordered=bool(self.lists) and self.lists[-1] == "ol")
        elif re.fullmatch("h[1-6]", tag):
            self.close_block()
            self.now = Element("h", level=int(tag[1]))
        elif tag == "pre":
            self.close_block()
            self.pre += 1
            self.now = Element("pre")
        elif tag == "img":
            self.close_block()
            src = (attrs.get("src") or "").strip()
            # an address that a page could run as a program, or that holds the image itself, is none
            self.out.append(Element("img", src=quote(src, safe="/:?#[]@!$&*+,;=%~-._") if src and not re.match(r"(?i)(data|javascript|vbscript):", src) else None, alt=attrs.get("alt") or ""))
        elif tag == "br":
            self.handle_data("\n" if self.pre else " ")
        elif tag in self.BREAKS and not (self.now is not None and self.now.kind == "li" and not self.now.text.strip()):
            self.close_block()

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in self.STYLES:
            self.flags[self.STYLES[tag]] = max(0, self.flags[self.STYLES[tag]] - 1)
        elif tag == "a":
            del self.hrefs[-1:]
        elif tag == "table" and self.rows is not None:
            rows, self.rows = [[re.sub(r"\s+", " ", c).strip() for c in r] for r in self.rows if r], None
            if rows:
                self.out.append(Element("table", rows=rows))
        elif tag in ("ul", "ol"):
            self.close_block()
            del self.lists[-1:]
        elif tag == "pre":
            self.close_block()
            self.pre = max(0, self.pre - 1)
        elif tag == "li" or tag in self.BREAKS or re.fullmatch("h[1-6]", tag):
            self.close_block()

    def handle_data(self, data):
        if self.silent:
            return
        if self.rows is not None:
            if self.rows and self.rows[-1]:
                self.rows[-1][-1] += data
            return
        if self.now is None:
            if not data.strip():
                return
            self.now = Element("p")
        flags = sum(bit for bit, n in self.flags.items() if n)
        self.now.runs.append((data, flags, next((h for h in reversed(self.hrefs) if h), None)))


def _squeezed(runs: list[tuple]) -> list[tuple]:
    """White space as single blanks, none at either end."""
    out, blank = [], True
    for text, flags, href in runs:
        text = re.sub(r"\s+", " ", text)
        if blank:
            text = text.lstrip(" ")
        if text:
            blank = text.endswith(" ")
            out.append((text, flags, href))
    if out:
        out[-1] = (out[-1][0].rstrip(" "), *out[-1][1:])
    return [r for r in out if r[0]]


def html_elements(text: str) -> list[Element]:
    parser = _Html()
    parser.feed(text)
    parser.close()
    parser.close_block()
    return parser.out


def _name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def chapters(z: zipfile.ZipFile) -> list[str]:
    """An EPUB's chapters, as names in the archive, in the order of the spine."""
    package = next(e.get("full-path") for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if _name(e) == "rootfile")
    root = ElementTree.fromstring(z.read(package))
    files = {e.get("id"): e.get("href") for e in root.iter() if _name(e) == "item"}
    refs = [files.get(e.get("idref")) for e in root.iter() if _name(e) == "itemref"]
    return [posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(r))) for r in refs if r]


def text_pages(f: BinaryIO, first: int, last: int) -> Iterator[tuple[int, list[Element]]]:
    """Pages first to last of a text: page n has the paragraphs that begin in its TEXT_PAGE bytes. A paragraph is lines without an empty one between.

    Reads those bytes, up to the end of the last paragraph, and back to the beginning of the line before.
    """
    start, end = (first - 1) * TEXT_PAGE, last * TEXT_PAGE
    at, blank = start, True
    if start:
        # the first line that begins at `start` or later, and whether the one before it is empty
        back = b""
        where = start
        while where > 0 and b"\n" not in back[:-1]:
            step = min(4096, where)
            where -= step
            f.seek(where)
            back = f.read(step) + back
        f.seek(start)
        rest = b"" if back.endswith(b"\n") else f.readline()
        before = (back + rest).rstrip(b"\n").rpartition(b"\n")[2]
        at, blank = start + len(rest), not before.strip()
    f.seek(at)
    now: list[bytes] | None = None
    number, found = first, []

    def closed() -> None:
        if now:
            text = b" ".join(now).decode("utf-8", "replace").removeprefix("\ufeff")
            if runs := _squeezed([(text, 0, None)]):
                found.append(Element("p", runs))

    while line := f.readline():
        begins = blank and bool(line.strip())
        if begins or not line.strip():
            closed()
            now = None
        if at >= end and now is None:
            break
        if begins:
            while number < at // TEXT_PAGE + 1:
                yield number, found
                number, found = number + 1, []
            now = []
        if now is not None:
            now.append(line.strip())
        blank = not line.strip()
        at += len(line)
    closed()
    for n in range(number, last + 1):
        yield n, found
        found = []


def docx_elements(content: bytes) -> list[Element]:
    """Paragraphs, headings by style, list items, styles, links and tables of a body."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORDS}body")
        targets = {}
        if "word/_rels/document.xml.rels" in z.namelist():
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")).iter(f"{RELATIONS}Relationship") if r.get("TargetMode") == "External"}

    def on(properties, tag: str) -> bool:
        e = None if properties is None else properties.find(f"{WORDS}{tag}")
        return e is not None and e.get(f"{WORDS}val") not in ("0", "false", "none")

    def paragraph(p) -> Element:
        own = p.find(f"{WORDS}pPr")
        style = None if own is None else own.find(f"{WORDS}pStyle")
        heading = re.fullmatch(r"(?:Heading|Title)\s?([1-6])?", (style.get(f"{WORDS}val") or "") if style is not None else "")
        out = Element("h" if heading else "p", level=int(heading[1] or 1) if heading else 0)
        if not heading and own is not None and own.find(f"{WORDS}numPr") is not None:
            out = Element("li", ordered=False)
        for child in p:
            href = targets.get(child.get(f"{OFFICE}id")) if child.tag == f"{WORDS}hyperlink" else None
            for run in child.iter(f"{WORDS}r") if child.tag in (f"{WORDS}hyperlink", f"{WORDS}r", f"{WORDS}ins", f"{WORDS}smartTag") else ():
                style = run.find(f"{WORDS}rPr")
                raised = None if style is None else style.find(f"{WORDS}vertAlign")
                flags = BOLD * on(style, "b") | ITALIC * on(style, "i") | SUPERSCRIPT * (raised is not None and raised.get(f"{WORDS}val") == "superscript")
                text = "".join((e.text or "") if e.tag == f"{WORDS}t" else " " if e.tag in (f"{WORDS}tab", f"{WORDS}br") else "" for e in run.iter())
                out.runs.append((text, flags, href))
        out.runs = _squeezed(out.runs)
        return out

    out = []
    for e in body if body is not None else ():
        if e.tag == f"{WORDS}p":
            out.append(paragraph(e))
        elif e.tag == f"{WORDS}tbl":
            out.append(Element("table", rows=[[" ".join(x.text for x in map(paragraph, c.iter(f"{WORDS}p")) if x.text) for c in r.iter(f"{WORDS}tc")] for r in e.iter(f"{WORDS}tr")]))
    return [e for e in out if e.rows or e.text.strip()]


def _kind(path: str) -> str:
    return path.lower().rpartition(".")[2]


def page_count(path: str, f: BinaryIO, size: int) -> int | None:
    """How many pages a document has, if that can be told before it is read."""
    kind = _kind(path)
    if kind == "txt":
        return max(1, -(-size // TEXT_PAGE))
    if kind == "epub":
        with zipfile.ZipFile(f) as z:
            return max(1, len(chapters(z)))
    return None


def read_pages(path: str, f: BinaryIO, size: int, first: int = 1, last: int | None = None) -> Iterator[tuple[int, list[Element]]]:
    """(number, elements) of a document's pages first to last; a document without any element has one empty page."""
    kind = _kind(path)
    last = min(x for x in (last, page_count(path, f, size), 1 << 30) if x is not None)
    if kind == "txt":
        yield from text_pages(f, first, last)
    elif kind == "epub":
        with zipfile.ZipFile(f) as z:
            names = chapters(z)
            for n in range(first, last + 1):
                yield n, html_elements(z.read(names[n - 1]).decode("utf-8", "replace")) if names else []
    else:
        content = f.read()
        all_ = docx_elements(content) if kind == "docx" else html_elements(content.decode("utf-8", "replace").removeprefix("\ufeff").replace("\r\n", "\n"))
        for n in range(first, min(last, max(1, -(-len(all_) // PER_PAGE))) + 1):
            yield n, all_[(n - 1) * PER_PAGE : n * PER_PAGE]


#: What a document that can't be read raises.
BROKEN = (OSError, KeyError, StopIteration, RuntimeError, zipfile.BadZipFile, zlib.error, pa.ArrowInvalid, ElementTree.ParseError)


def blocks_of(pages: DataFrame) -> DataFrame:
    """FRAGMENT rows of PAGES rows: elements as blocks, their texts cleaned. A table of one row or column is paragraphs, a cell each; what has no text but an image is none."""
    none = F.array().cast(f"array<{BLOCK}>")
    kinds = F.col("elements")

    def blocks(e: Column) -> Column:
        whole = F.array_join(F.transform(e["runs"], lambda r: r["text"]), "")
        text, code = X.strip(X.clean(whole, False)), X.clean_code(whole, False)
        cells = F.filter(F.flatten(e["rows"]), lambda c: ~X.blank(c))
        image = F.when(e["src"].isNotNull(), block("img", src=e["src"], alt=e["alt"])).otherwise(block("img_placeholder", alt=e["alt"]))
        return (
            F.when(e["kind"] == "table", F.when(tables.is_table(e["rows"]), F.array(block("table", rows=e["rows"]))).otherwise(F.transform(cells, lambda c: block("p", text=c))))
            .when(e["kind"] == "img", F.array(image))
            .when(X.blank(whole), none)
            .when(e["kind"] == "h", F.array(block("h", text=text, level=e["level"])))
            .when(e["kind"] == "li", F.array(block("li", text=text, ordered=e["ordered"], runs=emphasis(e["runs"]))))
            .when(e["kind"] == "pre", F.array(block("code", text=code)))
            .otherwise(F.array(block("p", text=text, runs=emphasis(e["runs"]))))
        )

    names = [f.name for f in pages.schema["elements"].dataType.elementType.fields]
    with deep_folds(pages.sparkSession):
        clean = F.transform(kinds, lambda e: F.struct(*[(F.when(F.size(e[n]) > 0, tables.clean_table(e[n])).otherwise(e[n]) if n == "rows" else e[n]).alias(n) for n in names]))
        d = once(pages, "elements", clean)
        empty = F.array().cast("array<string>")
        return d.select("doc_id", "page_number", empty.alias("margin"), F.flatten(F.transform("elements", blocks)).alias("blocks"), empty.alias("callout"))


def read_documents(files: DataFrame) -> DataFrame:
    """FRAGMENT rows of files (doc_id, path, content), by the path's ending: .html, .htm, .xhtml, .epub, .docx, .txt; others are left out.

    Documents without text or image have one empty page; what can't be read has none. Files that repeat are read each. A document has to fit a row; load() has no such bound for text and EPUB.
    """
    schema = T.StructType.fromDDL(PAGES)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, path, content in zip(*(batch.column(c) for c in ("doc_id", "path", "content")), strict=True):
                body = content.as_py() or b""
                try:
                    found = [{"doc_id": doc.as_py(), "page_number": n, "elements": [e.row() for e in own]} for n, own in read_pages(path.as_py(), io.BytesIO(body), len(body))]
                except BROKEN:
                    continue
                yield pa.RecordBatch.from_pylist(found, arrow)

    known = F.lower("path").rlike(rf"\.({'|'.join(FORMATS)})$")
    return blocks_of(files.where(known).select(F.col("doc_id").cast("long").alias("doc_id"), "path", "content").mapInArrow(run, schema))


# A data source


@dataclass
class Part(InputPartition):
    """Pages first to last of a file; last is None where the pages can't be counted before."""

    path: str
    size: int
    first: int
    last: int | None

    def __init__(self, path: str, size: int, first: int, last: int | None):
        super().__init__(None)
        self.path, self.size, self.first, self.last = path, size, first, last


def _open(path: str) -> BinaryIO:
    fs, name = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    return io.BufferedReader(fs.open_input_file(name), 1 << 16)


def _listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of all known files below a folder."""
    fs, name = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    info = fs.get_file_info(name)
    all_ = [info] if info.type == pyarrow.fs.FileType.File else fs.get_file_info(pyarrow.fs.FileSelector(name, recursive=True))
    scheme = f"{path.partition('://')[0]}://" if "://" in path else ""
    return sorted((scheme + i.path, i.size) for i in all_ if i.type == pyarrow.fs.FileType.File and _kind(i.path) in FORMATS)


class Documents(DataSource):
    """Pages of the documents of a folder: spark.read.format("documents").load(folder), with a path column beside PAGES' but doc_id.

    Filters on page_number are taken over where the session allows it (spark.sql.python.filterPushdown.enabled). The driver opens each EPUB's
    table of contents, and nothing of other files. Files have to be where pyarrow's file systems reach them from driver and executors; for others there is read_documents().
    """

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return f"path string, {PAGES.partition(', ')[2]}"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return DocumentsReader(self.options["path"])


class DocumentsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.first, self.last, self.wanted = path, 1, 1 << 30, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("page_number",):
                yield f
                continue
            if isinstance(f, EqualTo):
                self.first, self.last = max(self.first, f.value), min(self.last, f.value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.last = min(self.last, f.value - isinstance(f, LessThan))
            elif isinstance(f, In):
                self.wanted = set(f.value) & (self.wanted or set(f.value))
            else:
                yield f

    def partitions(self) -> list[Part]:
        first, last = self.first, self.last
        if self.wanted is not None:
            first, last = max(first, min(self.wanted, default=1)), min(last, max(self.wanted, default=0))
        out = []
        for path, size in _listed(self.path):
            pages = None
            if _kind(path) in ("txt", "epub"):
                try:
                    with _open(path) as f:
                        pages = page_count(path, f, size)
                except BROKEN:
                    continue
            if pages is None:
                out += [Part(path, size, first, last)] * (first <= last)
                continue
            step = max(1, PARTITION * pages // max(1, size))
            out += [Part(path, size, n, min(n + step - 1, pages, last)) for n in range(first, min(pages, last) + 1, step)]
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        try:
            with _open(partition.path) as f:
                for n, own in read_pages(partition.path, f, partition.size, partition.first, partition.last):
                    if self.wanted is None or n in self.wanted:
                        yield partition.path, n, [_as_row(e.row()) for e in own]
        except BROKEN:
            return


def _as_row(e: dict) -> tuple:
    """In the order of ELEMENT."""
    runs = [tuple(r[n] for n in ("text", "bold", "italic", "superscript", "href")) for r in e["runs"]]
    return e["kind"], e["level"], e["ordered"], runs, e["rows"], e["src"], e["alt"]


def load(spark: SparkSession, path: str, start: int = 1, end: int | None = None) -> DataFrame:
    """FRAGMENT rows of pages start to end of the documents of a folder; doc_id is a hash of the path. A range of pages opens what it needs."""
    spark.dataSource.register(Documents)
    d = spark.read.format("documents").load(path).where(F.col("page_number") >= start)
    d = d if end is None else d.where(F.col("page_number") <= end)
    return blocks_of(d.select(F.xxhash64("path").alias("doc_id"), "page_number", "elements"))
