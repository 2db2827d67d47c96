"""Hyperlinks of OOXML documents, from files read as binary rows: two relations, of targets and of linked texts, joined on their ids."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import ParseError, XMLPullParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T

#: Namespaces and parts of OOXML.
RELATIONS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
OFFICE = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
WORDS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARTS = ("word/_rels/document.xml.rels", "word/document.xml")

ROW = "path string, kind string, place int, id string, value string, mode string"
#: Bytes of a part that are unpacked at once.
STEP = 1 << 20


def _events(file, *kinds: str) -> Iterator:
    """A part's events as it is unpacked, so a part of any size takes little memory."""
    parser = XMLPullParser(kinds)
    while piece := file.read(STEP):
        parser.feed(piece)
        yield from parser.read_events()
    parser.close()
    yield from parser.read_events()


def _rows(archive: zipfile.ZipFile) -> Iterator[tuple]:
    """(kind, place, id, value, mode): `target` for each relationship, `text` for each text within a hyperlink, whose number is the place."""
    with archive.open(PARTS[0]) as f:
        for place, (_, e) in enumerate(x for x in _events(f, "end") if x[1].tag == f"{RELATIONS}Relationship"):
            yield "target", place, e.get("Id"), e.get("Target"), e.get("TargetMode")
    place, open_ = -1, []
    with archive.open(PARTS[1]) as f:
        for event, e in _events(f, "start", "end"):
            if e.tag == f"{WORDS}hyperlink":
                if event == "start":
                    place += 1
                    open_.append((place, e.get(f"{OFFICE}id")))
                else:
                    open_.pop()
            elif event == "end":
                if e.tag == f"{WORDS}t":
                    for at, own in open_:
                        yield "text", at, own, e.text, None
                e.clear()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in ROW.split(", ")]
    types = [pa.int32() if c.endswith(" int") else pa.string() for c in ROW.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            try:
                with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as z:
                    found = [(path.as_py(), *row) for row in _rows(z)]
            except (OSError, KeyError, zipfile.BadZipFile, ParseError):
                continue
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)


def docx_hyperlinks(files: DataFrame) -> DataFrame:
    """(path, phrase, href) of files (path, content), as read by the binaryFile source: external links of .docx files.

    A phrase is all text of a hyperlink, stripped; of equal phrases in a file the last counts. Links without text or target, and all of a file that can't be read, are left out.
    """
    rows = files.where("lower(path) like '%.docx'").select("path", "content").mapInArrow(_unpack, ROW)
    targets = rows.where("kind = 'target' and mode = 'External' and value <> ''").groupBy("path", "id").agg(F.max_by("value", "place").alias("href"))
    texts = rows.where("kind = 'text'").withColumn("order", F.monotonically_increasing_id())
    texts = texts.groupBy("path", "place", "id").agg(F.array_sort(F.collect_list(F.struct("order", F.coalesce("value", F.lit("")).alias("value")))).alias("parts"))
    phrases = texts.select("path", "place", "id", T.strip(F.array_join(F.transform("parts", lambda p: p["value"]), "")).alias("phrase")).where("phrase <> ''")
    return phrases.join(targets, ["path", "id"]).groupBy("path", "phrase").agg(F.max_by("href", "place").alias("href"))
