"""Markup straight to blocks, and documents as a data source that opens no more than a range of pages asks for."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewright.sources import documents as D


def blocks(spark, html):
    row = D.read_documents(spark.createDataFrame([(1, "a.html", html.encode())], "doc_id long, path string, content binary")).first()
    return [(b.type, b.text, b.level, b.ordered) for b in row.blocks]


def test_what_markup_says_is_not_guessed(spark):
    items = "".join(f"<li>{i}</li>" for i in range(120))
    html = f"<h1>Great Title</h1><p>Short body.</p><h1>What next?</h1><p>2. not a list</p><ol>{items}</ol><h5>deep</h5><ul><li><p>in a paragraph</p><p>more</p></li></ul>"
    got = blocks(spark, html)
    assert got[:4] == [("h", "Great Title", 1, None), ("p", "Short body.", None, None), ("h", "What next?", 1, None), ("p", "2. not a list", None, None)]
    assert got[4:124] == [("li", str(i), None, True) for i in range(120)]
    assert got[124:] == [("h", "deep", 5, None), ("li", "in a paragraph", None, False), ("p", "more", None, None)]


def test_elements_that_are_none_or_many(spark):
    html = '<table><tr><td>only</td></tr></table><table><tr><td>a</td><td></td></tr><tr><td>b</td><td>c</td></tr></table><img src="pic (1).png" alt="A &amp; B"><img src="data:x"><img><p> </p><p>ﬁne</p>'
    row = D.read_documents(spark.createDataFrame([(1, "a.html", html.encode())], "doc_id long, path string, content binary")).first()
    assert [(b.type, b.text, b.rows, b.src, b.alt) for b in row.blocks] == [
        ("p", "only", None, None, None), ("table", None, [["a", ""], ["b", "c"]], None, None), ("img", None, None, "pic%20%281%29.png", "A & B"),
        ("img_placeholder", None, None, None, ""), ("img_placeholder", None, None, None, ""), ("p", "fine", None, None, None),
    ]


def test_long_documents_have_pages(spark):
    html = "".join(f"<p>p{i}</p>" for i in range(D.PER_PAGE * 2 + 1))
    rows = D.read_documents(spark.createDataFrame([(1, "a.html", html.encode())], "doc_id long, path string, content binary")).orderBy("page_number").collect()
    assert [(r.page_number, len(r.blocks)) for r in rows] == [(1, D.PER_PAGE), (2, D.PER_PAGE), (3, 1)]


@pytest.mark.parametrize("seed", range(6))
def test_text_pages_by_themselves(seed, monkeypatch):
    """Any range of pages gives what the whole gives; each paragraph once, on the page where it begins."""
    monkeypatch.setattr(D, "TEXT_PAGE", 40)
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "two words", "\n", "\n\n", " \n", "\r\n", "é", "x" * 50, "\n \t\n"]) for _ in range(120)).encode()
    pages = D.page_count("a.txt", None, len(text))
    whole = list(D.text_pages(io.BytesIO(text), 1, pages))
    assert [n for n, _ in whole] == list(range(1, pages + 1))
    import re

    want = [" ".join(p.split()) for p in re.split(r"\n[^\S\n]*(?:\n[^\S\n]*)*\n|\A\s*\n|\n\s*\Z", text.decode().replace("\r\n", "\n")) if p and p.strip()]
    assert [e.text for _, own in whole for e in own] == want
    for _ in range(20):
        a = rng.randint(1, pages)
        b = rng.randint(a, pages)
        got = list(D.text_pages(io.BytesIO(text), a, b))
        assert [(n, [e.text for e in own]) for n, own in got] == [(n, [e.text for e in own]) for n, own in whole[a - 1 : b]]


def epub(n):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{i}" href="c{i}.xhtml"/>' for i in range(n))
        z.writestr("p.opf", f"<package><manifest>{items}</manifest><spine>{''.join(f'<itemref idref={chr(34)}c{i}{chr(34)}/>' for i in range(n))}</spine></package>")
        for i in range(n):
            z.writestr(f"c{i}.xhtml", f"<h2>Chapter {i}</h2>" + "<p>some words</p>" * 2000)
    return buffer.getvalue()


class Counted:
    """A file that counts what is read of it."""

    def __init__(self, f, counts, path):
        self.f, self.counts, self.path = f, counts, path

    def read(self, *n):
        got = self.f.read(*n)
        self.counts[self.path] = self.counts.get(self.path, 0) + len(got)
        return got

    def readline(self, *n):
        got = self.f.readline(*n)
        self.counts[self.path] = self.counts.get(self.path, 0) + len(got)
        return got

    def __getattr__(self, name):
        return getattr(self.f, name)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.epub").write_bytes(epub(40))
    (tmp_path / "in" / "deep" / "b.txt").write_text("\n\n".join(f"paragraph {i} " + "word " * 100 for i in range(2000)))
    (tmp_path / "in" / "c.html").write_text("<p>one</p>")
    (tmp_path / "in" / "torn.epub").write_bytes(b"torn")
    (tmp_path / "in" / "d.pdf").write_bytes(b"%PDF")
    return str(tmp_path / "in")


def test_a_range_of_pages_opens_what_it_needs(folder, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThanOrEqual

    monkeypatch.setattr(D, "PARTITION", 200_000)
    counts = {}
    own = D._open
    monkeypatch.setattr(D, "_open", lambda path: Counted(io.BytesIO(own(path).read()), counts, path.rpartition("/")[2]))

    def run(*filters):
        reader = D.DocumentsReader(folder)
        left = list(reader.pushFilters(list(filters)))
        parts = reader.partitions()
        counts.clear()
        return left, len(parts), sorted((p.rpartition("/")[2], n) for part in parts for p, n, _ in reader.read(part)), dict(counts)

    left, parts, pages, whole = run()
    assert left == [] and len(pages) == 40 + 16 + 1 and parts > 8
    null = IsNotNull(("page_number",))
    left, parts, pages, some = run(GreaterThanOrEqual(("page_number",), 7), LessThanOrEqual(("page_number",), 8), null)
    assert left == [null] and pages == [("a.epub", 7), ("a.epub", 8), ("b.txt", 7), ("b.txt", 8)]
    assert some["b.txt"] < whole["b.txt"] / 5 and some["a.epub"] < whole["a.epub"] / 5
    assert run(EqualTo(("page_number",), 1))[2] == [("a.epub", 1), ("b.txt", 1), ("c.html", 1)]
    assert run(In(("page_number",), (39, 2, 99)))[2] == [("a.epub", 2), ("a.epub", 39), ("b.txt", 2)]
    assert run(EqualTo(("page_number",), 0))[2] == []


def test_load(spark, folder):
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        whole = D.load(spark, folder)
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        same = D.read_documents(files.select(F.xxhash64(F.regexp_replace("path", "^file:/+", "/")).alias("doc_id"), "path", "content"))
        key = lambda d: sorted((r.doc_id, r.page_number, [b.text for b in r.blocks]) for r in d.collect())
        want = key(same)
        assert key(whole) == want and len(want) == 57
        some = D.load(spark, folder, 3, 4)
        assert key(some) == [x for x in want if x[1] in (3, 4)]
        assert spark.read.format("documents").load(folder).where("page_number = 3").rdd.getNumPartitions() == 3
    finally:
        spark.conf.set(name, before)
