"""Situations of pages, worked out by hand."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions.normalise import nfkc_columns
from pagewright.operators import links, ocr, pages, render, spatial, tables
from pagewright.schema import BOX, FRAGMENT, RAW_PAGE, RECT, RUN
from pagewright.sources import catalog, docx, readers
from pagewright.streaming.store import Store


def span(text, x0, y0, x1, y1, size=10.0, font="Serif", flags=0):
    return (text, size, font, flags, [float(x0), float(y0), float(x1), float(y1)])


def block(lines, bbox, kind=0):
    return (kind, [float(v) for v in bbox], [(s,) for s in lines])


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def arr(rows, ddl):
    """A literal array of structs or strings from JSON."""
    import json

    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), f"array<{ddl}>")


@pytest.fixture(scope="module")
def extracted(spark):
    b = [
        block([[span("8 Chapter One", 50, 20, 200, 30)]], (50, 20, 200, 30)),
        block([[span("Big Title", 50, 100, 300, 120, 20.0)]], (50, 100, 300, 120)),
        block([[span("Body text that is quite long. " * 8, 50, 130, 500, 200)]], (50, 130, 500, 200)),
        block([[span("plain ", 50, 210, 90, 220), span("bold", 90, 210, 120, 220, flags=16), span(" link", 120, 210, 150, 220)]], (50, 210, 150, 220)),
        block([[span("intro", 50, 225, 90, 230)], [span("► first", 50, 230, 150, 240)], [span("goes on", 50, 235, 99, 240)], [span("► second", 50, 240, 150, 250)]], (50, 225, 150, 250)),
        block([[span("Листинг 1 caption", 50, 260, 150, 270)]], (50, 260, 150, 270)),
        block([[span("  x = 1", 50, 280, 150, 290, font="Courier")], [span("  y = <2>", 50, 290, 150, 300, font="Courier")]], (50, 280, 150, 300)),
        block([], (50, 310, 150, 400), 1),
        block([[span("in table", 60, 420, 100, 430)]], (60, 420, 100, 430)),
        block([[span("also in it", 60, 440, 100, 450)]], (60, 440, 100, 450)),
        block([[span("boxed", 310, 420, 350, 430)]], (310, 420, 350, 430)),
        block([[span("СОВЕТ mind it", 50, 560, 150, 570)]], (50, 560, 150, 570)),
        block([[span("word", 50, 600, 90, 610), span("1", 90, 600, 93, 604, 6.0, flags=1)]], (50, 600, 93, 610)),
        block([[span("ﬁnal co-", 50, 620, 90, 630)], [span("operation", 50, 630, 90, 640)]], (50, 620, 90, 640)),
        block([[span("1 note text", 50, 770, 150, 780)]], (50, 770, 150, 780)),
        block([[span("2 running", 50, 780, 150, 790)]], (50, 780, 150, 790)),
    ]
    drawn = [(300.0, 410.0, 301.0, 500.0), (300.0, 410.0, 450.0, 411.0), (449.0, 410.0, 450.0, 500.0), (300.0, 499.0, 450.0, 500.0), (10.0, 5.0, 590.0, 6.0)]
    hrefs = [((118.0, 209.0, 152.0, 221.0), 2, "http://a.b", None)]
    found = [((50.0, 410.0, 290.0, 500.0), [["a", "", "b"], ["1", "", "2"], ["", "", "more"], ["3", "", "4"]]), ((40.0, 275.0, 160.0, 305.0), [["x", "y"], ["1", "2"]])]
    noise = [block([[span("\x01" * 30, 50, 100, 300, 120)]], (50, 100, 300, 120))]

    def seen(text, x0, y0, x1, y1):
        return ([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], text, 0.9)

    read = [seen("Tall heading", 100.0, 400.0, 700.0, 440.0)]
    read += [seen(f"line {i} of text", 100.0, 520.0 + 30 * i, 900.0, 540.0 + 30 * i) for i in range(4)] + [seen("ends here.", 100.0, 640.0, 500.0, 660.0), seen("Next one", 100.0, 670.0, 500.0, 690.0)]
    read += [seen("Contents", 100.0, 800.0, 400.0, 820.0), seen("41", 900.0, 801.0, 930.0, 819.0), seen("• item", 100.0, 830.0, 400.0, 850.0), seen("12 34 56 78", 100.0, 900.0, 400.0, 920.0)]
    df = spark.createDataFrame([(1, 1, 600.0, 800.0, b, drawn, hrefs, found, []), (1, 2, 600.0, 800.0, noise, [], [], [], read)], RAW_PAGE)
    return {r.page_number: r for r in pages.extract(df).collect()}


def kinds(r):
    return [(b.type, b.text) for b in r.blocks]


def test_text_path(extracted):
    r = extracted[1]
    assert r.margin == ["8", "Chapter One", "2", "running"] and r.callout == ["boxed", "СОВЕТ mind it"]
    assert kinds(r)[0] == ("h", "Big Title") and r.blocks[0].level == 2
    assert [(b.type, b.text, b.ordered) for b in r.blocks[3:6]] == [("p", "intro", None), ("li", "first goes on", False), ("li", "second", False)]
    assert kinds(r)[6:8] == [("p", "Листинг 1 caption"), ("code", "  x = 1\n  y = <2>")]
    assert [b.type for b in r.blocks].count("code") == 1 and [b.type for b in r.blocks][8] == "img_placeholder"
    t = [b for b in r.blocks if b.type == "table"]
    assert len(t) == 1 and t[0].rows == [["a", "b"], ["1", "2 more"], ["3", "4"]]
    assert [(x.text, x.bold, x.href) for x in r.blocks[2].runs] == [("plain ", False, None), ("bold", True, None), (" link", False, "http://a.b")]
    assert kinds(r)[-2:] == [("p", "final cooperation"), ("p", "1 note text")]
    assert any(x.superscript for b in r.blocks if b.runs for x in b.runs)


def test_ocr_path(extracted):
    got = [(b.type, b.text, b.level, b.ordered) for b in extracted[2].blocks]
    assert got[0] == ("h", "Tall heading", 2, None)
    assert got[1:3] == [("p", "line 0 of text line 1 of text line 2 of text line 3 of text ends here.", None, None), ("p", "Next one", None, None)]
    assert got[3:] == [("p", "Contents 41", None, None), ("li", "item", None, False), ("p_numeric", "12 34 56 78", None, None)]


def test_rows_split_at_columns(spark):
    items = arr([{"x0": x, "x1": x + 80, "y0": 0, "y1": 20, "text": t} for x, t in ((0, "a"), (90, "b"), (400, "c"), (490, "d"))], BOX)
    none = F.lit(None).cast("struct<left:double,right:double>")
    assert [r.text for r in value(spark, ocr.rows(items, none))] == ["a b", "c d"]
    near = arr([{"x0": 0, "x1": 80, "y0": 0, "y1": 20, "text": "left"}, {"x0": 95, "x1": 180, "y0": 2, "y1": 21, "text": "right"}], BOX)
    gutter = F.struct(F.lit(82.0).alias("left"), F.lit(94.0).alias("right"))
    assert [r.text for r in value(spark, ocr.rows(near, gutter))] == ["left", "right"]
    assert [r.text for r in value(spark, ocr.rows(near, none))] == ["left right"]


def test_images_among_paragraphs(spark):
    flow = F.array(*[F.struct(F.lit(float(y)).alias("y0"), F.lit(c).cast("int").alias("column"), F.lit(n).alias("block")) for y, c, n in ((10, 0, "a"), (30, 0, "b"), (5, 1, "c"))])
    images = F.array(*[F.struct(F.lit(float(y)).alias("y0"), F.lit(c).cast("int").alias("column"), F.lit(n).alias("block")) for y, c, n in ((20, 0, "I"), (30, 0, "J"), (1, 1, "K"))])
    assert value(spark, ocr.insert_images(flow, images)) == ["a", "I", "b", "J", "K", "c"]


def test_geometry(spark):
    r = lambda *v: dict(zip(("x0", "y0", "x1", "y1"), map(float, v)))
    boxes = arr([r(0, 0, 10, 1), r(50, 50, 60, 60), r(9, 1, 10, 20), r(12, 20, 30, 21)], RECT)
    assert [tuple(x) for x in value(spark, spatial.merge_touching(boxes))] == [(0, 0, 30, 21), (50, 50, 60, 60)]
    two = [r(50 + i % 2, 100 + 40 * i, 250, 130 + 40 * i) for i in range(4)] + [r(261, 100 + 40 * i, 460, 130 + 40 * i) for i in range(4)]
    assert tuple(value(spark, spatial.column_gap(arr(two, RECT), 4))) == (250.0, 261.0)
    one = [r(50 + 9 * i, 100 + 40 * i, 250, 130 + 40 * i) for i in range(6)]
    assert value(spark, spatial.column_gap(arr(one, RECT), 4)) is None


def test_tables(spark):
    raw = arr([["Name", None, "Size", ""], ["a", "", "1", ""], ["b", "", "2", "2"], ["", "", "x", ""], ["", "", "", ""]], "array<string>")
    assert value(spark, tables.clean_table(raw)) == [["Name", "Size", ""], ["a", "1", ""], ["b", "2 x", "2"]]
    split = arr([["ab", "", "c"], ["", "de", "f"]], "array<string>")
    assert value(spark, tables.merge_split_columns(split)) == [["ab", "c"], ["de", "f"]]


def test_phrases_are_chosen_by_their_own_scans(spark):
    known = arr([{"phrase": "ab", "href": "A"}, {"phrase": "bb", "href": "B"}], "struct<phrase:string,href:string>")
    run = F.struct(F.lit("abbb").alias("text"), *[F.lit(False).alias(c) for c in ("bold", "italic", "superscript")], F.lit(None).cast("string").alias("href")).cast(RUN)
    assert [(x.text, x.href) for x in value(spark, links.split_run(run, known))] == [("ab", "A"), ("bb", None)]
    assert value(spark, links.occurrences(F.lit("a.a.a.a"), F.lit("a."))) == [0, 2, 4]


def test_text_functions(spark):
    v = lambda c: value(spark, c)
    assert v(T.clean(F.lit("ﬁ① бо- лее a- b- c x\r\x02\n\t."))) == "fi1 более abc x\n\t."
    assert v(T.strip(F.lit("\xa0 a\t"))) == "a" and v(T.is_page_number(F.lit(" 12. "))) and not v(T.is_page_number(F.lit("12345")))
    assert [v(T.is_garbled(F.lit(t))) for t in ("\x01" * 19, "\x01" * 4 + "a" * 16, "\x01" * 5 + "a" * 15)] == [False, False, True]
    assert v(T.split_margin_number(F.lit("8 Head"))) == ["8", "Head"] and v(T.split_margin_number(F.lit("Head 9"))) == ["Head", "9"]
    assert v(T.guard_md(F.lit("12. x"))) == "12\\. x" and v(T.guard_md(F.lit("- x"))) == "\\- x"
    assert v(T.linkify_html(F.lit("a<b www.x.org). c"))) == 'a&lt;b <a href="https://www.x.org">www.x.org</a>). c'
    assert v(T.linkify_md(F.lit("see http://x.org/a_b, *c*"))) == "see [http://x.org/a_b](http://x.org/a_b), \\*c\\*"
    assert v(T.is_numeric_heavy(F.lit("12 ab 3456"))) and not v(T.is_numeric_heavy(F.lit("1 a")))
    assert v(T.tokens(F.lit("Ab_c12 Ёж-7"))) == ["ab", "c", "12", "ёж", "7"]


def test_columns_and_lists_in_html(spark):
    b = [("p", "a", None), ("li", "x", None), ("li", "y", None), ("p", "l", 0), ("p", "r", 1), ("p", "l2", 0), ("p", "z", None)]
    rows = [(1, 3, ["Head", "7"], [(t, x, None, False, None, None, None, None, None, c, None) for t, x, c in b], ["note"])]
    html = render.render_pages(spark.createDataFrame(rows, FRAGMENT), "html").first().body
    assert html.split("\n") == [
        '<section class="page" id="page-3">', '<p class="page-meta">Head · 7</p>', "<p>a</p>", "<ul>", "<li>x</li>", "<li>y</li>", "</ul>", '<div class="cols">', '<div class="col">', "<p>l</p>", "<p>l2</p>", "</div>",
        '<div class="col">', "<p>r</p>", "</div>", "</div>", "<p>z</p>", '<aside class="callout">', "<p>note</p>", "</aside>", "</section>",
    ]


def test_nfkc_of_nested_columns(spark):
    d = spark.createDataFrame([(["ﬁ", None], [("①", 1)]), (None, [])], "a array<string>, b array<struct<t:string,n:int>>")
    assert [tuple(r) for r in nfkc_columns(d.coalesce(1), ["a", "b"]).collect()] == [(["fi", None], [("1", 1)]), (None, [])]


PAGE_HTML = """<html><head><title>x</title></head><body><h1>The  Title</h1><p>Some <b>bold</b> and <a href="http://a.b">a link</a><sup>1</sup>
 in text.</p><ul><li>one<li>two</ul><ol><li>first</li></ol><pre>
  x = 1
  y &lt; 2
</pre><table><tr><th>a</th><th>b</th></tr><tr><td>1 </td><td>2</td></tr></table><img src="i.png"><script>no()</script>tail</body></html>"""


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + width.to_bytes(4, "big") + height.to_bytes(4, "big") + b"rest"


def test_caption_server(spark):
    """A server on this machine: its models, a caption, images it is never asked about, and a failure."""
    import base64
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from pagewright.operators import captions

    class Handler(BaseHTTPRequestHandler):
        def answer(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            self.answer({"data": [{"id": "eyes"}]})

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            content = base64.b64decode(asked["messages"][0]["content"][1]["image_url"]["url"].partition(",")[2])
            width = captions.png_sides(content)[0]
            self.answer({"choices": []} if width == 666 else {"choices": [{"message": {"content": f" {asked['model']} saw {width} "}}]})

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_address[1]}/"
        captions.Server(url, "eyes").check()
        for model in ("", "ears"):
            with pytest.raises(ValueError, match="eyes"):
                captions.Server(url, model).check()
        images = [(1, 1, i + 1, b) for i, b in enumerate((png(100, 50), png(31, 400), png(666, 40), b"no png", png(32, 32), b""))]
        made = captions.caption_images(spark.createDataFrame(images, "doc_id long, page_number int, image_no int, content binary"), captions.once_a_process("s", lambda: captions.Server(url, "eyes")))
        assert {r.image_no: r.caption for r in made.collect()} == {1: "eyes saw 100", 2: None, 3: None, 4: None, 5: "eyes saw 32"}
    finally:
        server.shutdown()
        server.server_close()
    with pytest.raises(ConnectionError):
        captions.Server(url, "eyes").check()
    loads = []
    for _ in range(2):
        captions.once_a_process("twice", lambda: loads.append(1) or len)()
    assert loads == [1]


def test_documents_that_flow(spark):
    from pagewright.sources import documents

    def zipped(**files):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for name, body in files.items():
                z.writestr(name.replace("__", "/").replace("_DOT_", "."), body)
        return buffer.getvalue()

    epub = zipped(
        META_INF__container_DOT_xml="", **{"META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>'},
        **{"OPS/p.opf": '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="b" href="two.xhtml"/><item id="a" href="one%20.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>', "OPS/one .xhtml": "<body><p>chapter one</p></body>", "OPS/two.xhtml": "<body><p>chapter two</p></body>"},
    )
    w = docx.WORDS[1:-1]
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:rPr><w:i/></w:rPr><w:t>slanted</w:t></w:r><w:r><w:rPr><w:b w:val="0"/></w:rPr><w:t xml:space="preserve"> plain</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c2</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>c3</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c4</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    word = zipped(**{"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>'})
    long = "\n\n".join(f"paragraph {i} " + "word " * 40 for i in range(60))
    files = [(1, "a.HTML", PAGE_HTML.encode()), (2, "b.epub", epub), (3, "c.docx", word), (4, "d.txt", long.encode()), (5, "e.pdf", b"%PDF"), (6, "f.epub", b"torn"), (7, "g.html", b""), (8, "h.txt", None)]
    got = {}
    for r in documents.read_documents(spark.createDataFrame(files, "doc_id long, path string, content binary")).orderBy("doc_id", "page_number").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sorted(got) == [1, 2, 3, 4, 7, 8]
    one = [(b.type, b.text) for b in got[1][0].blocks]
    assert one == [("h", "The Title"), ("p", "Some bold and a link1 in text."), ("li", "one"), ("li", "two"), ("li", "first"), ("code", "  x = 1\n  y < 2"), ("table", None), ("img", None), ("p", "tail")]
    runs = got[1][0].blocks[1].runs
    assert [(r.text, r.bold, r.superscript, r.href) for r in runs] == [("Some ", False, False, None), ("bold", True, False, None), (" and ", False, False, None), ("a link", False, False, "http://a.b"), ("1", False, True, None), (" in text.", False, False, None)]
    assert got[1][0].blocks[6].rows == [["a", "b"], ["1", "2"]] and got[1][0].blocks[4].ordered
    assert [[b.text for b in r.blocks] for r in got[2]] == [["chapter one"], ["chapter two"]]
    assert [(b.type, b.text, b.level) for b in got[3][0].blocks] == [("h", "Head", 1), ("p", "slanted plain", None), ("li", "item", None), ("table", None, None)] and got[3][0].blocks[3].rows == [["c1", "c2"], ["c3", "c4"]]
    assert [r.italic for r in got[3][0].blocks[1].runs] == [True, False]
    assert len(got[4][0].blocks) == 60 and " ".join(b.text for r in got[4] for b in r.blocks).split() == long.split()
    assert [len(got[n][0].blocks) for n in (7, 8)] == [0, 0]


def test_image_names(spark):
    """Images count from 1 on each page, those too small to draw too, on either path."""
    small, large = block([], (50, 100, 50.5, 100.5), 1), block([], (50, 310, 150, 400), 1)
    text, noise = block([[span("words", 50, 130, 500, 200)]], (50, 130, 500, 200)), block([[span("\x01" * 30, 50, 130, 300, 150)]], (50, 130, 300, 150))
    df = spark.createDataFrame([(7, n, 600.0, 800.0, [small, own, large, large], [], [], [], []) for n, own in ((1, text), (2, noise))], RAW_PAGE)
    for r in pages.extract(df, "images").collect():
        assert [b.src for b in r.blocks if b.type == "img"] == [f"images/7/image_{r.page_number:04d}_{i:04d}.png" for i in (2, 3)]


def test_captions(spark):
    f = spark.createDataFrame([(1, 2, [], [("img", None, None, None, None, None, "images/1/image_0002_0000.png", "", None, None, None), ("p", "t", *[None] * 9), ("img_placeholder", *[None] * 10)], [])], FRAGMENT)
    c = spark.createDataFrame([(1, 2, 1, "A <cat>"), (1, 2, 2, "dog"), (1, 2, 7, "none"), (2, 2, 1, "other"), (1, 2, 2, None)], "doc_id long, page_number int, image_no int, caption string")
    from pagewright.operators import captions

    row = captions.with_captions(f, c).first()
    assert [(b.type, b.alt, b.caption) for b in row.blocks] == [("img", "A <cat>", None), ("p", None, None), ("img_placeholder", None, "dog")]
    assert captions.with_captions(f, c.where("false")).first().blocks == f.first().blocks
    images = spark.createDataFrame([(1, 2, 0, b"png"), (1, 2, 1, b""), (1, 3, 0, None)], "doc_id long, page_number int, image_no int, content binary")
    made = captions.caption_images(images, lambda: lambda bodies: [f"{len(b)} bytes" for b in bodies])
    assert [tuple(r) for r in made.collect()] == [(1, 2, 0, "3 bytes")]


def test_nfkc_composes(spark):
    """As Python's own normalisation: composed, decomposed, compatibility and Hangul letters, nulls and plain text."""
    import unicodedata

    texts = ["é", "e\u0301", "ﬁ①é", "한", "ｶﾞ", "plain", None, "", "Å\u0323 ok", "plain"]
    d = spark.createDataFrame([([t], t) for t in texts], "a array<string>, b string").coalesce(1)
    want = [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    assert [(r.a[0], r.b) for r in nfkc_columns(d, ["a", "b"]).collect()] == list(zip(want, want))


def test_docx(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="{docx.RELATIONS[1:-1]}"><Relationship Id="r1" Target="http://a" TargetMode="External"/><Relationship Id="r2" Target="#b"/></Relationships>')
        link = '<w:hyperlink r:id="{}"><w:r><w:t>{}</w:t></w:r></w:hyperlink>'
        z.writestr("word/document.xml", f'<w:document xmlns:w="{docx.WORDS[1:-1]}" xmlns:r="{docx.OFFICE[1:-1]}">{link.format("r1", "my site")}{link.format("r2", "inner")}</w:document>')
    files = spark.createDataFrame([("a.DOCX", buffer.getvalue()), ("b.docx", b"torn"), ("c.pdf", buffer.getvalue())], "path string, content binary")
    assert [tuple(r) for r in docx.docx_hyperlinks(files).collect()] == [("a.DOCX", "my site", "http://a")]


def test_store_resume_and_torn_fragments(spark, tmp_path):
    from pagewright.streaming import incremental

    rows = [(1, p, [], [], []) for p in (1, 4)]
    for fmt in ("parquet", "json"):
        store = str(tmp_path / fmt)
        readers.write_fragments(spark.createDataFrame(rows, FRAGMENT), store, fmt=fmt)
        assert len(list((tmp_path / fmt).glob("bucket=*"))) == 1
        (tmp_path / fmt / f"torn.{fmt}").write_text('{"page_number":2,"mar')
        kept = readers.read_fragments(spark, store, fmt)
        wanted = spark.createDataFrame([(1, p) for p in range(1, 6)], "doc_id long, page_number int")
        assert sorted(r.page_number for r in incremental.remaining(wanted, kept).collect()) == [2, 3, 5]
    assert incremental.restart(kept, 1, 1, 3).count() == 1
    done = spark.createDataFrame([(1, 2), (2, 1)], "doc_id long, page_count int")
    assert [r.doc_id for r in incremental.finished(kept, done).collect()] == [1]
    with pytest.raises(ValueError):
        readers.page_range(wanted, 3, 2)


def raw(doc_id, number, text="words on a page"):
    return (doc_id, number, 600.0, 800.0, [block([[span(text, 50, 100, 300, 120)]], (50, 100, 300, 120))], [], [], [], [])


def test_extract_remaining_clean_up_and_rewrite(spark, tmp_path):
    from pagewright.streaming import incremental

    pages_ = spark.createDataFrame([raw(1, 1), raw(1, 2), raw(2, 1)], RAW_PAGE)
    store = Store(spark, str(tmp_path / "store"))
    assert store.read().count() == 0
    assert incremental.extract_remaining(pages_.where("doc_id = 1"), store) == 2
    assert incremental.extract_remaining(pages_, store) == 1
    assert incremental.extract_remaining(pages_, store) == 0
    keys = lambda: sorted((r.doc_id, r.page_number) for r in store.read().collect())
    assert keys() == [(1, 1), (1, 2), (2, 1)]
    store.rewrite(lambda f: incremental.restart(f, 1, 2, 9))
    assert keys() == [(1, 1), (2, 1)] and incremental.extract_remaining(pages_, store) == 1
    incremental.clean_up(store, spark.createDataFrame([(1, 2), (2, 5)], "doc_id long, page_count int"))
    assert keys() == [(2, 1)] and len(list((tmp_path / "store" / "batches").iterdir())) == 1


def test_identity_and_settings(spark):
    import datetime

    from pagewright.streaming import incremental

    t = datetime.datetime(2020, 1, 1)
    state = spark.createDataFrame([(1, "/a", 10, t, "plain"), (2, "/b", 20, t, "images")], incremental.STATE)
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, path string, size long, mtime timestamp")
    assert incremental.check_identity(docs((1, "/a", 10, t), (3, "/new", 1, t)), state).count() == 2
    for other in ((1, "/c", 10, t), (1, "/a", 11, t), (1, "/a", 10, t + datetime.timedelta(1))):
        with pytest.raises(Exception, match="another file"):
            incremental.check_identity(docs(other), state).collect()
    assert [(r.doc_id, r.was) for r in incremental.changed_settings(state, "plain").collect()] == [(2, "images")]


def test_stream_replays_and_renders(spark, tmp_path):
    """Pages that come late and out of order; a batch done twice; documents rendered after their first page and each second."""
    from pagewright.streaming import incremental

    incoming, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    titles = spark.createDataFrame([(1, "One"), (2, "Two")], "doc_id long, title string")
    out, due = [], []
    publish = lambda d: out.append({r.doc_id: r.content for r in d.collect()})
    late = lambda d: due.append(sorted(r.doc_id for r in d.collect()))

    def after(made, number):
        incremental.render_changed(store, titles, "txt", publish)(made, number)
        incremental.render_changed(store, titles, "txt", late, every=2)(made, number)

    for rows in ([raw(1, 3, "third"), raw(2, 1, "lone")], [raw(1, 1, "first")], [raw(2, 2, "more"), raw(2, 3, "end")]):
        spark.createDataFrame(rows, RAW_PAGE).coalesce(1).write.mode("append").json(str(incoming))
        incremental.stream_fragments(spark, str(incoming), store, str(tmp_path / "check"), after).awaitTermination()
    assert [sorted(x) for x in out] == [[1, 2], [1], [2]]
    assert out[1][1].index("first") < out[1][1].index("third")
    assert due == [[1, 2], [1], [2]]
    last = store.batches()[-1]
    assert not store.append(store.batch(last), last.partition(".")[2]) and store.read().count() == 5 and store.batch(last).count() == 2


def test_rendering_is_due_with_the_first_page_and_each_tenth(spark):
    from pagewright.streaming import incremental

    f = lambda *pages_: spark.createDataFrame([(1, p) for p in pages_], "doc_id long, page_number int")
    runs = [((1,), (1,), True), ((1, 2), (2,), False), (range(1, 10), (9,), False), (range(1, 11), (10,), True), (range(1, 13), (9, 10, 11, 12), True), (range(1, 14), (13,), False)]
    assert [incremental.due(f(*all_), f(*new)).count() == 1 for all_, new, _ in runs] == [x for *_, x in runs]


def test_document_and_image_sinks(spark, tmp_path):
    d = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, content string")
    readers.write_documents(d, str(tmp_path / "docs"), buckets=8)
    assert len(list((tmp_path / "docs").glob("bucket=*"))) == 8
    assert spark.read.parquet(str(tmp_path / "docs")).select("doc_id", "content").exceptAll(d).count() == 0
    assert readers.write_document_files(d.limit(5), str(tmp_path / "files"), "txt", buckets=2).count() == 5
    assert sorted(p.read_text() for p in (tmp_path / "files").glob("[01]/*.txt")) == [f"text {i}" for i in range(5)]
    images = spark.createDataFrame([(7, 1, 0, b"png"), (7, 1, 1, b""), (7, 12, 0, None), (8, 2, 3, b"other")], "doc_id long, page_number int, image_no int, content binary")
    found = sorted(tuple(r) for r in readers.write_images(images, str(tmp_path / "img")).collect())
    assert found == [("7/image_0001_0000.png", 3), ("8/image_0002_0003.png", 5)]
    assert sorted(p.name for p in (tmp_path / "img").rglob("*") if p.is_file()) == ["image_0001_0000.png", "image_0002_0003.png"]
    assert (tmp_path / "img" / "8" / "image_0002_0003.png").read_bytes() == b"other"


class Answer(io.BytesIO):
    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


class Http:
    def __init__(self, body):
        self.body, self.asked = body, []

    def open(self, request, timeout):
        self.asked.append((request.full_url, timeout))
        return Answer(self.body)


def test_http_source_and_download_sink(tmp_path):
    http = Http(b'{"id": 5}')
    assert catalog.fetch_json(http, "https://a.example/5") == {"id": 5} and http.asked == [("https://a.example/5", 15)]
    with pytest.raises(ValueError):
        catalog.fetch(http, "https://a.example/5", most=3)
    to = tmp_path / "book"
    assert catalog.download(http, "https://a.example/b", to) and to.read_bytes() == http.body
    assert not catalog.download(http, "https://a.example/b", to) and len(http.asked) == 3
    broken = Http(b"")
    broken.open = lambda *_, **__: (_ for _ in ()).throw(OSError("gone"))
    with pytest.raises(OSError):
        catalog.download(broken, "https://a.example/c", tmp_path / "torn")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["book"]


def test_redirects_stay_on_the_list():
    import urllib.request

    guard = next(h for h in catalog.opener({"a.example"}).handlers if type(h).__name__ == "Guard")
    request = urllib.request.Request("https://a.example/1")
    assert guard.redirect_request(request, None, 302, "", {}, "https://a.example/2").full_url == "https://a.example/2"
    for bad in ("http://a.example/2", "https://b.example/2", "https://a.example:8443/2", "file:///etc/passwd"):
        with pytest.raises(PermissionError):
            guard.redirect_request(request, None, 302, "", {}, bad)


def test_catalogue(spark, tmp_path):
    with pytest.raises(ValueError):
        catalog.output_path(tmp_path, "../x")
    books = spark.createDataFrame([(i, f"T{i}", [True, False, None][i % 3]) for i in range(30)], "id long, title string, copyright boolean")
    bare = books.withColumn("authors", F.array(F.struct(F.lit("A").alias("name")))).withColumn("languages", F.array()).withColumn("download_count", F.lit(1))
    for asked in ({"years": (1900, None)}, {"topic": "x"}):
        with pytest.raises(ValueError):
            catalog.search(bare, **asked)
    assert [r.attempt for r in catalog.random_books(books, 4, 1).orderBy("attempt").collect()] == [1, 2, 3, 4]
    assert {r.id % 3 for r in catalog.random_books(books, 10, 1).collect()} == {1}
