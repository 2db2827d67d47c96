"""The text path: a raw page's positioned spans, drawings, links and detected tables to a fragment of typed blocks.

A page is one row and stays one: all joins, folds and classifications are expressions over its
arrays, so extraction scans, projects and writes, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import text as T
from pagewright.functions.steps import bind, deep_folds, once
from pagewright.functions.normalise import nfkc_columns
from pagewright.operators import spatial, table_finder, tables
from pagewright.schema import BLOCK, BOLD, ITALIC, LIMITS, RUN, SUPERSCRIPT


def _flag(span: Column, bit: int) -> Column:
    return span["flags"].bitwiseAND(F.lit(bit)) != 0


def _joined(values: Column, by: str = "") -> Column:
    return F.array_join(values, by)


def line_texts(block: Column) -> Column:
    return F.transform(block["lines"], lambda line: _joined(F.transform(line["spans"], lambda s: F.coalesce(s["text"], F.lit("")))))


def raw_text(block: Column) -> Column:
    """Lines that aren't blank, joined by blanks."""
    return F.coalesce(_joined(F.filter(line_texts(block), lambda t: ~T.blank(t)), " "), F.lit(""))


def code_text(block: Column) -> Column:
    """All lines, as they are."""
    return F.coalesce(_joined(line_texts(block), "\n"), F.lit(""))


def spans(block: Column) -> Column:
    return F.flatten(F.transform(block["lines"], lambda line: line["spans"]))


def text_blocks(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["type"] == 0)


def superscript_markers(blocks: Column) -> Column:
    """Digits set as superscripts anywhere on a page: marks of its footnotes."""
    all_ = F.flatten(F.transform(text_blocks(blocks), spans))
    marked = F.filter(all_, lambda s: _flag(s, SUPERSCRIPT) & T.strip(s["text"]).rlike(r"(?U)^\d+$"))
    return F.array_distinct(F.transform(marked, lambda s: T.strip(s["text"])))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def font_stats(block: Column) -> Column:
    """struct(size, bold): the mean size and the share of bold, both by characters; 0 without any."""
    own = spans(block)
    total = _sum(F.transform(own, lambda s: F.length(s["text"]).cast("double")))
    size = _sum(F.transform(own, lambda s: F.length(s["text"]) * s["size"]))
    bold = _sum(F.transform(own, lambda s: F.when(_flag(s, BOLD), F.length(s["text"])).otherwise(0).cast("double")))
    return F.struct(F.when(total > 0, size / total).otherwise(0.0).alias("size"), F.when(total > 0, bold / total).otherwise(0.0).alias("bold"))


def _heaviest(items: Column, key: str) -> Column:
    """Of structs (key, n): that key with the greatest sum of n, the first seen of equal ones, as struct(n, i, key); null without items."""

    def best(own: Column) -> Column:
        keys = F.array_distinct(F.transform(own, lambda x: x[key]))
        total = lambda k: F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + F.when(x[key] == k, x["n"]).otherwise(0))
        return F.array_max(F.transform(keys, lambda k, i: F.struct(total(k).alias("n"), (-i).alias("i"), k.alias("key"))))

    return bind(items, best)


def dominant_font(block: Column) -> Column:
    own = F.filter(spans(block), lambda s: ~T.blank(s["text"]))
    return F.coalesce(_heaviest(F.transform(own, lambda s: F.struct(s["font"].alias("font"), F.length(s["text"]).alias("n"))), "font")["key"], F.lit(""))


def body_size(blocks: Column, height: Column) -> Column:
    """The size, to a tenth, of most characters outside the margins; null if they are fewer than 200."""
    body = F.filter(text_blocks(blocks), lambda b: ~T.in_margin_zone(b["bbox"][1], b["bbox"][3], height))
    own = F.filter(F.flatten(F.transform(body, spans)), lambda s: ~T.blank(s["text"]))
    best = _heaviest(F.transform(own, lambda s: F.struct(F.round(s["size"], 1).alias("size"), F.length(s["text"]).alias("n"))), "size")
    return F.when(best["n"] >= LIMITS.body_chars, best["key"])


def styled_runs(block: Column, links: Column) -> Column:
    """Spans as runs of one style and link, a plain blank between lines; neighbours of one style join. Null where all is plain."""

    def run(s: Column) -> Column:
        hit = spatial.first_cover(G.from_array(s["bbox"]), links, lambda x: x["rect"])
        return F.struct(
            s["text"].alias("text"), _flag(s, BOLD).alias("bold"), _flag(s, ITALIC).alias("italic"), _flag(s, SUPERSCRIPT).alias("superscript"), F.get(links, hit)["href"].alias("href")
        ).cast(RUN)

    plain = F.struct(F.lit(" ").alias("text"), *[F.lit(False).alias(n) for n in ("bold", "italic", "superscript")], F.lit(None).cast("string").alias("href")).cast(RUN)
    lines = F.filter(block["lines"], lambda line: ~T.blank(_joined(F.transform(line["spans"], lambda s: s["text"]))))
    each = F.transform(lines, lambda line, i: F.concat(F.when(i > 0, F.array(plain)).otherwise(F.array().cast(f"array<{RUN}>")), F.transform(F.filter(line["spans"], lambda s: F.length(s["text"]) > 0), run)))
    return emphasis(F.flatten(each))


def emphasis(runs: Column) -> Column:
    """Neighbouring runs of one style joined and cleaned, empty ones dropped; null where all is plain and unlinked.

    A run is copied once into the longer one that it is part of, however many there are.
    """
    style = ("bold", "italic", "superscript", "href")

    def same(x: Column, y: Column) -> Column:
        found = F.lit(True)
        for n in style:
            found = found & x[n].eqNullSafe(y[n])
        return found

    def joined(own: Column) -> Column:
        turns = F.array_compact(F.transform(own, lambda x, i: F.when((i == 0) | ~same(x, F.get(own, i - 1)), i)))
        return bind(turns, lambda at: F.transform(at, lambda a, j: longer(own, a, F.coalesce(F.get(at, j + 1), F.size(own)))))

    def longer(own: Column, begin: Column, end: Column) -> Column:
        text = F.array_join(F.transform(F.slice(own, begin + 1, end - begin), lambda x: x["text"]), "")
        return F.struct(T.clean_code(text, False).alias("text"), *[F.get(own, begin)[n].alias(n) for n in style])

    styled = lambda own: F.exists(own, lambda r: r["bold"] | r["italic"] | r["superscript"] | r["href"].isNotNull())
    return bind(runs, lambda own: F.when(styled(own), F.filter(joined(own), lambda r: F.length(r["text"]) > 0)))


def list_items(lines: Column) -> Column:
    """A block's lines, two or more with list markers, as array<struct<text, ordered>>; a first part without a marker has ordered null. Else null.

    Lines that follow a marker's line go on in its item.
    """
    own = F.filter(F.transform(lines, T.strip), lambda t: t != "")
    marked = F.transform(own, lambda t: F.struct(t.alias("text"), T.list_item(t).alias("m")))

    def item(all_: Column, begin: Column, end: Column) -> Column:
        first = F.get(all_, begin)
        more = F.transform(F.slice(all_, begin + 2, end - begin - 1), lambda x: x["text"])
        text = F.array_join(F.concat(F.array(F.coalesce(first["m"]["item"], first["text"])), more), " ")
        return F.struct(text.alias("text"), first["m"]["ordered"].alias("ordered")).cast("struct<text:string,ordered:boolean>")

    def items(all_: Column) -> Column:
        turns = F.array_compact(F.transform(all_, lambda x, i: F.when((i == 0) | x["m"].isNotNull(), i)))
        return bind(turns, lambda at: F.transform(at, lambda a, j: item(all_, a, F.coalesce(F.get(at, j + 1), F.size(all_)))))

    return bind(marked, lambda all_: F.when(F.size(F.filter(all_, lambda x: x["m"].isNotNull())) >= 2, items(all_)))


def caption_parity(candidates: Column) -> Column:
    """Of booleans that a block would be a listing's caption: struct(caption, code) for each.

    The block after a caption is code, whatever it would be; so, in a run of candidates, every other one is a caption.
    """

    def step(acc: Column, c: Column) -> Column:
        """places so far; a candidate's is one more than the one before it, from 1; 0 for what is none."""
        return F.concat(acc, F.array(F.when(c, F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + 1).otherwise(0)))

    places = F.aggregate(candidates, F.array().cast("array<int>"), step)
    bound = F.transform(F.array(places), lambda own: F.transform(own, lambda p, i: F.struct((p % 2 == 1).alias("caption"), F.coalesce(F.get(own, i - 1) % 2 == 1, F.lit(False)).alias("code"))))
    return F.element_at(bound, 1)


def block(kind: str, **fields: Column) -> Column:
    """A BLOCK of this type, other fields null."""
    parts = []
    for spec in ("text:string", "level:int", "ordered:boolean", f"runs:array<{RUN}>", "rows:array<array<string>>", "src:string", "alt:string", "caption:string", "column:int", "indent_em:double"):
        name, _, ddl = spec.partition(":")
        parts.append(fields.get(name, F.lit(None)).cast(ddl).alias(name))
    return F.struct(F.lit(kind).alias("type"), *parts).cast(BLOCK)


def _page_context(pages: DataFrame) -> DataFrame:
    """What a page's blocks are judged by, each made once."""
    d = once(pages, "blocks", F.filter("blocks", lambda b: b["type"].isin(0, 1)))
    images = F.transform(F.filter("blocks", lambda b: b["type"] == 1), lambda b: G.from_array(b["bbox"]))
    d = once(d, "hrefs", spatial.page_links(F.coalesce("links", F.array().cast(pages.schema["links"].dataType))))
    d = once(d, "markers", superscript_markers(F.col("blocks")))
    d = once(d, "body", body_size(F.col("blocks"), F.col("height")))
    info = F.transform(
        "blocks",
        lambda b: F.struct(b.alias("b"), (b["type"] == 0).alias("is_text"), G.from_array(b["bbox"]).alias("rect"), T.clean(raw_text(b), False).alias("text"), T.is_monospace(dominant_font(b)).alias("mono"), font_stats(b).alias("font")),
    )
    d = once(d, "info", info)
    # neither a table nor a callout box over a monospaced or listing block is one
    code = lambda r: F.exists("info", lambda x: x["is_text"] & G.covered(x["rect"], r, LIMITS.covered) & (x["mono"] | T.is_listing_caption(x["text"])))
    boxes = spatial.callout_boxes(F.coalesce("drawings", F.array().cast(pages.schema["drawings"].dataType)), images, F.col("width"))
    d = once(d, "callouts", F.filter(boxes, lambda r: ~code(r)))
    found = F.transform(F.coalesce("raw_tables", F.array().cast(pages.schema["raw_tables"].dataType)), lambda t: F.struct(t["bbox"].alias("rect"), tables.clean_table(t["rows"]).alias("rows")))
    return once(d, "tables", F.filter(found, lambda t: tables.is_table(t["rows"]) & ~code(t["rect"])))


def extract_text_pages(pages: DataFrame, images_dir: str | None = None) -> DataFrame:
    """Fragments of RAW_PAGE rows whose text layer is sound (normalised already, see extract).

    images_dir: where images are saved under their document's number, named by page and place among its images, from 1; null leaves placeholders.
    """
    d = _page_context(pages)

    def judge(x: Column) -> Column:
        hit = F.when(x["is_text"], spatial.first_cover(x["rect"], F.col("tables"), lambda t: t["rect"]))
        boxed = spatial.is_covered(x["rect"], F.col("callouts"))
        return bind(list_items(F.transform(line_texts(x["b"]), lambda t: T.clean(t, False))), lambda items: judged(x, hit, boxed, items))

    def judged(x: Column, hit: Column, boxed: Column, items: Column) -> Column:
        margin = T.is_margin_text(x["rect"]["y0"], x["rect"]["y1"], F.col("height"), x["text"])
        number = F.regexp_extract(x["text"], T.FOOTNOTE, 1)
        note = (number != "") & F.array_contains("markers", number)
        plain = x["is_text"] & hit.isNull() & ~x["mono"] & ~boxed & items.isNull() & ~T.blank(x["text"]) & ~(margin & ~note) & ~T.is_note(x["text"])
        return F.struct(
            x["b"].alias("b"), x["is_text"].alias("is_text"), x["text"].alias("text"), x["mono"].alias("mono"), x["font"].alias("font"), x["rect"].alias("rect"),
            hit.alias("hit"), boxed.alias("boxed"), items.alias("items"), (margin & ~note).alias("margin"), (plain & T.is_listing_caption(x["text"])).alias("candidate"),
        )

    d = once(d, "judged", F.transform("info", judge)).drop("info")
    d = once(d, "parity", caption_parity(F.transform("judged", lambda x: x["candidate"])))
    d = once(d, "hits", F.transform("judged", lambda x: x["hit"]))
    none = F.array().cast(f"array<{BLOCK}>")
    # how many images come before a block
    before = F.aggregate("judged", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.when(x["is_text"], 0).otherwise(1))))
    d = once(d, "images_before", before)

    def blocks_of(x: Column, i: Column) -> Column:
        p = F.get(F.col("parity"), i)
        text = x["text"]
        name = F.format_string("image_%04d_%04d.png", F.col("page_number"), F.get(F.col("images_before"), i) + 1)
        src = F.concat(F.lit(f"{images_dir}/"), F.col("doc_id").cast("string"), F.lit("/"), name)
        image = block("img", src=src, alt=F.lit("")) if images_dir else block("img_placeholder")
        drawn = (G.width(x["rect"]) >= 1) & (G.height(x["rect"]) >= 1)
        level = T.heading_level(text, x["font"]["size"], x["font"]["bold"], F.col("body"))
        item = T.list_item(T.strip(text))
        runs = styled_runs(x["b"], F.col("hrefs"))
        split = F.transform(F.filter(x["items"], lambda t: ~T.blank(t["text"])), lambda t: F.when(t["ordered"].isNull(), block("p", text=t["text"])).otherwise(block("li", text=t["text"], ordered=t["ordered"])))
        code = T.clean_code(code_text(x["b"]), False)
        return (
            F.when(~x["is_text"], F.when(drawn, F.array(image)).otherwise(none))
            .when(x["hit"].isNotNull(), F.when(F.array_position(F.col("hits"), x["hit"]) == i + 1, F.array(block("table", rows=F.get(F.col("tables"), x["hit"])["rows"]))).otherwise(none))
            .when(x["mono"] | p["code"], F.when(~T.blank(code), F.array(block("code", text=code))).otherwise(none))
            .when(x["boxed"], none)
            .when(x["items"].isNotNull(), split)
            .when(T.blank(text) | x["margin"] | T.is_note(text), none)
            .when(p["caption"], F.array(block("p", text=text)))
            .when(level.isNotNull(), F.array(block("h", text=T.strip(text), level=level)))
            .when(item.isNotNull(), F.array(block("li", text=item["item"], ordered=item["ordered"], runs=runs)))
            .otherwise(F.array(block("p", text=text, runs=runs)))
        )

    def aside(x: Column, i: Column) -> Column:
        """margin, callout or neither of a text block that neither a table nor code takes."""
        p = F.get(F.col("parity"), i)
        free = x["is_text"] & x["hit"].isNull() & ~x["mono"] & ~p["code"] & ~T.blank(x["text"])
        return F.when(free & x["boxed"], "callout").when(free & x["items"].isNull() & x["margin"], "margin").when(free & x["items"].isNull() & T.is_note(x["text"]), "callout")

    sides = F.transform("judged", lambda x, i: F.struct(aside(x, i).alias("side"), x["text"].alias("text")))
    d = once(d, "sides", sides)
    margin = F.flatten(F.transform(F.filter("sides", lambda s: s["side"] == "margin"), lambda s: T.split_margin_number(s["text"])))
    callout = F.transform(F.filter("sides", lambda s: s["side"] == "callout"), lambda s: s["text"])
    # what explodes blocks asks for their number first, which would make them twice
    d = once(d, "blocks", F.flatten(F.transform("judged", blocks_of)))
    return d.select("doc_id", "page_number", margin.alias("margin"), "blocks", callout.alias("callout"))


def raw_page_text(blocks: Column) -> Column:
    """A page's whole text as it was read, for the test whether it is garbled."""
    return F.coalesce(_joined(F.transform(text_blocks(blocks), raw_text)), F.lit(""))


def extract(pages: DataFrame, images_dir: str | None = None, aligned: bool = False) -> DataFrame:
    """Fragments of RAW_PAGE rows: garbled text layers take the OCR path, all others the text path.

    Tables of sound pages are found where raw_tables is null: ruled ones and, if `aligned`, those that white space alone makes.
    """
    from pagewright.operators import ocr

    with deep_folds(pages.sparkSession):
        d = pages.withColumn("garbled", T.is_garbled(raw_page_text(F.col("blocks"))))
        sound = table_finder.find_tables(d.where("not garbled").drop("garbled"), aligned)
        text = extract_text_pages(nfkc_columns(sound, ["blocks", "raw_tables"]), images_dir)
        return text.unionByName(ocr.extract_ocr_pages(nfkc_columns(d.where("garbled").drop("garbled"), ["ocr"]), images_dir))
