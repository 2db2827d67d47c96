"""The OCR path: detections of text on a page, in pixels at 300 dpi, to rows, paragraphs and blocks.

Rows and paragraphs depend on the order of what came before, so they are folds; Arrow functions take them a
step at a time over all pages of a batch (row_folds). The recogniser itself is an input column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import text as T
from pagewright.functions.steps import once
from pagewright.operators import row_folds, spatial
from pagewright.schema import BLOCK, BOX, LIMITS

PX = 300 / 72
ROWS = f"array<{BOX}>"
GROUP = f"struct<y0:double,y1:double,boxes:array<{BOX}>>"
GUTTER = "struct<left:double,right:double>"
PARAGRAPH = "struct<text:string,x0:double,x1:double,y0:double,y1:double,level:int>"


def boxes(detections: Column) -> Column:
    """Bounding boxes of detections that aren't blank."""
    x, y = (lambda d, n=n: F.transform(d["poly"], lambda p: p[n]) for n in (0, 1))
    seen = F.filter(detections, lambda d: ~T.blank(d["text"]))
    return F.transform(seen, lambda d: F.struct(F.array_min(x(d)).alias("x0"), F.array_max(x(d)).alias("x1"), F.array_min(y(d)).alias("y0"), F.array_max(y(d)).alias("y1"), d["text"].alias("text")))


def group_rows(items: Column) -> Column:
    """Boxes, from the top, each into the first row made so far whose height it shares by half; array<struct<y0, y1, boxes>>. It can't stand within a lambda, nor can what follows."""
    return F.arrow_udf(row_folds.group_rows, f"array<{GROUP}>")(items.cast(ROWS))


def rows(items: Column, gutter: Column | None = None) -> Column:
    """Visual rows of boxes, from the top: their boxes' bounds and texts; blank ones dropped.

    A row is split at the first gap that spans the gutter, or else at the widest (of equal ones the first), if wide enough; the right part is looked at again. A
    page number alone on the right is no column.
    """
    fold = F.arrow_udf(row_folds.rows, ROWS)
    return fold(items.cast(ROWS)) if gutter is None else fold(items.cast(ROWS), gutter.cast(GUTTER))


def rows_each(items: Column, gutters: Column) -> Column:
    """rows() of arrays of boxes, each with its gutter."""
    return F.arrow_udf(row_folds.of_each(row_folds.rows), f"array<{ROWS}>")(items.cast(f"array<{ROWS}>"), gutters.cast(f"array<{GUTTER}>"))


def paragraphs(items: Column) -> Column:
    """Rows joined to paragraphs, array<struct<text, x0, x1, y0, y1, level>>; level is null but for headings."""
    return F.arrow_udf(row_folds.paragraphs, f"array<{PARAGRAPH}>")(items.cast(ROWS))


def paragraphs_each(items: Column) -> Column:
    """paragraphs() of arrays of rows."""
    return F.arrow_udf(row_folds.of_each(row_folds.paragraphs), f"array<array<{PARAGRAPH}>>")(items.cast(f"array<{ROWS}>"))


def by_column(all_: Column, gutter: Column) -> Column:
    """A region's rows column by column, array<struct<column, rows>>: those whose left edge lies before the gutter's middle are 0, others 1; without a gutter all are one of column null."""
    middle = (gutter["left"] + gutter["right"]) / 2
    sides = [F.struct(F.lit(n).alias("column"), F.filter(all_, test).alias("rows")) for n, test in ((0, lambda r: r["x0"] < middle), (1, lambda r: r["x0"] >= middle))]
    return F.when(gutter.isNull(), F.array(F.struct(F.lit(None).cast("int").alias("column"), all_.alias("rows")))).otherwise(F.array(*sides))


def entries(ps: Column, column: Column, region: Column) -> Column:
    """Paragraphs cleaned, with column, region and indent: that against the column's least left edge, in em, if from 0.3 to 4; array<struct<text, y0, y1, level, column, indent_em, region>>."""
    left = F.array_min(F.transform(ps, lambda p: p["x0"]))
    em = lambda p: F.round((p["x0"] - left) / LIMITS.px_per_em, 1)
    kept = lambda p: F.when(column.isNotNull() & em(p).between(LIMITS.indent_least, LIMITS.indent_most), em(p))
    clean = F.transform(ps, lambda p: F.struct(T.strip(T.clean(p["text"], False)).alias("text"), p["y0"].alias("y0"), p["y1"].alias("y1"), p["level"].alias("level"), column.alias("column"), kept(p).alias("indent_em"), region.alias("region")))
    return F.filter(clean, lambda p: p["text"] != "")


def region_entries(d: DataFrame) -> DataFrame:
    """d with `regions` array<struct<boxes, gutter, region>>, replaced by `entries`, those of all regions in order. In steps, so that no expression nests too deep."""
    d = once(d, "_rows", rows_each(F.transform("regions", lambda r: r["boxes"]), F.transform("regions", lambda r: r["gutter"])))
    d = once(d, "regions", F.transform("regions", lambda r, i: F.struct(F.get("_rows", i).alias("rows"), r["gutter"].alias("gutter"), r["region"].alias("region"))))
    d = once(d, "regions", F.flatten(F.transform("regions", lambda r: F.transform(by_column(r["rows"], r["gutter"]), lambda c: F.struct(c["column"].alias("column"), c["rows"].alias("rows"), r["region"].alias("region"))))))
    d = once(d, "_ps", paragraphs_each(F.transform("regions", lambda r: r["rows"])))
    return once(d, "entries", F.flatten(F.transform("regions", lambda r, i: entries(F.get("_ps", i), r["column"], r["region"])))).drop("regions", "_rows", "_ps")


def pixels(r: Column) -> Column:
    return G.rect(r["x0"] * PX, r["y0"] * PX, r["x1"] * PX, r["y1"] * PX)


def insert_images(flow: Column, images: Column) -> Column:
    """Blocks of structs (y0, column, block): in each column, an image goes before the first entry that lies lower than itself."""
    entries = F.transform(flow, lambda e, i: F.struct(i.cast("double").alias("at"), F.lit(1).alias("k"), e["block"].alias("block")))

    def placed(m: Column, j: Column) -> Column:
        own = F.filter(F.transform(flow, lambda e, i: F.struct(e["y0"].alias("y0"), e["column"].alias("column"), i.alias("i"))), lambda e: e["column"].eqNullSafe(m["column"]))
        lower = F.array_min(F.transform(F.filter(own, lambda e: e["y0"] > m["y0"]), lambda e: e["i"]))
        last = F.array_max(F.transform(own, lambda e: e["i"]))
        at = F.coalesce(lower.cast("double"), last + 0.5, F.lit(1e9))
        return F.struct(at.alias("at"), (j - 1_000_000).alias("k"), m["block"].alias("block"))

    all_ = F.concat(entries, F.transform(images, placed))
    order = F.array_sort(F.transform(all_, lambda e, i: F.struct(e["at"].alias("at"), e["k"].alias("k"), i.alias("i"))))
    return F.transform(order, lambda o: F.get(all_, o["i"])["block"])


def extract_ocr_pages(pages: DataFrame, images_dir: str | None = None) -> DataFrame:
    """Fragments of RAW_PAGE rows from their OCR detections (normalised already, see pages.extract).

    Text in images is left out; each callout box is read by itself. Margin items come before callouts here.
    """
    from pagewright.operators.pages import block

    rects = lambda kind: F.transform(F.filter("blocks", lambda b: b["type"] == kind), lambda b: G.from_array(b["bbox"]))
    d = once(pages, "images", rects(1))
    d = once(d, "texts", rects(0))
    d = once(d, "callouts", spatial.callout_boxes(F.coalesce("drawings", F.array().cast(pages.schema["drawings"].dataType)), F.col("images"), F.col("width")))
    d = once(d, "boxes", boxes(F.coalesce("ocr", F.array().cast(pages.schema["ocr"].dataType))))
    px = lambda g: F.when(g.isNotNull(), F.struct((g["left"] * PX).alias("left"), (g["right"] * PX).alias("right")))
    d = once(d, "gutter", px(spatial.page_gutter(F.col("texts"), F.col("height"), F.col("callouts"))))

    def inside(b: Column, r: Column) -> Column:
        return G.covered(b, pixels(r), LIMITS.covered)

    main = F.filter("boxes", lambda b: ~F.exists("images", lambda r: inside(b, r)) & ~F.exists("callouts", lambda r: inside(b, r)))
    own = lambda r: F.filter("boxes", lambda b: inside(b, r) & ~F.exists("images", lambda m: inside(b, m)))
    region = lambda own, g, n: F.struct(own.cast(ROWS).alias("boxes"), g.cast(GUTTER).alias("gutter"), F.lit(n).alias("region"))
    boxed = F.transform("callouts", lambda r: region(own(r), px(spatial.callout_gutter(F.col("texts"), r)), 1))
    d = once(d, "boxed", boxed)
    d = once(d, "regions", F.concat(F.array(region(main, F.col("gutter"), 0)), F.col("boxed")))
    d = region_entries(d)
    height = F.col("height") * PX
    side = lambda p: F.when(T.is_margin_text(p["y0"], p["y1"], height, p["text"]), "margin").when(p["region"] == 1, "callout").otherwise("flow")
    d = once(d, "all", F.transform("entries", lambda p: F.struct(side(p).alias("side"), p.alias("p"))))

    def made(p: Column) -> Column:
        item = T.list_item(p["text"])
        extra = {"column": p["column"], "indent_em": p["indent_em"]}
        return (
            F.when(T.is_numeric_heavy(p["text"]), block("p_numeric", text=p["text"], **extra))
            .when(p["level"].isNotNull(), block("h", text=p["text"], level=p["level"], **extra))
            .when(item.isNotNull(), block("li", text=item["item"], ordered=item["ordered"], **extra))
            .otherwise(block("p", text=p["text"], **extra))
        )

    flow = F.transform(F.filter("all", lambda x: x["side"] == "flow"), lambda x: F.struct(x["p"]["y0"].alias("y0"), x["p"]["column"].alias("column"), made(x["p"]).alias("block")))

    def picture(r: Column, i: Column) -> Column:
        # an image's column goes by the gutter's right edge, not its middle
        column = F.when(F.col("gutter").isNotNull(), F.when(r["x0"] * PX < F.col("gutter")["right"], 0).otherwise(1)).cast("int")
        name = F.format_string("image_%04d_%04d.png", F.col("page_number"), i + 1)
        src = F.concat(F.lit(f"{images_dir}/"), F.col("doc_id").cast("string"), F.lit("/"), name)
        b = block("img", src=src, alt=F.lit(""), column=column) if images_dir else block("img_placeholder", column=column)
        return F.struct((r["y0"] * PX).alias("y0"), column.alias("column"), b.alias("block"), ((G.width(r) >= 1) & (G.height(r) >= 1)).alias("drawn"))

    images = F.filter(F.transform("images", picture), lambda m: m["drawn"])
    texts = lambda name: F.transform(F.filter("all", lambda x: x["side"] == name), lambda x: x["p"]["text"])
    margin = F.flatten(F.transform(texts("margin"), T.split_margin_number))
    return d.select("doc_id", "page_number", margin.alias("margin"), insert_images(flow, images).cast(f"array<{BLOCK}>").alias("blocks"), texts("callout").alias("callout"))
