"""Blocks and page fragments to HTML, Markdown and plain text.

A page is one row, so a page renders by expressions over its arrays alone; only the ordered
concatenation of a document's pages groups rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import text as T
from pagewright.functions.steps import once
from pagewright.schema import IMAGE_LABEL

#: The document's style sheet.
STYLE = (
    "body{font-family:Georgia,'Times New Roman',serif;max-width:860px;margin:2rem auto;padding:0 1rem;line-height:1.6;color:#222}",
    "img{max-width:100%;height:auto;display:block;margin:1rem auto}",
    ".page{margin-bottom:2rem;padding-bottom:1.5rem;border-bottom:1px solid #eee}",
    ".image-placeholder{font-style:italic;color:#666}",
    ".page-meta{font-size:0.8em;color:#999;margin:0 0 0.9em;text-transform:uppercase;letter-spacing:0.03em}",
    ".ocr-numbers{color:#aaa;font-style:italic;font-size:0.85em}",
    ".callout{border-left:3px solid #ccc;margin:1.2rem 0;padding:0.1rem 1rem;background:#fafafa;font-size:0.95em;color:#444}",
    ".cols{display:flex;gap:2rem;margin:1rem 0}",
    ".col{flex:1;min-width:0}",
    "@media (max-width:700px){.cols{display:block}.col+.col{margin-top:1rem}}",
    "table{border-collapse:collapse;margin:1rem 0;width:100%;font-size:0.92em}",
    "table th,table td{border:1px solid #ddd;padding:0.4em 0.7em;text-align:left;vertical-align:top}",
    "table th{background:#f5f5f5}",
    "pre{background:#282c34;color:#e6e6e6;padding:1em;border-radius:6px;overflow-x:auto;font-size:0.88em;line-height:1.5}",
    "pre code{font-family:Consolas,'Courier New',monospace}",
    "ul,ol{margin:0.8rem 0;padding-left:1.6rem}",
    "li{margin:0.25rem 0}",
)


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _unknown(block: Column) -> Column:
    return F.raise_error(_cat("unknown block type: ", F.coalesce(block["type"], F.lit("null")))).cast("string")


def _has(text: Column) -> Column:
    return F.coalesce(F.length(text) > 0, F.lit(False))


def _with(value: Column, f) -> Column:
    """f(value), the value evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


# HTML


def _tag(tag: str, text: Column) -> Column:
    return _cat(f"<{tag}>", text, f"</{tag}>")


def runs_html(runs: Column) -> Column:
    def one(r: Column) -> Column:
        bold, italic = F.coalesce(r["bold"], F.lit(False)), F.coalesce(r["italic"], F.lit(False))
        t = T.escape_html(r["text"])
        t = F.when(italic, _tag("em", t)).otherwise(t)
        t = F.when(bold, _tag("strong", t)).otherwise(t)
        t = F.when(F.coalesce(r["superscript"], F.lit(False)), _tag("sup", t)).otherwise(t)
        return F.when(_has(r["href"]), _cat('<a href="', T.escape_html(r["href"]), '">', t, "</a>")).otherwise(t)

    return F.array_join(F.transform(runs, one), "")


def _rows_html(rows: Column) -> Column:
    def row(cells: Column, i: Column) -> Column:
        def tr(tag: str) -> Column:
            return _cat("<tr>", F.array_join(F.transform(cells, lambda c: _tag(tag, T.escape_html(c))), ""), "</tr>")

        return F.when(i == 0, tr("th")).otherwise(tr("td"))

    return _cat("<table>\n", F.array_join(F.transform(rows, row), "\n"), "\n</table>")


def block_html(b: Column) -> Column:
    """One block, a list item as a list of its own."""
    kind = b["type"]
    indent = b["indent_em"]
    style = F.when(F.coalesce(indent != 0, F.lit(False)), _cat(' style="margin-left:', indent.cast("string"), 'em"')).otherwise("")
    inner = F.when(F.coalesce(F.size(b["runs"]) > 0, F.lit(False)), runs_html(b["runs"])).otherwise(T.linkify_html(b["text"]))
    label = F.when(kind == "p_numeric", ' class="ocr-numbers"').otherwise("")
    caption = F.when(_has(b["caption"]), _cat(": ", T.escape_html(b["caption"]))).otherwise("")
    return (
        F.when(kind.isin("p", "p_numeric"), _cat("<p", label, style, ">", inner, "</p>"))
        .when(kind == "h", _cat("<h", b["level"].cast("string"), ">", T.escape_html(b["text"]), "</h", b["level"].cast("string"), ">"))
        .when(kind == "li", F.when(F.coalesce(b["ordered"], F.lit(False)), _cat("<ol>", _item(b), "</ol>")).otherwise(_cat("<ul>", _item(b), "</ul>")))
        .when(kind == "img", _cat('<img src="', b["src"], '" alt="', T.escape_html(F.coalesce(b["alt"], F.lit(""))), '" loading="lazy">'))
        .when(kind == "img_placeholder", _cat(f'<p class="image-placeholder">[{IMAGE_LABEL}', caption, "]</p>"))
        .when(kind == "table", _rows_html(b["rows"]))
        .when(kind == "code", _cat("<pre><code>", T.escape_html(b["text"]), "</code></pre>"))
        .otherwise(_unknown(b))
    )


def _item(b: Column) -> Column:
    return _tag("li", T.linkify_html(b["text"]))


def _list_kind(b: Column) -> Column:
    """ol, ul, or null for what is no list item, or no block."""
    return F.when(b["type"] == "li", F.when(F.coalesce(b["ordered"], F.lit(False)), "ol").otherwise("ul"))


def flow_html(blocks: Column) -> Column:
    """Parts of a flow. A list opens where the block before is of another kind and closes where the next is."""

    def parts(b: Column, i: Column) -> Column:
        own, before, after = _list_kind(b), _list_kind(F.get(blocks, i - 1)), _list_kind(F.get(blocks, i + 1))
        opened = F.when(~own.eqNullSafe(before), F.array(_cat("<", own, ">"))).otherwise(F.array().cast("array<string>"))
        closed = F.when(~own.eqNullSafe(after), F.array(_cat("</", own, ">"))).otherwise(F.array().cast("array<string>"))
        return F.when(own.isNotNull(), F.concat(opened, F.array(_item(b)), closed)).otherwise(F.array(block_html(b)))

    return F.flatten(F.transform(blocks, parts))


def segment_numbers(blocks: Column) -> Column:
    """For each block the number of its run of blocks with, or without, a column."""
    tagged = F.transform(blocks, lambda b: b["column"].isNotNull())
    state = "struct<last:boolean,n:int,numbers:array<int>>"
    start = F.struct(F.lit(None).cast("boolean").alias("last"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("numbers")).cast(state)

    def step(s: Column, t: Column) -> Column:
        n = s["n"] + F.when(s["last"] != t, 1).otherwise(0)
        return F.struct(t.alias("last"), n.alias("n"), F.concat(s["numbers"], F.array(n)).alias("numbers")).cast(state)

    return F.aggregate(tagged, start, step)["numbers"]


def layout_html(blocks: Column) -> Column:
    """Parts of a page's blocks: flows as they come, each run of column blocks side by side."""

    def segment(all_: Column, numbers: Column, n: Column) -> Column:
        own = F.filter(all_, lambda b, i: F.get(numbers, i) == n)
        cols = F.array_sort(F.array_distinct(F.transform(own, lambda b: b["column"])))
        sides = F.transform(cols, lambda c: F.concat(F.array(F.lit('<div class="col">')), flow_html(F.filter(own, lambda b: b["column"] == c)), F.array(F.lit("</div>"))))
        side_by_side = F.concat(F.array(F.lit('<div class="cols">')), F.flatten(sides), F.array(F.lit("</div>")))
        return F.when(F.get(own, F.lit(0))["column"].isNull(), flow_html(own)).otherwise(side_by_side)

    numbers = segment_numbers(blocks)
    tagged = F.exists(blocks, lambda b: b["column"].isNotNull())
    columns = _with(F.struct(numbers.alias("n")), lambda s: F.flatten(F.transform(F.array_distinct(s["n"]), lambda n: segment(blocks, s["n"], n))))
    return F.when(tagged, columns).otherwise(flow_html(blocks))


NONE = "array<string>"


def head_html(number: Column, margin: Column) -> Column:
    """A page's first lines: its section and, if there is one, its margin."""
    meta = F.when(F.size(margin) > 0, F.array(_cat('<p class="page-meta">', T.escape_html(F.array_join(margin, " · ")), "</p>"))).otherwise(F.array().cast(NONE))
    return F.concat(F.array(_cat('<section class="page" id="page-', number.cast("string"), '">')), meta)


def body_html(blocks: Column, callout: Column) -> Column:
    aside = F.concat(F.array(F.lit('<aside class="callout">')), F.transform(callout, lambda t: _tag("p", T.escape_html(t))), F.array(F.lit("</aside>")))
    return F.array_join(F.concat(layout_html(blocks), F.when(F.size(callout) > 0, aside).otherwise(F.array().cast(NONE)), F.array(F.lit("</section>"))), "\n")


def page_html(number: Column, margin: Column, blocks: Column, callout: Column) -> Column:
    return page_of("html", number, margin, body_html(blocks, callout))


def document_html(title: Column, body: Column) -> Column:
    # fixed value: the document's frame
    head = '<!DOCTYPE html>\n<html lang="ru">\n<head>\n<meta charset="utf-8">\n<meta name="viewport" content="width=device-width, initial-scale=1">\n'
    safe = T.escape_html(title)
    return _cat(head, _tag("title", safe), "\n<style>\n" + "\n".join(STYLE) + "\n</style>\n</head>\n<body>\n", _tag("h1", safe), "\n", body, "\n</body>\n</html>")


# Markdown


def runs_md(runs: Column) -> Column:
    def one(r: Column) -> Column:
        bold, italic = F.coalesce(r["bold"], F.lit(False)), F.coalesce(r["italic"], F.lit(False))
        mark = F.concat(F.when(bold, "**").otherwise(""), F.when(italic, "*").otherwise(""))
        t = _cat(mark, T.escape_md_inline(r["text"]), mark)
        return F.when(_has(r["href"]), _cat("[", t, "](", r["href"], ")")).otherwise(t)

    return T.guard_md(F.array_join(F.transform(runs, one), ""))


def block_md(b: Column) -> Column:
    kind = b["type"]

    def row(cells: Column, i: Column) -> Column:
        line = _cat("| ", F.array_join(F.transform(cells, T.md_cell), " | "), " |")
        rule = _cat("\n|", F.array_join(F.transform(cells, lambda c: F.lit(" --- ")), "|"), "|")
        return F.when(i == 0, F.concat(line, rule)).otherwise(line)

    fence = F.when(F.contains(b["text"], F.lit("```")), "~~~").otherwise("```")
    caption = F.when(_has(b["caption"]), _cat(": ", T.escape_md(b["caption"]))).otherwise("")
    return (
        F.when(kind.isin("p", "p_numeric"), F.when(F.coalesce(F.size(b["runs"]) > 0, F.lit(False)), runs_md(b["runs"])).otherwise(T.linkify_md(b["text"])))
        .when(kind == "h", _cat(F.repeat(F.lit("#"), b["level"]), " ", T.escape_md(b["text"])))
        .when(kind == "li", _cat(F.when(F.coalesce(b["ordered"], F.lit(False)), "1. ").otherwise("- "), T.linkify_md(b["text"])))
        .when(kind == "img", _cat("![", T.escape_md_alt(F.coalesce(b["alt"], F.lit(""))), "](", b["src"], ")"))
        .when(kind == "img_placeholder", _cat(f"*[{IMAGE_LABEL}", caption, "]*"))
        .when(kind == "table", F.array_join(F.transform(b["rows"], row), "\n"))
        .when(kind == "code", _cat(fence, "\n", b["text"], "\n", fence))
        .otherwise(_unknown(b))
    )


def _join_parts(*parts: Column) -> Column:
    return F.array_join(F.filter(F.concat(*parts), lambda p: ~T.blank(p)), "\n\n")


def _optional(condition: Column, part: Column) -> Column:
    return F.when(condition, F.array(part)).otherwise(F.array().cast("array<string>"))


def body_md(blocks: Column, callout: Column) -> Column:
    return _join_parts(F.transform(blocks, block_md), _optional(F.size(callout) > 0, F.array_join(F.transform(callout, lambda t: _cat("> ", T.escape_md(t))), "\n")))


def page_md(margin: Column, blocks: Column, callout: Column) -> Column:
    return page_of("md", None, margin, body_md(blocks, callout))


def document_md(title: Column, pages: Column) -> Column:
    return _cat("# ", title, "\n\n", F.array_join(pages, "\n\n---\n\n"), "\n")


# Plain text


def block_txt(b: Column) -> Column:
    kind = b["type"]

    def table(rows: Column) -> Column:
        widths = F.transform(F.sequence(F.lit(0), F.size(F.get(rows, F.lit(0))) - 1), lambda c: F.array_max(F.transform(rows, lambda r: F.length(F.get(r, c)))))

        def line(cells: Column, i: Column) -> Column:
            padded = F.array_join(F.transform(cells, lambda c, j: F.rpad(c, F.get(widths, j), F.lit(" "))), "  ")
            rule = F.array_join(F.transform(widths, lambda w: F.repeat(F.lit("-"), w)), "  ")
            return F.when(i == 0, _cat(padded, "\n", rule)).otherwise(padded)

        return F.array_join(F.transform(rows, line), "\n")

    def picture(text: Column) -> Column:
        return F.when(_has(text), _cat(f"[{IMAGE_LABEL}: ", text, "]")).otherwise(f"[{IMAGE_LABEL}]")

    return (
        F.when(kind.isin("p", "p_numeric", "h", "code"), b["text"])
        .when(kind == "li", _cat("  - ", b["text"]))
        .when(kind == "img", picture(b["alt"]))
        .when(kind == "img_placeholder", picture(b["caption"]))
        .when(kind == "table", table(b["rows"]))
        .otherwise(_unknown(b))
    )


def body_txt(blocks: Column, callout: Column) -> Column:
    return _join_parts(F.transform(blocks, block_txt), _optional(F.size(callout) > 0, F.array_join(F.transform(callout, lambda t: _cat("    ", t)), "\n")))


def page_txt(margin: Column, blocks: Column, callout: Column) -> Column:
    return page_of("txt", None, margin, body_txt(blocks, callout))


def document_txt(title: Column, pages: Column) -> Column:
    return _cat(title, "\n", F.repeat(F.lit("="), F.length(title)), "\n\n", F.array_join(pages, "\n\n----------\n\n"), "\n")


# Documents


def hide_running_heads(fragments: DataFrame) -> DataFrame:
    """Add margin_display: margin items but those, page numbers excepted, that the document's page before (of those there) shows too."""
    heads = F.filter("margin", lambda m: ~T.is_page_number(m))
    before = F.lag(heads).over(Window.partitionBy("doc_id").orderBy("page_number"))
    d = fragments.withColumn("_before", F.coalesce(before, F.array().cast("array<string>")))
    shown = F.filter("margin", lambda m: T.is_page_number(m) | ~F.array_contains(F.col("_before"), m))
    return d.withColumn("margin_display", shown).drop("_before")


BODIES = {"html": body_html, "md": body_md, "txt": body_txt}


def page_of(fmt: str, number: Column | None, margin: Column, body: Column) -> Column:
    """A page from its margin, running heads hidden already, and its body."""
    if fmt == "html":
        return F.array_join(F.concat(head_html(number, margin), F.array(body)), "\n")
    shown = _cat("*", T.escape_md(F.array_join(margin, " · ")), "*") if fmt == "md" else _cat("[", F.array_join(margin, " · "), "]")
    return _join_parts(_optional(F.size(margin) > 0, shown), F.array(body))


def render_bodies(fragments: DataFrame, fmt: str) -> DataFrame:
    """(doc_id, page_number, margin, heads, body): what of a page doesn't depend on others; heads are the items of its margin that hide equal ones on the next page."""
    d = once(fragments, "blocks", F.col("blocks"))
    heads = F.filter("margin", lambda m: ~T.is_page_number(m))
    return d.select("doc_id", "page_number", "margin", heads.alias("heads"), BODIES[fmt](F.col("blocks"), F.col("callout")).alias("body"))


def render_pages(fragments: DataFrame, fmt: str) -> DataFrame:
    """(doc_id, page_number, body) in html, md or txt, running heads hidden."""
    d = once(hide_running_heads(fragments), "blocks", F.col("blocks"))
    body = page_of(fmt, F.col("page_number"), F.col("margin_display"), BODIES[fmt](F.col("blocks"), F.col("callout")))
    return d.select("doc_id", "page_number", body.alias("body"))


def assemble(pages: DataFrame, titles: DataFrame, fmt: str) -> DataFrame:
    """(doc_id, content) of rendered pages (doc_id, page_number, body), in order under the title of titles (doc_id, title). A document's text has to fit a row."""
    own = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "body"))).alias("pages"))
    bodies = F.transform("pages", lambda p: p["body"])
    d = own.join(titles.select("doc_id", "title"), "doc_id")
    content = {"html": lambda t, b: document_html(t, F.array_join(b, "\n")), "md": document_md, "txt": document_txt}[fmt](F.col("title"), bodies)
    return d.select("doc_id", content.alias("content"))


def render_documents(fragments: DataFrame, titles: DataFrame, fmt: str) -> DataFrame:
    """assemble() of all pages of fragments."""
    return assemble(render_pages(fragments, fmt), titles, fmt)
