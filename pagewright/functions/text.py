"""Text as Column expressions: cleaning, predicates, splitting and escaping.

Everything runs in the JVM but nfkc(), an Arrow-batched pandas UDF, as Spark has no normalisation.
Patterns are Unicode-aware, `(?U)`, where white space, digits or word characters matter.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.steps import bind
from pagewright.schema import BULLETS, LIMITS, LISTING_LABELS, MONOSPACE, NOTE_LABELS, TERMINATORS

#: White space, patterns of control characters, hyphen wraps, numbers, list items, addresses, tokens and footnotes.
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
JUNK = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
UNSEEN = r"[\x00-\x08\x0B-\x1F\x{E000}-\x{F8FF}]"
#: Begins with the hyphen, as a look behind at each character takes longer than all else.
HYPHEN_WRAP = r"(?U)-(?<=[A-Za-zА-Яа-яЁё]-)\s+(?=[A-Za-zА-Яа-яЁё])"
PAGE_NUMBER = r"(?U)^\d{1,4}[.,]?$"
TRAILING_NUMBER = r"(?U)\s\d{1,4}[.,]?$"
LEADING_NUMBER = r"(?U)^\d{1,4}\s"
BULLET_ITEM = rf"(?U)^[{BULLETS}]\s+(\S.*)$"
NUMBER_ITEM = r"(?U)^\d{1,2}[.)]\s+(\S.*)$"
URL = r"""(https?://[^\s<>"'«»]+|www\.[^\s<>"'«»]+\.[a-zA-Z]{2,}[^\s<>"'«»]*)"""
FOOTNOTE = r"(?U)^(\d{1,2})\s+\S"
#: [^\W\d_]+|\d+, with a short way for ASCII.
TOKEN = r"(?U)[[a-zA-Z][\x{80}-\x{10FFFF}&&[^\W\d]]]+|\d+"


def strip(text: Column) -> Column:
    """Without white space at either end, by Unicode."""
    return F.btrim(text, F.lit(SPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE))


def blank(text: Column) -> Column:
    return F.ltrim(F.coalesce(text, F.lit("")), F.lit(SPACE)) == ""


def nfkc(text: Column) -> Column:
    """Compatibility composition; null stays null."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))

    return fold(text)


def clean_code(text: Column, normalise: bool = True) -> Column:
    """Null is empty; NFKC; no private-use and control characters, but line feeds and tabs."""
    base = F.coalesce(text, F.lit(""))
    return bind(nfkc(base) if normalise else base, _seen)


def _seen(text: Column) -> Column:
    """Texts without such characters, as most are, aren't built anew."""
    return F.when(text.rlike(UNSEEN), F.regexp_replace(text, UNSEEN, "")).otherwise(text)


def _unwrapped(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("-")), F.regexp_replace(text, HYPHEN_WRAP, "")).otherwise(text)


def clean(text: Column, normalise: bool = True) -> Column:
    """As clean_code, and words broken by a hyphen and white space joined."""
    base = F.coalesce(text, F.lit(""))
    return bind(nfkc(base) if normalise else base, _seen, _unwrapped)


def is_garbled(raw: Column) -> Column:
    """Over a fifth of 20 characters or more are control characters."""
    junk = F.regexp_count(raw, F.lit(JUNK))
    return F.coalesce((F.length(raw) >= LIMITS.garbled_length) & (junk > F.length(raw) * LIMITS.garbled_share), F.lit(False))


def in_margin_zone(y0: Column, y1: Column, height: Column) -> Column:
    return (y1 <= height * LIMITS.margin_share) | (y0 >= height * (1 - LIMITS.margin_share))


def is_margin_text(y0: Column, y1: Column, height: Column, text: Column) -> Column:
    return (F.length(text) > 0) & (F.length(text) <= LIMITS.margin_length) & in_margin_zone(y0, y1, height)


def is_page_number(text: Column) -> Column:
    return strip(text).rlike(PAGE_NUMBER)


def is_numeric_heavy(text: Column) -> Column:
    alnum = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]"))
    return (alnum >= LIMITS.numeric_chars) & (F.regexp_count(text, F.lit(r"\p{Nd}")) >= alnum * LIMITS.numeric_share)


def is_monospace(font: Column) -> Column:
    return F.lower(font).rlike("|".join(MONOSPACE))


def list_item(text: Column) -> Column:
    """struct(item, ordered) of a text with a list marker; else null. The first character tells most that have none."""
    item = F.when(text.rlike(BULLET_ITEM), F.struct(F.regexp_extract(text, BULLET_ITEM, 1).alias("item"), F.lit(False).alias("ordered")))
    item = item.when(text.rlike(NUMBER_ITEM), F.struct(F.regexp_extract(text, NUMBER_ITEM, 1).alias("item"), F.lit(True).alias("ordered")))
    return F.when(F.left(text, F.lit(1)).rlike(rf"(?U)^[{BULLETS}\d]"), item)


def ends_finished(text: Column) -> Column:
    """The last character that is not white space ends a paragraph."""
    return F.instr(F.lit(TERMINATORS), F.right(rstrip(text), F.lit(1))) > 0


def is_note(text: Column) -> Column:
    return text.rlike(rf"(?U)^(?:{'|'.join(NOTE_LABELS)})\b")


def is_listing_caption(text: Column) -> Column:
    return text.rlike(rf"(?U)^(?:{'|'.join(LISTING_LABELS)})\s+\d")


def split_margin_number(text: Column) -> Column:
    """A margin item as array: [number, head] or [head, number] where both are glued together; else [text]."""
    t = strip(text)
    lead, trail = r"(?U)^(\d{1,4})\s+(\S.*)$", r"(?U)^(.*\S)\s+(\d{1,4})$"
    return (
        F.when(t.rlike(lead), F.array(F.regexp_extract(t, lead, 1), F.regexp_extract(t, lead, 2)))
        .when(t.rlike(trail), F.array(F.regexp_extract(t, trail, 1), F.regexp_extract(t, trail, 2)))
        .otherwise(F.array(t))
    )


def heading_level(text: Column, size: Column, bold: Column, body: Column) -> Column:
    """2, 3 or null, by a block's font size and share of bold against the page's body size."""
    ratio = size / body
    usual = body.isNotNull() & (size > 0) & (F.length(text) <= LIMITS.heading_length) & ~blank(text) & ~ends_finished(text)
    heavy = (bold >= LIMITS.heading_bold) & (F.abs(ratio - 1) < LIMITS.heading_tolerance) & (F.length(text) <= LIMITS.ocr_heading_length)
    return F.when(usual, F.when(ratio >= LIMITS.heading_h2, 2).when((ratio >= LIMITS.heading_h3) | heavy, 3)).cast("int")


def tokens(text: Column) -> Column:
    """Runs of letters and runs of digits, lower-cased; null has none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


# Escaping


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def escape_md_inline(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_\[\]<>&])", r"\\$1")


def guard_md(text: Column) -> Column:
    """A text that would open a heading or list gets a backslash."""
    number = r"(?U)^(\d+)\.(\s|$)"
    guarded = F.when(F.left(text, F.lit(1)).isin("#", "-", "+"), F.concat(F.lit("\\"), text))
    return guarded.when(text.rlike(number), F.regexp_replace(text, r"(?U)^(\d+)\.", r"$1\\.")).otherwise(text)


def escape_md(text: Column) -> Column:
    return guard_md(escape_md_inline(text))


def escape_md_alt(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "[]", "()"), r"([\\`*_<>&])", r"\\$1")


def md_cell(text: Column) -> Column:
    out = F.replace(escape_md(text), F.lit("|"), F.lit("\\|"))
    return F.when(out == "", " ").otherwise(out)


def url_parts(match: Column) -> Column:
    """struct(url, href, trailing): punctuation behind a URL is split off, and www gets a scheme."""
    url = F.regexp_replace(match, r"[).,;:!?»]+$", "")
    href = F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.struct(url.alias("url"), href.alias("href"), F.substr(match, F.length(url) + 1).alias("trailing"))


def _linkify(text: Column, plain, link) -> Column:
    """plain() of what lies between URLs and link() of URLs, joined. Texts without a URL take the short way."""
    gaps, urls = F.split(text, URL, -1), F.regexp_extract_all(text, F.lit(URL), F.lit(0))
    pieces = F.zip_with(gaps, urls, lambda gap, url: F.concat(plain(gap), F.coalesce(F.element_at(F.transform(F.transform(F.array(url), url_parts), link), 1), F.lit(""))))
    return F.when(text.rlike(URL), F.array_join(pieces, "")).otherwise(plain(text))


def linkify_html(text: Column) -> Column:
    return _linkify(text, escape_html, lambda u: F.concat(F.lit('<a href="'), escape_html(u["href"]), F.lit('">'), escape_html(u["url"]), F.lit("</a>"), escape_html(u["trailing"])))


def linkify_md(text: Column) -> Column:
    return guard_md(_linkify(text, escape_md_inline, lambda u: F.concat(F.lit("["), u["url"], F.lit("]("), u["href"], F.lit(")"), escape_md_inline(u["trailing"]))))
