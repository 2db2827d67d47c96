"""A catalogue of books as a table: search, choice of a download, names of files, random samples; and a guarded HTTP source."""

from __future__ import annotations

import json
import os
import tempfile
import urllib.parse
import urllib.request
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Media types in order of preference, the most bytes of an answer, ids of a catalogue, shortest pages of a search.
PREFERRED = ("application/epub", "application/pdf", "text/html")
MAX_BYTES = 200 * 1024 * 1024
MAX_ID = 75_000
LEAST_RESULTS = 25


def _needs(what: str, there: bool) -> None:
    if not there:
        raise ValueError(f"the books have no columns for a search by {what}")


def search(books: DataFrame, topic: str | None = None, author: str | None = None, keyword: str | None = None, years: tuple[int | None, int | None] = (None, None), languages: list[str] | None = None, sort: str = "popular", want: int = LEAST_RESULTS) -> DataFrame:
    """Up to max(want, 25) books by the filters given, sorted popular, ascending or descending (by id).

    All words of keyword and author have to occur in title or authors; topic in a subject or bookshelf, in any case. years, from and to: an author
    was born or died in or after the first, and an author was born or died in or before the second; unknown years don't count. A filter
    whose columns the books lack is an error.
    """
    names = F.array_join(F.transform("authors", lambda a: a["name"]), " ")
    words = F.lower(F.concat_ws(" ", "title", names))
    d = books
    for w in f"{keyword or ''} {author or ''}".lower().split():
        d = d.where(F.contains(words, F.lit(w)))
    if topic:
        _needs("topic", {"subjects", "bookshelves"} <= set(books.columns))
        held = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("subjects", "bookshelves")])
        d = d.where(F.exists(held, lambda s: F.contains(F.lower(s), F.lit(topic.lower()))))
    if years != (None, None):
        _needs("years", {"birth_year", "death_year"} <= set(books.schema["authors"].dataType.elementType.names))
        for bound, test in ((years[0], lambda y: y >= years[0]), (years[1], lambda y: y <= years[1])):
            if bound is not None:
                d = d.where(F.exists("authors", lambda a: F.coalesce(test(a["birth_year"]), F.lit(False)) | F.coalesce(test(a["death_year"]), F.lit(False))))
    if languages:
        d = d.where(F.arrays_overlap("languages", F.array(*map(F.lit, languages))))
    order = {"popular": [F.col("download_count").desc(), F.col("id")], "ascending": [F.col("id")], "descending": [F.col("id").desc()]}[sort]
    return d.orderBy(*order).limit(max(want, LEAST_RESULTS))


def pick_format(formats: Column, preferred: tuple[str, ...] = PREFERRED) -> Column:
    """struct(mime, url) of the first media type that a preferred prefix begins, by preference, then the map's order; else null."""
    items = F.map_entries(formats)
    found = [F.get(F.filter(items, lambda e: F.startswith(e["key"], F.lit(prefix))), F.lit(0)) for prefix in preferred]
    best = F.coalesce(*found)
    return F.when(best.isNotNull(), F.struct(best["key"].alias("mime"), best["value"].alias("url")))


def upgrade_url(url: Column, hosts: list[str]) -> Column:
    """http becomes https on these hosts; all else stays."""
    plain = (F.parse_url(url, F.lit("PROTOCOL")) == "http") & F.parse_url(url, F.lit("HOST")).isin(hosts)
    return F.when(plain, F.regexp_replace(url, "^http:", "https:")).otherwise(url)


def is_allowed_url(url: Column, hosts: list[str]) -> Column:
    """https, one of the hosts, and no port named."""
    host = F.parse_url(url, F.lit("HOST"))
    return F.coalesce((F.parse_url(url, F.lit("PROTOCOL")) == "https") & host.isin(hosts) & (F.parse_url(url, F.lit("AUTHORITY")) == host), F.lit(False))


def download_url(formats: Column, hosts: list[str], choice: str | None = None) -> Column:
    url = upgrade_url(pick_format(formats, (choice,) if choice else PREFERRED)["url"], hosts)
    return F.when(is_allowed_url(url, hosts), url)


def file_name(id_: Column, title: Column, extension: str, prefix: str = "book_") -> Column:
    """Letters, digits, blanks, dots, underscores and hyphens of the title's first 60 characters, others as underscores, behind prefix and id."""
    named = F.when(F.length(title) > 0, title).otherwise("book")
    return F.concat(F.lit(prefix), id_.cast("string"), F.lit("_"), F.left(F.regexp_replace(named, r"[^\p{L}\p{N} ._-]", "_"), F.lit(60)), F.lit(extension))


def book_line(books: DataFrame) -> Column:
    """One line for a book; those whose copyright isn't known to be over are marked."""
    # fixed values: the line's words
    authors = F.array_join(F.transform("authors", lambda a: F.coalesce(a["name"], F.lit("?"))), ", ")
    parts = [
        F.lit("#"), F.col("id").cast("string"), F.lit(" — "), F.coalesce("title", F.lit("(без названия)")), F.lit(" — "), F.when(authors == "", "автор неизвестен").otherwise(authors),
        F.lit(" ["), F.array_join("languages", ","), F.lit("] ("), F.coalesce("download_count", F.lit(0)).cast("string"), F.lit(" скачиваний)"),
        F.when(F.col("copyright").eqNullSafe(F.lit(False)), "").otherwise(" [лицензия не подтверждена как public domain]"),
    ]
    return F.concat(*parts)


def random_books(books: DataFrame, n: int, seed: int) -> DataFrame:
    """n books at random, without repeats, whose copyright is known to be over, with `attempt`, the draw that gave each, from 1; the same for the same seed and ids."""
    order = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("id").cast("string")).cast("binary"))
    drawn = books.where(F.col("copyright") == F.lit(False)).dropDuplicates(["id"]).withColumn("_order", order).orderBy("_order", "id").limit(n)
    return drawn.withColumn("attempt", F.row_number().over(Window.orderBy("_order", "id"))).drop("_order")  # of n rows


def sample_metadata(books: DataFrame, hosts: list[str], page_url: str, source: str) -> DataFrame:
    """(id, metadata): what is kept beside a book sampled by random_books(), as JSON of ten keys. source: the catalogue's name."""
    best = pick_format(F.col("formats"))
    record = F.struct(
        F.lit(source).alias("source"), F.col("id").alias("book_id"), F.concat(F.lit(page_url), F.col("id").cast("string")).alias("book_url"), "title", F.transform("authors", lambda a: a["name"]).alias("authors"),
        F.lit("the catalogue reports copyright=false").alias("license_basis"), best["mime"].alias("format_mime"), upgrade_url(best["url"], hosts).alias("format_url"), file_name(F.col("id"), F.col("title"), "").alias("local_file"),
        "attempt",
    )
    return books.select("id", F.to_json(record).alias("metadata"))


# Over HTTP: used on the driver or in a task, one address at a time


def opener(hosts: set[str]) -> urllib.request.OpenerDirector:
    """Follows redirects only to https, these hosts and no named port."""

    class Guard(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, req, fp, code, msg, headers, newurl):
            to = urllib.parse.urlsplit(newurl)
            if to.scheme != "https" or to.hostname not in hosts or to.port is not None:
                raise PermissionError(f"redirect to {newurl} is not allowed")
            return super().redirect_request(req, fp, code, msg, headers, newurl)

    return urllib.request.build_opener(Guard)


def fetch(http, url: str, timeout: float = 15, most: int = MAX_BYTES) -> bytes:
    """An answer's body; more than `most` bytes are an error."""
    with http.open(urllib.request.Request(url, headers={"User-Agent": "pagewright"}), timeout=timeout) as answer:
        body = answer.read(most + 1)
    if len(body) > most:
        raise ValueError(f"{url}: more than {most} bytes")
    return body


def fetch_json(http, url: str, timeout: float = 15):
    return json.loads(fetch(http, url, timeout))


def download(http, url: str, to: Path, timeout: float = 60) -> bool:
    """Fetch to a file, which appears only when it is whole; False if it is there already."""
    if to.exists():
        return False
    handle, part = tempfile.mkstemp(prefix=f".{to.name}.", suffix=".part", dir=to.parent)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(fetch(http, url, timeout))
        os.replace(part, to)
    finally:
        Path(part).unlink(missing_ok=True)
    return True


def output_path(base: Path, name: str) -> Path:
    """base / name, which has to stay below base."""
    path = (base / name).resolve()
    if not path.is_relative_to(base.resolve()):
        raise ValueError(f"{name} leaves {base}")
    return path
