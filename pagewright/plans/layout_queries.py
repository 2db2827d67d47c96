"""Queries over boxes: spatial joins, columns, components, rows, tables, runs and classes. A document stands for a page; boxes come from its number."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import text as T
from pagewright.functions.steps import once
from pagewright.operators import ocr, pages, row_folds, spatial, tables
from pagewright.plans.inputs import sql_clean, table
from pagewright.schema import BOX, BULLETS, LINK_GOTO, LINK_URI, RAW_BLOCK, RECT, RUN
from pagewright.sources.readers import lines

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def doc_id():
    return F.col("doc_id")



def _boxes(n: int, x0, y0, w, h):
    """n rectangles by functions of doc_id and i."""

    def one(i):
        a, b = x0(doc_id(), i), y0(doc_id(), i)
        return G.rect(a, b, a + w(doc_id(), i), b + h(doc_id(), i))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)


def _sql_boxes(name: str, n: int, x0: str, y0: str, w: str, h: str) -> str:
    return f"""{name} AS (SELECT doc_id, i, x0::DOUBLE AS x0, y0::DOUBLE AS y0, (x0 + w)::DOUBLE AS x1, (y0 + h)::DOUBLE AS y1
  FROM (SELECT doc_id, i, {x0} AS x0, {y0} AS y0, {w} AS w, {h} AS h FROM documents, range({n}) r(i)))"""


SQL_OVERLAP = """(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)))"""
SQL_AREA = "((a.x1 - a.x0) * (a.y1 - a.y0))"
_SMALL = (12, lambda d, i: (d * 13 + i * 37) % 200, lambda d, i: (d * 7 + i * 53) % 200, lambda d, i: (d + i * 11) % 30, lambda d, i: 5 + (d * 3 + i) % 20)
_SQL_SMALL = (12, "(doc_id * 13 + i * 37) % 200", "(doc_id * 7 + i * 53) % 200", "(doc_id + i * 11) % 30", "5 + (doc_id * 3 + i) % 20")
_LARGE = (5, lambda d, i: (d * 5 + i * 41) % 150, lambda d, i: (d * 11 + i * 67) % 150, lambda d, i: 40 + (d + i) % 30, lambda d, i: 40 + (d * 2 + i) % 40)
_SQL_LARGE = (5, "(doc_id * 5 + i * 41) % 150", "(doc_id * 11 + i * 67) % 150", "40 + (doc_id + i) % 30", "40 + (doc_id * 2 + i) % 40")


@query(f"""WITH {_sql_boxes("A", *_SQL_SMALL)}, {_sql_boxes("T", *_SQL_LARGE)}
SELECT a.doc_id, a.i::INT AS block_no, min(b.i)::INT AS table_no FROM A a JOIN T b USING (doc_id) WHERE {SQL_AREA} > 0 AND {SQL_OVERLAP} > {SQL_AREA} * 0.5 GROUP BY 1, 2""")
def q_table_hit(spark, d):
    """Blocks and the first table that holds more than half of each."""
    p = table(spark, d, "documents").select("doc_id", _boxes(*_SMALL).alias("a"), _boxes(*_LARGE).alias("t"))
    hits = p.select("doc_id", F.posexplode(F.transform("a", lambda a: spatial.first_cover(a, F.col("t")))).alias("block_no", "table_no"))
    return hits.where("table_no is not null").select("doc_id", "block_no", F.col("table_no").cast("int").alias("table_no"))


@query(f"""WITH {_sql_boxes("A", *_SQL_SMALL)}, {_sql_boxes("T", *_SQL_LARGE)}
SELECT a.doc_id, a.i::INT AS block_no FROM A a WHERE EXISTS (SELECT 1 FROM T b WHERE a.doc_id = b.doc_id AND {SQL_AREA} > 0 AND {SQL_OVERLAP} > {SQL_AREA} * 0.5)""")
def q_callout_blocks(spark, d):
    p = table(spark, d, "documents").select("doc_id", _boxes(*_SMALL).alias("a"), _boxes(*_LARGE).alias("t"))
    return p.select("doc_id", F.posexplode(F.transform("a", lambda a: spatial.is_covered(a, F.col("t")))).alias("block_no", "inside")).where("inside").drop("inside")


@query(f"""WITH {_sql_boxes("A", *_SQL_SMALL)}, {_sql_boxes("T", *_SQL_LARGE)},
l AS (SELECT *, CASE i % 3 WHEN 0 THEN 'http://h/' || i::VARCHAR WHEN 1 THEN '#page-' || (i + 1)::VARCHAR END AS href FROM T WHERE i % 3 < 2)
SELECT a.doc_id, a.i::INT AS span_no, min_by(href, b.i) AS href FROM A a JOIN l b USING (doc_id) WHERE {SQL_AREA} > 0 AND {SQL_OVERLAP} > {SQL_AREA} * 0.5 GROUP BY 1, 2""")
def q_span_links(spark, d):
    """Spans and the target of the first link over each: addresses and pages; other kinds of links don't count."""
    kind = lambda i: F.when(i % 3 == 0, LINK_URI).when(i % 3 == 1, LINK_GOTO).otherwise(9)
    link = lambda r, i: F.struct(r.alias("rect"), kind(i).alias("kind"), F.concat(F.lit("http://h/"), i.cast("string")).alias("uri"), i.cast("int").alias("page"))
    p = table(spark, d, "documents").select("doc_id", _boxes(*_SMALL).alias("a"), spatial.page_links(F.transform(_boxes(*_LARGE), link)).alias("l"))
    hit = lambda a: F.get(F.col("l"), spatial.first_cover(a, F.col("l"), lambda x: x["rect"]))["href"]
    return p.select("doc_id", F.posexplode(F.transform("a", hit)).alias("span_no", "href")).where("href is not null")


@query(f"""WITH RECURSIVE {_sql_boxes("A", *_SQL_SMALL)},
e AS (SELECT a.doc_id, a.i AS u, b.i AS v FROM A a JOIN A b ON a.doc_id = b.doc_id AND a.x0 - 3 <= b.x1 AND b.x0 <= a.x1 + 3 AND a.y0 - 3 <= b.y1 AND b.y0 <= a.y1 + 3),
c(doc_id, i, r) AS (SELECT doc_id, i, i FROM A UNION SELECT c.doc_id, e.v, c.r FROM c JOIN e ON c.doc_id = e.doc_id AND c.i = e.u),
m AS (SELECT doc_id, i, min(r) AS r FROM c GROUP BY 1, 2)
SELECT m.doc_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM m JOIN A USING (doc_id, i) GROUP BY m.doc_id, m.r""")
def q_components(spark, d):
    """Bounding boxes of rectangles that touch."""
    p = table(spark, d, "documents").select("doc_id", _boxes(*_SMALL).alias("a"))
    return p.select("doc_id", F.explode(spatial.merge_touching(F.col("a"))).alias("c")).select("doc_id", "c.*")


def _columns(i, wide):
    return F.when(wide, F.when(i < 4, 50 + i % 3).otherwise(320 + i % 2)).otherwise(50 + 7 * i)


@query("""
WITH b AS (SELECT doc_id, i, CASE WHEN doc_id % 3 < 2 THEN CASE WHEN i < 4 THEN 50 + i % 3 ELSE 320 + i % 2 END ELSE 50 + 7 * i END::DOUBLE AS x0,
  CASE WHEN doc_id % 2 = 0 THEN 100 + 40 * (i % 4) ELSE 100 + 40 * i END::DOUBLE AS y0 FROM documents, range(8) r(i)),
f AS (SELECT *, x0 + 200 + doc_id % 90 AS x1, y0 + 30 AS y1 FROM b),
o AS (SELECT *, row_number() OVER w - 1 AS p, x0 - lag(x0) OVER w AS step FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY x0, y0, x1, y1)),
g AS (SELECT doc_id, max(step) AS d FROM o GROUP BY 1), s AS (SELECT o.doc_id, d, max(p) AS cut FROM o JOIN g USING (doc_id) WHERE step = d GROUP BY 1, 2),
m AS (SELECT s.doc_id, d, cut, list_sort(list(step)) AS l FROM s JOIN o ON s.doc_id = o.doc_id AND p > 0 AND p <> cut GROUP BY 1, 2, 3),
k AS (SELECT doc_id, cut FROM m WHERE d >= 24 AND NOT (l[len(l) // 2 + 1] > 0 AND d < 3 * l[len(l) // 2 + 1])),
h AS (SELECT o.*, p >= cut AS rt FROM o JOIN k USING (doc_id)),
c AS (SELECT doc_id, count(*) FILTER (NOT rt) AS nl, count(*) FILTER (rt) AS nr, max(x1) FILTER (NOT rt) AS "left", min(x0) FILTER (rt) AS "right",
  count(*) FILTER (NOT rt AND EXISTS (SELECT 1 FROM h z WHERE z.doc_id = h.doc_id AND z.rt AND z.y0 < h.y1 AND h.y0 < z.y1)) AS ml,
  count(*) FILTER (rt AND EXISTS (SELECT 1 FROM h z WHERE z.doc_id = h.doc_id AND NOT z.rt AND z.y0 < h.y1 AND h.y0 < z.y1)) AS mr FROM h GROUP BY 1)
SELECT doc_id, "left", "right" FROM c WHERE "right" > "left" AND CASE WHEN nl <= nr THEN ml >= nl * 0.5 ELSE mr >= nr * 0.5 END""")
def q_column_gap(spark, d):
    """Gutters of pages of eight blocks: two columns on two documents of three, side by side on even ones."""

    def one(i):
        x0 = _columns(i, doc_id() % 3 < 2)
        y0 = F.when(doc_id() % 2 == 0, 100 + 40 * (i % 4)).otherwise(100 + 40 * i)
        return G.rect(x0, y0, x0 + 200 + doc_id() % 90, y0 + 30)

    p = table(spark, d, "documents").select("doc_id", spatial.column_gap(F.transform(F.sequence(F.lit(0), F.lit(7)), one), 4).alias("g"))
    return p.where("g is not null").select("doc_id", "g.left", "g.right")


def _word_lists(spark, d):
    """All words of the documents, sixty to a page: (doc_id, page, own)."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), "[ \n]+"), "")
    p = once(table(spark, d, "documents").select("doc_id", "text"), "w", words).select("doc_id", "w").where(F.size("w") > 0)
    # a page takes its own words out of a document's; all words on each of its pages would be work by their square
    own = lambda page: F.transform(F.sequence(page * 60, F.least(page * 60 + 59, F.size("w") - 1)), lambda i: F.get(F.col("w"), i))
    return p.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 60).cast("int")), own)).alias("page", "own"))


def _detections():
    """Boxes of a page's words as detections on rows of four, with jitter."""

    def boxes(own: pa.Array, number: pa.Array) -> pa.Array:
        n = row_folds.lengths(own)
        i = row_folds.ranges(np.zeros_like(n), n)
        x = i % 4 * 120 + np.where(i % 4 >= 2, 260, 0)
        y = i // 4 * 30 + np.fmod(np.repeat(number.to_numpy(zero_copy_only=False), n) + i, 5)
        sides = [row_folds.doubles(v.astype(np.float64)) for v in (x, x + 90, y, y + 20)]
        return row_folds.listed(n, pa.StructArray.from_arrays([*sides, own.flatten()], [*row_folds.SIDES, "text"]))

    return F.arrow_udf(boxes, f"array<{BOX}>")("own", "doc_id")


def _words(spark, d):
    return _word_lists(spark, d).select("doc_id", "page", _detections().alias("boxes"))


_BOX = "STRUCT(x0 INT, y0 INT, i INT, w VARCHAR)"
#: Visual rows V (doc_id, page, row_no, x0, x1, y0, y1, text) of the words' boxes, by the rules that the operator folds by.
_SQL_ROWS = rf"""
D0 AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \n]+'), lambda w: w <> '') AS w FROM documents),
D1 AS (SELECT doc_id, unnest(range((len(w) + 59) // 60)) AS page, w FROM D0),
D2 AS (SELECT doc_id, page, w[page * 60 + 1 : page * 60 + 60] AS w FROM D1),
D3 AS (SELECT doc_id, page, unnest(w) AS w, unnest(range(len(w)))::INT AS i FROM D2),
X AS (SELECT *, ((i % 4) * 120 + CASE WHEN i % 4 >= 2 THEN 260 ELSE 0 END)::INT AS x0, ((i // 4) * 30 + (doc_id + i) % 5)::INT AS y0 FROM D3),
O AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, i) AS k FROM X),
-- each box, from the top, into the first row whose height it shares by half
G(doc_id, page, k, r) AS (SELECT doc_id, page, 0::BIGINT, []::STRUCT(a INT, z INT, b {_BOX}[])[] FROM D2 UNION ALL
  SELECT doc_id, page, k + 1, CASE WHEN hit IS NULL THEN r || [{{a: y0, z: y0 + 20, b: [{{x0: x0, y0: y0, i: i, w: w}}]}}]
    ELSE list_transform(r, lambda x, j: CASE WHEN j = hit THEN {{a: least(x.a, y0), z: greatest(x.z, y0 + 20), b: x.b || [{{x0: x0, y0: y0, i: i, w: w}}]}} ELSE x END) END
  FROM (SELECT G.doc_id, G.page, G.k, r, x0, y0, i, w, nullif(list_position(list_transform(r, lambda x: least(x.z, y0 + 20) > greatest(x.a, y0) AND 2 * (least(x.z, y0 + 20) - greatest(x.a, y0)) >= greatest(x.z, y0 + 20) - least(x.a, y0)), true), 0) AS hit
    FROM G JOIN O ON G.doc_id = O.doc_id AND G.page = O.page AND O.k = G.k + 1)),
H AS (SELECT G.doc_id, G.page, unnest(r) AS r, unnest(range(len(r))) AS g FROM G JOIN D2 ON G.doc_id = D2.doc_id AND G.page = D2.page AND k = len(w)),
B AS (SELECT doc_id, page, g, unnest(r.b) AS b, unnest(range(len(r.b))) AS p FROM H),
-- a row is cut at its widest gap, if that is wide in itself and against the others; the right part is looked at again
C(doc_id, page, g, step, piece, rest) AS (SELECT doc_id, page, g, 0, NULL::{_BOX}[], list(b ORDER BY b.x0, p) FROM B GROUP BY 1, 2, 3 UNION ALL
  SELECT doc_id, page, g, step + 1, CASE WHEN cut THEN rest[1:n] ELSE rest END, CASE WHEN cut THEN rest[n + 1 : len(rest)] ELSE []::{_BOX}[] END
  FROM (SELECT *, coalesce(gap >= 100 AND NOT coalesce(mid > 0 AND gap < 3 * mid, false) AND NOT regexp_matches(trim(array_to_string(list_transform(rest[n + 1 : len(rest)], lambda x: x.w), ' ')), '^[0-9]{{1,4}}[.,]?$'), false) AS cut
    FROM (SELECT *, list_sort(list_filter(gaps, lambda x, j: j <> n))[(len(gaps) - 1) // 2 + 1] AS mid
      FROM (SELECT *, list_max(gaps) AS gap, list_position(gaps, list_max(gaps)) AS n
        FROM (SELECT *, list_transform(range(1, len(rest)), lambda j: rest[j + 1].x0 - rest[j].x0 - 90) AS gaps FROM C WHERE len(rest) > 0))))),
V0 AS (SELECT doc_id, page, g, step, list_min(list_transform(piece, lambda x: x.x0)) AS x0, list_max(list_transform(piece, lambda x: x.x0)) + 90 AS x1, list_min(list_transform(piece, lambda x: x.y0)) AS y0,
  list_max(list_transform(piece, lambda x: x.y0)) + 20 AS y1, array_to_string(list_filter(list_transform(piece, lambda x: x.w), lambda x: trim(x) <> ''), ' ') AS text FROM C WHERE piece IS NOT NULL),
V AS (SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY y0 + y1, g, step) - 1)::INT AS row_no, x0::DOUBLE AS x0, x1::DOUBLE AS x1, y0::DOUBLE AS y0, y1::DOUBLE AS y1, text FROM V0 WHERE trim(text) <> '')"""


def _sql_numeric(x: str) -> str:
    alnum = rf"length(regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
    return rf"({alnum} >= 4 AND length(regexp_replace({x}, '[^\p{{Nd}}]', '', 'g')) >= {alnum} * 0.6)"


_ENDED = r"'[.!?:;»)”]$'"
_TRAILING, _LEADING = r"'\s[0-9]{1,4}[.,]?$'", r"'^[0-9]{1,4}\s'"
_MARKED = rf"'^([{BULLETS}]\s+\S|[0-9]{{1,2}}[.)]\s+\S)'"


@query(f"WITH RECURSIVE {_SQL_ROWS} SELECT doc_id, page::INT AS page, row_no, x0, x1, y0, y1, text FROM V")
def q_rows(spark, d):
    """Visual rows of detections, columns parted at wide gaps."""
    p = once(_word_lists(spark, d), "rows", ocr.rows(_detections()))
    return p.select("doc_id", "page", F.posexplode("rows").alias("row_no", "r")).select("doc_id", "page", "row_no", "r.*")


def _sql_reflow() -> str:
    """Of rows V: their median height M, and R, each row with the paragraph it is in, as far as it goes."""
    return rf""",
M AS (SELECT doc_id, page, CASE WHEN m = 0 THEN 10 ELSE m END AS m FROM (SELECT doc_id, page, list_sort(list(y1 - y0))[count(*) // 2 + 1] AS m FROM V GROUP BY 1, 2)),
S AS (SELECT V.*, m, y1 - y0 AS h, length(text) <= 80 AND rtrim(text) <> '' AND NOT regexp_matches(rtrim(text), {_ENDED}) AND NOT {_sql_numeric("text")} AND NOT regexp_matches(rtrim(text), {_TRAILING}) AND NOT regexp_matches(rtrim(text), {_LEADING}) AS titled,
  regexp_matches(text, {_LEADING}) OR regexp_matches(text, {_MARKED}) AS entry FROM V JOIN M USING (doc_id, page)),
-- the paragraph that a row is in, with all of it so far
R(doc_id, page, row_no, par, text, x0, x1, y0, y1, heading, tallest) AS (SELECT doc_id, page, row_no, 0, text, x0, x1, y0, y1, m > 0 AND h >= m * 1.25 AND titled, h FROM S WHERE row_no = 0 UNION ALL
  SELECT doc_id, page, row_no, CASE WHEN merge THEN par ELSE par + 1 END, CASE WHEN merge THEN before || ' ' || t ELSE t END, CASE WHEN merge THEN x0 ELSE a0 END, CASE WHEN merge THEN greatest(x1, a1) ELSE a1 END,
    CASE WHEN merge THEN y0 ELSE b0 END, b1, CASE WHEN merge THEN goes_on ELSE head END, CASE WHEN merge THEN greatest(tallest, h) ELSE h END
  FROM (SELECT *, b0 - y1 <= m * 1.3 AND NOT (before = '' OR regexp_matches(before, {_ENDED}) OR regexp_matches(before, {_TRAILING}) OR heading AND NOT goes_on) AND NOT entry AS merge
    FROM (SELECT R.doc_id, R.page, S.row_no, par, R.x0, R.x1, R.y0, R.y1, heading, tallest, rtrim(R.text) AS before, S.text AS t, S.x0 AS a0, S.x1 AS a1, S.y0 AS b0, S.y1 AS b1, h, m, entry, m > 0 AND h >= m * 1.25 AND titled AS head,
      heading AND (m > 0 AND h >= m * 1.25 AND titled OR m > 0 AND S.y0 - R.y1 <= m * 0.5 AND h >= m * 0.9 AND titled) AS goes_on FROM R JOIN S ON R.doc_id = S.doc_id AND R.page = S.page AND S.row_no = R.row_no + 1)))"""


@query(f"""WITH RECURSIVE {_SQL_ROWS}{_sql_reflow()}
SELECT doc_id, page::INT AS page, par::INT AS at, text, x0, x1, y0, y1, CASE WHEN heading THEN CASE WHEN tallest >= m * 1.5 THEN 2 ELSE 3 END END::INT AS level
FROM (SELECT * FROM R QUALIFY row_number() OVER (PARTITION BY doc_id, page, par ORDER BY row_no DESC) = 1) JOIN M USING (doc_id, page)""")
def q_reflow(spark, d):
    """Rows joined to paragraphs."""
    p = once(_word_lists(spark, d), "ps", ocr.paragraphs(ocr.rows(_detections())))
    return p.select("doc_id", "page", F.posexplode("ps").alias("at", "p")).select("doc_id", "page", "at", "p.*")


def _cells(i, c):
    """A cell: column 1 is empty throughout, column 3 on most rows; each fourth row goes on with its second half alone."""
    v = F.concat(F.lit("r"), i.cast("string"), F.lit("c"), c.cast("string"))
    return F.when(c == 1, "").when((c == 3) & (i % 3 != 0), "").when((i % 4 == 3) & (c != 2), "").otherwise(v)


@query("""
WITH c AS (SELECT p_partkey, i, c, CASE WHEN c = 1 THEN '' WHEN c = 3 AND i % 3 <> 0 THEN '' WHEN i % 4 = 3 AND c <> 2 THEN '' ELSE 'r' || i::VARCHAR || 'c' || c::VARCHAR END AS v FROM part, range(p_partkey % 7 + 1) r(i), range(5) s(c)),
u AS (SELECT p_partkey, c FROM c GROUP BY 1, 2 HAVING max(v) <> '')
SELECT p_partkey, i::INT AS row_no, string_agg(v, '|' ORDER BY c) AS cells FROM c JOIN u USING (p_partkey, c) GROUP BY 1, 2""")
def q_table_columns(spark, d):
    """Tables without the columns that are empty throughout."""
    n = (F.col("p_partkey") % 7).cast("int")
    rows = F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda c: _cells(i, c)))
    p = table(spark, d, "part").select("p_partkey", tables.drop_empty_columns(rows).alias("rows"))
    return p.select("p_partkey", F.posexplode("rows").alias("row_no", "r")).select("p_partkey", "row_no", F.array_join("r", "|").alias("cells"))


@query("""
WITH RECURSIVE c AS (SELECT p_partkey, i, c, CASE WHEN c = 1 THEN '' WHEN c = 3 AND i % 3 <> 0 THEN '' WHEN i % 4 = 3 AND c <> 2 THEN '' ELSE 'r' || i::VARCHAR || 'c' || c::VARCHAR END AS v FROM part, range(p_partkey % 7 + 1) r(i), range(5) s(c)),
u AS (SELECT p_partkey, c FROM c GROUP BY 1, 2 HAVING max(v) <> ''),
r AS (SELECT p_partkey, i, list(v ORDER BY c) AS row, len(list_filter(list(v), lambda x: x <> '')) AS filled FROM c JOIN u USING (p_partkey, c) GROUP BY 1, 2),
n AS (SELECT p_partkey, count(*) AS n, any_value(len(row)) AS wide FROM r GROUP BY 1),
-- rows from the top: one cell alone goes on in the row above where that has the same column
f(p_partkey, i, kept) AS (SELECT p_partkey, 0::BIGINT, []::VARCHAR[][] FROM n UNION ALL
  SELECT p_partkey, i + 1, CASE WHEN filled = 0 THEN kept WHEN filled = 1 AND len(kept) > 0 AND kept[len(kept)][hit] <> '' THEN kept[1 : len(kept) - 1] || [list_transform(kept[len(kept)], lambda x, j: CASE WHEN j = hit THEN x || ' ' || row[j] ELSE x END)] ELSE kept || [row] END
  FROM (SELECT f.p_partkey, f.i, kept, row, filled, list_position(list_transform(row, lambda x: x <> ''), true) AS hit FROM f JOIN r ON f.p_partkey = r.p_partkey AND f.i = r.i)),
k AS (SELECT f.p_partkey, kept, wide FROM f JOIN n ON f.p_partkey = n.p_partkey AND f.i = n.n),
-- columns from the left: one joins the group before unless a row has two values there
g(p_partkey, c, groups) AS (SELECT p_partkey, 1::BIGINT, [[1::BIGINT]] FROM k UNION ALL
  SELECT p_partkey, c + 1, CASE WHEN clash THEN groups || [[c + 1]] ELSE groups[1 : len(groups) - 1] || [groups[len(groups)] || [c + 1]] END
  FROM (SELECT g.p_partkey, c, groups, len(list_filter(kept, lambda x: len(list_distinct(list_filter(list_transform(groups[len(groups)] || [c + 1], lambda y: x[y]), lambda z: z <> ''))) > 1)) > 0 AS clash FROM g JOIN k USING (p_partkey) WHERE c < wide)),
o AS (SELECT k.p_partkey, kept, groups FROM g JOIN k ON g.p_partkey = k.p_partkey AND g.c = k.wide),
w AS (SELECT p_partkey, unnest(list_transform(kept, lambda x: list_transform(groups, lambda y: coalesce(list_filter(list_transform(y, lambda z: x[z]), lambda v: v <> '')[1], '')))) AS row, unnest(range(len(kept))) AS row_no FROM o)
SELECT p_partkey, row_no::INT AS row_no, array_to_string(row, '|') AS cells, false AS wide FROM w""")
def q_table_clean(spark, d):
    """Tables after empty columns are dropped and wrapped rows and split columns joined; a row alone is no table."""
    n = (F.col("p_partkey") % 7).cast("int")
    rows = F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda c: _cells(i, c)))
    p = table(spark, d, "part").select("p_partkey", tables.clean_table(rows).alias("rows"))
    return p.select("p_partkey", F.posexplode("rows").alias("row_no", "r")).select("p_partkey", "row_no", F.array_join("r", "|").alias("cells"), tables.is_table(F.array("r")).alias("wide"))


@query("""
WITH L1 AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l)))::INT AS line_no FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS l FROM documents)),
w AS (SELECT doc_id, line_no, unnest(l) AS w, unnest(range(len(l))) AS i FROM (SELECT doc_id, line_no, list_filter(string_split(line, ' '), lambda x: x <> '') AS l FROM L1)),
s AS (SELECT *, (doc_id + i // 3) % 4 = 1 AS bold, (doc_id + i // 2) % 3 = 1 AS italic FROM w),
g AS (SELECT *, CASE WHEN (bold, italic) IS DISTINCT FROM lag((bold, italic)) OVER (PARTITION BY doc_id, line_no ORDER BY i) THEN 1 ELSE 0 END AS c FROM s),
n AS (SELECT *, sum(c) OVER (PARTITION BY doc_id, line_no ORDER BY i) - 1 AS run_no, bool_or(bold OR italic) OVER (PARTITION BY doc_id, line_no) AS styled FROM g)
SELECT doc_id, line_no, run_no::INT AS run_no, string_agg(w || ' ', '' ORDER BY i) AS text, any_value(bold) AS bold, any_value(italic) AS italic FROM n WHERE styled GROUP BY 1, 2, 3""")
def q_runs(spark, d):
    """Words of lines in styles that change each two and three words, as runs of one style."""
    words = F.filter(F.split("line", " "), lambda w: w != "")

    def run(w, i):
        bold, italic = (doc_id() + F.floor(i / 3)) % 4 == 1, (doc_id() + F.floor(i / 2)) % 3 == 1
        return F.struct(F.concat(w, F.lit(" ")).alias("text"), bold.alias("bold"), italic.alias("italic"), F.lit(False).alias("superscript"), F.lit(None).cast("string").alias("href")).cast(RUN)

    p = once(lines(table(spark, d, "documents")), "runs", pages.emphasis(F.transform(words, run)))
    return p.select("doc_id", "line_no", F.posexplode("runs").alias("run_no", "r")).select("doc_id", "line_no", "run_no", "r.text", "r.bold", "r.italic")


def _spans(spark, d):
    """Pages of up to 12 blocks, a line each, in sizes and weights by number."""
    doc = lines(table(spark, d, "documents"), 12)
    n = F.col("line_no")
    size = (F.when((doc_id() + n) % 5 == 0, 16.0).when((doc_id() + n) % 5 == 1, 12.0).otherwise(10.0)).cast("double")
    y = (80 + (n % 12) * 50).cast("double")
    text = F.regexp_replace("line", r"[.!?:;]+$", "")
    box = F.array(F.lit(50.0), y, F.lit(400.0), y + 12)
    span = F.struct(text.alias("text"), size.alias("size"), F.lit("Serif").alias("font"), F.when((doc_id() + n) % 7 == 0, 16).otherwise(0).alias("flags"), box.alias("bbox"))
    b = F.struct(F.lit(0).alias("type"), box.alias("bbox"), F.array(F.struct(F.array(span).alias("spans"))).alias("lines")).cast(RAW_BLOCK)
    return doc.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("line_no", b.alias("b")))).alias("l")).select(
        "doc_id", "page_number", F.transform("l", lambda x: x["b"]).alias("blocks"))


_SQL_SPANS = r"""
L1 AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l)))::INT AS line_no FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS l FROM documents)),
s AS (SELECT doc_id, (line_no // 12 + 1)::INT AS page_number, line_no, regexp_replace(line, '[.!?:;]+$', '') AS text, CASE (doc_id + line_no) % 5 WHEN 0 THEN 160 WHEN 1 THEN 120 ELSE 100 END AS size,
  (doc_id + line_no) % 7 = 0 AS bold, 80 + (line_no % 12) * 50 AS y FROM L1),
b AS (SELECT doc_id, page_number, size, sum(length(text)) AS n, min(line_no) AS f FROM s WHERE NOT (y + 12 <= 72 OR y >= 728) AND trim(text) <> '' GROUP BY 1, 2, 3),
m AS (SELECT doc_id, page_number, size AS body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY n DESC, f) AS r FROM b) WHERE r = 1 AND n >= 200)"""


@query(f"WITH {_SQL_SPANS} SELECT doc_id, page_number, body / 10.0::DOUBLE AS body FROM m")
def q_body_size(spark, d):
    p = _spans(spark, d).select("doc_id", "page_number", pages.body_size(F.col("blocks"), F.lit(800.0)).alias("body"))
    return p.where("body is not null")


@query(rf"""WITH {_SQL_SPANS}, j AS (SELECT s.*, body FROM s LEFT JOIN m USING (doc_id, page_number))
SELECT doc_id, line_no, CASE WHEN body IS NULL OR length(text) > 120 OR trim(text) = '' OR regexp_matches(rtrim(text), '[.!?:;»)”]$') THEN NULL WHEN size * 100 >= body * 135 THEN 2 WHEN size * 100 >= body * 115 THEN 3
  WHEN bold AND size = body AND length(text) <= 80 THEN 3 END::INT AS level FROM j""")
def q_heading_font(spark, d):
    """Heading levels by font size and weight against the page's body size."""
    p = _spans(spark, d).withColumn("body", pages.body_size(F.col("blocks"), F.lit(800.0)))
    f = p.select("doc_id", "page_number", "body", F.posexplode("blocks").alias("at", "b")).withColumn("f", pages.font_stats(F.col("b"))).withColumn("text", pages.raw_text(F.col("b")))
    return f.select("doc_id", ((F.col("page_number") - 1) * 12 + F.col("at")).cast("int").alias("line_no"), T.heading_level(F.col("text"), F.col("f.size"), F.col("f.bold"), F.col("body")).alias("level"))


@query("""
WITH c AS (SELECT doc_id, i, ((doc_id * 5 + i * i) % 7 < 3) AS c FROM documents, range(10) r(i)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS island FROM c),
p AS (SELECT *, CASE WHEN c THEN row_number() OVER (PARTITION BY doc_id, c, island ORDER BY i) ELSE 0 END AS place FROM g)
SELECT doc_id, i::INT AS at, place % 2 = 1 AS caption, coalesce(lag(place) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1, false) AS code FROM p""")
def q_caption_code(spark, d):
    """Which of ten blocks are listing captions and which code, where some would be captions."""
    p = table(spark, d, "documents").select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (doc_id() * 5 + i * i) % 7 < 3).alias("c"))
    return p.select("doc_id", F.posexplode(pages.caption_parity(F.col("c"))).alias("at", "x")).select("doc_id", "at", "x.caption", "x.code")


@query("""
WITH L1 AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l)))::INT AS n FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS l FROM documents)),
m AS (SELECT doc_id, n // 6 + 1 AS b, n, trim(line) AS t, (doc_id + n) % 2 = 0 AS marked FROM L1 WHERE trim(line) <> ''),
g AS (SELECT *, sum(marked::INT) OVER (PARTITION BY doc_id, b ORDER BY n) AS item FROM m), k AS (SELECT doc_id, b FROM m GROUP BY 1, 2 HAVING sum(marked::INT) >= 2),
r AS (SELECT doc_id, b, item, string_agg(t, ' ' ORDER BY n) AS text, CASE WHEN item > 0 THEN true END AS ordered FROM g JOIN k USING (doc_id, b) GROUP BY 1, 2, 3)
SELECT doc_id, b::INT AS block, (row_number() OVER (PARTITION BY doc_id, b ORDER BY item) - 1)::INT AS at, text, ordered FROM r""")
def q_multi_item(spark, d):
    """Blocks of six lines, each other one marked by a number: glued list items."""
    six = lines(table(spark, d, "documents"), 6)
    n = F.col("line_no")
    marked = six.withColumn("line", F.when((doc_id() + n) % 2 == 0, F.concat((n % 6 + 1).cast("string"), F.lit(". "), "line")).otherwise(F.col("line")))
    blocks = marked.groupBy("doc_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("l"))
    p = blocks.select("doc_id", F.col("page_number").alias("block"), pages.list_items(F.col("l")).alias("items"))
    return p.where("items is not null").select("doc_id", "block", F.posexplode("items").alias("at", "x")).select("doc_id", "block", "at", "x.text", "x.ordered")


_CLEAN = sql_clean("line")


@query(rf"""WITH {_SQL_SPANS}, j AS (SELECT s.*, body, {_CLEAN.replace("line", "text")} AS clean FROM s LEFT JOIN m USING (doc_id, page_number)),
t AS (SELECT doc_id, page_number, line_no, CASE WHEN level IS NOT NULL THEN 'h' WHEN regexp_matches(trim(clean), {_MARKED}) THEN 'li' ELSE 'p' END AS type, CASE WHEN level IS NOT NULL THEN trim(clean) ELSE clean END AS text, level
  FROM (SELECT *, CASE WHEN body IS NULL OR length(clean) > 120 OR regexp_matches(rtrim(clean), {_ENDED}) THEN NULL WHEN size * 100 >= body * 135 THEN 2 WHEN size * 100 >= body * 115 THEN 3 WHEN bold AND size = body AND length(clean) <= 80 THEN 3 END::INT AS level
    FROM j WHERE trim(clean) <> '' AND (doc_id + page_number) % 5 <> 0)),
-- the pages read from detections: rows of one height, so paragraphs end where a row does, or where one begins with a number or mark
o AS (SELECT *, lag(rtrim(text)) OVER w AS before FROM s WHERE trim(text) <> '' AND (doc_id + page_number) % 5 = 0 WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY line_no)),
k AS (SELECT *, CASE WHEN before IS NULL OR regexp_matches(before, {_ENDED}) OR regexp_matches(before, {_TRAILING}) OR regexp_matches(text, {_LEADING}) OR regexp_matches(text, {_MARKED})
  OR line_no - lag(line_no) OVER (PARTITION BY doc_id, page_number ORDER BY line_no) > 1 THEN 1 ELSE 0 END AS c FROM o),
i AS (SELECT *, sum(c) OVER (PARTITION BY doc_id, page_number ORDER BY line_no) AS par FROM k),
p AS (SELECT doc_id, page_number, min(line_no) AS line_no, string_agg(CASE WHEN last THEN text ELSE rtrim(text) END, ' ' ORDER BY line_no) AS line FROM (SELECT *, lead(line_no) OVER (PARTITION BY doc_id, page_number, par ORDER BY line_no) IS NULL AS last FROM i) GROUP BY doc_id, page_number, par),
q AS (SELECT doc_id, page_number, line_no, trim({_CLEAN}) AS text FROM p),
u AS (SELECT * FROM t UNION ALL SELECT doc_id, page_number, line_no, CASE WHEN {_sql_numeric("text")} THEN 'p_numeric' WHEN regexp_matches(text, {_MARKED}) THEN 'li' ELSE 'p' END, text, NULL FROM q WHERE text <> '')
SELECT doc_id, page_number, 0 AS n_margin, (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no) - 1)::INT AS at, type, text, level FROM u""")
def q_extract(spark, d):
    """Whole extraction: pages of spans, a fifth of them garbled and read from detections instead."""
    p = _spans(spark, d).withColumn("width", F.lit(600.0)).withColumn("height", F.lit(800.0))
    bad = (doc_id() + F.col("page_number")) % 5 == 0
    noise = F.array(F.struct(F.lit(0).alias("type"), F.array(F.lit(50.0), F.lit(90.0), F.lit(400.0), F.lit(700.0)).alias("bbox"), F.array(F.struct(F.array(F.struct(
        F.repeat(F.lit("\x01"), 40).alias("text"), F.lit(10.0).alias("size"), F.lit("Serif").alias("font"), F.lit(0).alias("flags"), F.array(F.lit(50.0), F.lit(90.0), F.lit(400.0), F.lit(700.0)).alias("bbox"))).alias("spans"))).alias("lines")).cast(RAW_BLOCK))
    from pagewright.schema import DETECTION, LINK, RAW_TABLE

    def seen(b, i):
        y = 400 + i * 30
        return F.struct(F.array(*[F.array(F.lit(float(x)), y + dy) for x, dy in ((200, 0.0), (1500, 0.0), (1500, 22.0), (200, 22.0))]).alias("poly"), pages.raw_text(b).alias("text"), F.lit(0.9).alias("conf")).cast(DETECTION)

    raw = p.select(
        "doc_id", "page_number", "width", "height", F.when(bad, noise).otherwise(F.col("blocks")).alias("blocks"), F.array().cast(f"array<{RECT}>").alias("drawings"), F.array().cast(f"array<{LINK}>").alias("links"),
        F.array().cast(f"array<{RAW_TABLE}>").alias("raw_tables"), F.transform("blocks", seen).alias("ocr"),
    )
    f = pages.extract(raw)
    return f.select("doc_id", "page_number", F.size("margin").alias("n_margin"), F.posexplode("blocks").alias("at", "b")).select("doc_id", "page_number", "n_margin", "at", "b.type", "b.text", "b.level")
