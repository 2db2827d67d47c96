"""Queries over lines: cleaning, predicates, markers, running heads, links and rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions.steps import once
from pagewright.operators import links as link_ops
from pagewright.operators import render
from pagewright.operators.pages import block
from pagewright.operators.phrases import phrase_counts
from pagewright.plans.inputs import SQL_BLOCKS, SQL_LINES, fragments, injected, sql_clean, table, titles
from pagewright.schema import BULLETS
from pagewright.sources.readers import html_links, lines

KEY = ("doc_id", "line_no")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {SQL_LINES} SELECT doc_id, line_no, {sql_clean('text')} AS cleaned FROM L")
def q_clean(spark, d):
    return injected(spark, d).select(*KEY, T.clean(F.col("text"), False).alias("cleaned"))


@query(f"WITH {SQL_LINES}, N AS (SELECT doc_id, line_no, 'fi1 ' || text AS text FROM L) SELECT doc_id, line_no, {sql_clean('text')} AS cleaned FROM N")
def q_nfkc(spark, d):
    """Two compatibility characters before each line, which has none itself."""
    return injected(spark, d).select(*KEY, T.clean(F.concat(F.lit("ﬁ① "), "text")).alias("cleaned"))


@query(r"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN translate(coalesce(text, ''), 'ent', chr(1) || chr(2) || chr(3)) ELSE coalesce(text, '') END AS raw FROM documents)
SELECT doc_id, length(raw) >= 20 AND length(regexp_replace(raw, '[^\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) > length(raw) * 0.2 AS garbled FROM t""")
def q_garbled(spark, d):
    text = F.coalesce("text", F.lit(""))
    raw = F.when(F.col("doc_id") % 2 == 0, F.translate(text, "ent", "\x01\x02\x03")).otherwise(text)
    return table(spark, d, "documents").select("doc_id", T.is_garbled(raw).alias("garbled"))


@query(rf"""WITH {SQL_LINES} SELECT doc_id, line_no, length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) >= 4
  AND length(regexp_replace(text, '[^\p{{Nd}}]', '', 'g')) >= length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) * 0.6 AS numeric FROM L""")
def q_numeric_heavy(spark, d):
    return injected(spark, d).select(*KEY, T.is_numeric_heavy(F.col("text")).alias("numeric"))


@query(rf"""WITH {SQL_LINES}, m AS (SELECT doc_id, line_no, text, 20.0 + 95 * (line_no % {8}) AS y0 FROM L)
SELECT doc_id, line_no, length(text) > 0 AND length(text) <= 70 AND (y0 + 12 <= 800 * 0.09 OR y0 >= 800 * (1 - 0.09)) AS margin, regexp_matches(trim(text), '^[0-9]{{1,4}}[.,]?$') AS page_number_like FROM m""")
def q_margin(spark, d):
    m = injected(spark, d).withColumn("y0", F.lit(20.0) + F.lit(95) * (F.col("line_no") % 8))
    return m.select(*KEY, T.is_margin_text(F.col("y0"), F.col("y0") + 12, F.lit(800.0), F.col("text")).alias("margin"), T.is_page_number(F.col("text")).alias("page_number_like"))


@query(rf"""
WITH {SQL_LINES}, m AS (SELECT doc_id, line_no, trim(CASE line_no % 3 WHEN 0 THEN (line_no + 1)::VARCHAR || ' Head ' || text WHEN 1 THEN 'Head ' || line_no::VARCHAR ELSE text END) AS t FROM L),
s AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(t, '^[0-9]{{1,4}}\s+\S.*$') THEN [regexp_extract(t, '^([0-9]{{1,4}})\s+(\S.*)$', 1), regexp_extract(t, '^([0-9]{{1,4}})\s+(\S.*)$', 2)]
  WHEN regexp_matches(t, '^.*\S\s+[0-9]{{1,4}}$') THEN [regexp_extract(t, '^(.*\S)\s+([0-9]{{1,4}})$', 1), regexp_extract(t, '^(.*\S)\s+([0-9]{{1,4}})$', 2)] ELSE [t] END AS a FROM m)
SELECT doc_id, line_no, len(a)::INT AS n, a[1] AS first, a[len(a)] AS last FROM s""")
def q_split_margin(spark, d):
    n, t = F.col("line_no"), F.col("text")
    m = F.when(n % 3 == 0, F.concat((n + 1).cast("string"), F.lit(" Head "), t)).when(n % 3 == 1, F.concat(F.lit("Head "), n.cast("string"))).otherwise(t)
    s = injected(spark, d).select(*KEY, T.split_margin_number(m).alias("a"))
    return s.select(*KEY, F.size("a").alias("n"), F.get("a", F.lit(0)).alias("first"), F.element_at("a", -1).alias("last"))


@query(rf"""WITH {SQL_LINES}, t AS (SELECT doc_id, line_no, trim(text) AS x FROM L)
SELECT doc_id, line_no, CASE WHEN regexp_matches(x, '^[{BULLETS}]\s+\S.*$') THEN regexp_extract(x, '^[{BULLETS}]\s+(\S.*)$', 1) WHEN regexp_matches(x, '^[0-9]{{1,2}}[.)]\s+\S.*$') THEN regexp_extract(x, '^[0-9]{{1,2}}[.)]\s+(\S.*)$', 1) END AS item,
  CASE WHEN regexp_matches(x, '^[{BULLETS}]\s+\S.*$') THEN false WHEN regexp_matches(x, '^[0-9]{{1,2}}[.)]\s+\S.*$') THEN true END AS ordered FROM t""")
def q_list_markers(spark, d):
    return injected(spark, d).withColumn("m", T.list_item(T.strip(F.col("text")))).select(*KEY, F.col("m.item").alias("item"), F.col("m.ordered").alias("ordered"))


@query(rf"""WITH {SQL_BLOCKS}, K AS (SELECT *, CASE WHEN type = 'li' THEN CASE WHEN ordered THEN 'ol' ELSE 'ul' END END AS kind FROM B),
g AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id, page_number ORDER BY line_no) THEN 1 ELSE 0 END AS c FROM K),
i AS (SELECT *, sum(c) OVER (PARTITION BY doc_id, page_number ORDER BY line_no) AS island FROM g)
SELECT doc_id, page_number, min(line_no)::INT AS first_line, any_value(kind) AS kind, count(*)::BIGINT AS items FROM i WHERE kind IS NOT NULL GROUP BY doc_id, page_number, island""")
def q_list_groups(spark, d):
    """Lists of a page's flow in HTML: where each opens, its kind and items."""
    p = once(fragments(spark, d), "parts", render.flow_html(F.col("blocks"))).select("doc_id", "page_number", "parts")
    opens = F.filter(F.transform("parts", lambda x, i: F.when(x.isin("<ol>", "<ul>"), F.struct(F.substr(x, F.lit(2), F.lit(2)).alias("kind"), i.alias("i")))), lambda x: x.isNotNull())
    tag = lambda x: x.isin("<ol>", "<ul>", "</ol>", "</ul>")

    def found(o: Column) -> Column:
        """A block makes one part, but for the tags round lists."""
        closes = F.array_min(F.filter(F.transform("parts", lambda x, j: F.when((j > o["i"]) & (x == F.concat(F.lit("</"), o["kind"], F.lit(">"))), j)), lambda j: j.isNotNull()))
        return F.struct(F.size(F.filter(F.slice("parts", F.lit(1), o["i"]), lambda x: ~tag(x))).alias("at"), o["kind"].alias("kind"), (closes - o["i"] - 1).cast("long").alias("items"))

    rows = p.select("doc_id", "page_number", F.explode(F.transform(opens, found)).alias("x"))
    return rows.select("doc_id", "page_number", ((F.col("page_number") - 1) * 8 + F.col("x.at")).cast("int").alias("first_line"), "x.kind", "x.items")


@query("""
WITH p AS (SELECT conv_id AS doc_id, turn::INT AS page_number, CASE WHEN turn % 4 = 3 THEN [turn::VARCHAR] ELSE ['Chapter ' || (turn // 3)::VARCHAR, turn::VARCHAR] END AS margin FROM conversations),
w AS (SELECT *, lag(list_filter(margin, lambda m: NOT regexp_matches(m, '^[0-9]{1,4}[.,]?$'))) OVER (PARTITION BY doc_id ORDER BY page_number) AS prev FROM p)
SELECT doc_id, page_number, array_to_string(list_filter(margin, lambda m: regexp_matches(m, '^[0-9]{1,4}[.,]?$') OR NOT list_contains(coalesce(prev, []), m)), '|') AS shown FROM w""")
def q_running_heads(spark, d):
    t = F.col("turn")
    margin = F.when(t % 4 == 3, F.array(t.cast("string"))).otherwise(F.array(F.concat(F.lit("Chapter "), F.floor(t / 3).cast("string")), t.cast("string")))
    p = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), t.cast("int").alias("page_number"), margin.alias("margin"))
    return render.hide_running_heads(p).select("doc_id", "page_number", F.array_join("margin_display", "|").alias("shown"))


def _sql_md(x: str) -> str:
    return rf"regexp_replace({x}, '([\\`*_\[\]<>&])', '\\\1', 'g')"


def _sql_guard(x: str) -> str:
    return rf"CASE WHEN left({x}, 1) IN ('#', '-', '+') THEN '\' || {x} WHEN regexp_matches({x}, '^[0-9]+\.(\s|$)') THEN regexp_replace({x}, '^([0-9]+)\.', '\1\\.') ELSE {x} END"


def _sql_link_md(x: str) -> str:
    url = r"https://ex\.org/p[0-9]+\?a=1&b=2"
    linked = f"{_sql_md(f'''split_part({x}, 'https://ex', 1)''')} || '[' || regexp_extract({x}, '{url}') || '](' || regexp_extract({x}, '{url}') || ')' || {_sql_md(f'''regexp_replace({x}, '^.*{url}', '')''')}"
    return _sql_guard(f"(CASE WHEN contains({x}, 'https://ex') THEN {linked} ELSE {_sql_md(x)} END)")


SQL_MD = rf"""{SQL_BLOCKS}, M AS (SELECT doc_id, page_number, line_no, CASE type
  WHEN 'h' THEN repeat('#', level::INT) || ' ' || {_sql_guard(_sql_md("text"))}
  WHEN 'code' THEN '```' || chr(10) || text || chr(10) || '```'
  WHEN 'li' THEN (CASE WHEN ordered THEN '1. ' ELSE '- ' END) || {_sql_link_md("text")}
  WHEN 'table' THEN '| n | line\| |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || line_no::VARCHAR || ' | ' || coalesce(nullif(replace({_sql_guard(_sql_md("text"))}, '|', '\|'), ''), ' ') || ' |'
  ELSE {_sql_link_md("text")} END AS md FROM B)"""


@query(f"WITH {SQL_MD} SELECT doc_id, line_no, md FROM M")
def q_md_blocks(spark, d):
    rows = fragments(spark, d).select("doc_id", "page_number", F.posexplode("blocks").alias("at", "b"))
    return rows.select("doc_id", ((F.col("page_number") - 1) * 8 + F.col("at")).cast("int").alias("line_no"), render.block_md(F.col("b")).alias("md"))


def _sql_html(x: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{raw}', '{safe}')"
    return x


def _sql_link_html(x: str) -> str:
    url = r"https://ex\.org/p[0-9]+\?a=1&b=2"
    u = _sql_html(f"regexp_extract({x}, '{url}')")
    linked = f"""{_sql_html(f"split_part({x}, 'https://ex', 1)")} || '<a href="' || {u} || '">' || {u} || '</a>' || {_sql_html(f"regexp_replace({x}, '^.*{url}', '')")}"""
    return f"(CASE WHEN contains({x}, 'https://ex') THEN {linked} ELSE {_sql_html(x)} END)"


@query(rf"""WITH {SQL_BLOCKS} SELECT doc_id, line_no, CASE type
  WHEN 'h' THEN '<h' || level::VARCHAR || '>' || {_sql_html("text")} || '</h' || level::VARCHAR || '>'
  WHEN 'code' THEN '<pre><code>' || {_sql_html("text")} || '</code></pre>'
  WHEN 'li' THEN (CASE WHEN ordered THEN '<ol><li>' ELSE '<ul><li>' END) || {_sql_link_html("text")} || (CASE WHEN ordered THEN '</li></ol>' ELSE '</li></ul>' END)
  WHEN 'table' THEN '<table>' || chr(10) || '<tr><th>n</th><th>line|</th></tr>' || chr(10) || '<tr><td>' || line_no::VARCHAR || '</td><td>' || {_sql_html("text")} || '</td></tr>' || chr(10) || '</table>'
  ELSE '<p>' || {_sql_link_html("text")} || '</p>' END AS html FROM B""")
def q_html_blocks(spark, d):
    rows = fragments(spark, d).select("doc_id", "page_number", F.posexplode("blocks").alias("at", "b"))
    return rows.select("doc_id", ((F.col("page_number") - 1) * 8 + F.col("at")).cast("int").alias("line_no"), render.block_html(F.col("b")).alias("html"))


def _sql_pages(body: str, head: str, callout: str) -> str:
    """Pages: margin with heads hidden, blocks, callout."""
    return rf"""P AS (SELECT doc_id, page_number, string_agg({body}, chr(10) || chr(10) ORDER BY line_no) FILTER (trim({body}) <> '') AS body, page_number // 2 AS h FROM M GROUP BY doc_id, page_number),
W AS (SELECT *, lag(h) OVER (PARTITION BY doc_id ORDER BY page_number) AS before FROM P),
G AS (SELECT doc_id, page_number, {head} || chr(10) || chr(10) || body || CASE WHEN page_number % 3 = 0 THEN chr(10) || chr(10) || {callout} ELSE '' END AS body FROM W)"""


_HEAD = "(CASE WHEN h IS NOT DISTINCT FROM before THEN '' ELSE 'Chapter ' || h::VARCHAR || ' · ' END) || page_number::VARCHAR"


@query(rf"""WITH {SQL_MD}, {_sql_pages("md", f"'*' || {_HEAD} || '*'", r"'> Mind \*this\* \& that'")}
SELECT doc_id, '# Doc <' || doc_id::VARCHAR || '>' || chr(10) || chr(10) || string_agg(body, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_number) || chr(10) AS content FROM G GROUP BY doc_id""")
def q_document_md(spark, d):
    """The flagship: documents of blocks in Markdown, pages in order, running heads shown once."""
    return render.render_documents(fragments(spark, d), titles(spark, d), "md")


@query(rf"""WITH {SQL_BLOCKS}, M AS (SELECT doc_id, page_number, line_no, CASE type WHEN 'li' THEN '  - ' || text
  WHEN 'table' THEN rpad('n', greatest(1, length(line_no::VARCHAR))::INT, ' ') || '  ' || rpad('line|', greatest(5, length(text))::INT, ' ') || chr(10) || repeat('-', greatest(1, length(line_no::VARCHAR))::INT) || '  ' || repeat('-', greatest(5, length(text))::INT) || chr(10)
    || rpad(line_no::VARCHAR, greatest(1, length(line_no::VARCHAR))::INT, ' ') || '  ' || rpad(text, greatest(5, length(text))::INT, ' ')
  ELSE text END AS txt FROM B), {_sql_pages("txt", f"'[' || {_HEAD} || ']'", "'    Mind *this* & that'")}
SELECT doc_id, 'Doc <' || doc_id::VARCHAR || '>' || chr(10) || repeat('=', length('Doc <' || doc_id::VARCHAR || '>')) || chr(10) || chr(10)
  || string_agg(body, chr(10) || chr(10) || '----------' || chr(10) || chr(10) ORDER BY page_number) || chr(10) AS content FROM G GROUP BY doc_id""")
def q_document_txt(spark, d):
    return render.render_documents(fragments(spark, d), titles(spark, d), "txt")


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_FRAME = ['<!DOCTYPE html>\n<html lang="ru">\n<head>\n<meta charset="utf-8">\n<meta name="viewport" content="width=device-width, initial-scale=1">\n<title>', "</title>\n<style>\n" + "\n".join(render.STYLE) + "\n</style>\n</head>\n<body>\n<h1>", "</h1>\n", "\n</body>\n</html>"]
_HTML = rf"""CASE type
  WHEN 'h' THEN '<h' || level::VARCHAR || '>' || {_sql_html("text")} || '</h' || level::VARCHAR || '>'
  WHEN 'code' THEN '<pre><code>' || {_sql_html("text")} || '</code></pre>'
  WHEN 'li' THEN CASE WHEN kind IS DISTINCT FROM before THEN '<' || kind || '>' || chr(10) ELSE '' END || '<li>' || {_sql_link_html("text")} || '</li>' || CASE WHEN kind IS DISTINCT FROM after THEN chr(10) || '</' || kind || '>' ELSE '' END
  WHEN 'table' THEN '<table>' || chr(10) || '<tr><th>n</th><th>line|</th></tr>' || chr(10) || '<tr><td>' || line_no::VARCHAR || '</td><td>' || {_sql_html("text")} || '</td></tr>' || chr(10) || '</table>'
  ELSE '<p>' || {_sql_link_html("text")} || '</p>' END"""


@query(rf"""WITH {SQL_BLOCKS}, K AS (SELECT *, CASE WHEN type = 'li' THEN CASE WHEN ordered THEN 'ol' ELSE 'ul' END END AS kind FROM B),
N AS (SELECT *, lag(kind) OVER w AS before, lead(kind) OVER w AS after FROM K WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY line_no)),
P AS (SELECT doc_id, page_number, page_number // 2 AS h, string_agg({_HTML}, chr(10) ORDER BY line_no) AS body FROM N GROUP BY doc_id, page_number),
W AS (SELECT *, lag(h) OVER (PARTITION BY doc_id ORDER BY page_number) AS before FROM P),
G AS (SELECT doc_id, page_number, '<section class="page" id="page-' || page_number::VARCHAR || '">' || chr(10) || '<p class="page-meta">' || {_HEAD} || '</p>' || chr(10) || body
  || CASE WHEN page_number % 3 = 0 THEN {_sql_text(chr(10) + '<aside class="callout">' + chr(10) + "<p>Mind *this* &amp; that</p>" + chr(10) + "</aside>")} ELSE '' END || chr(10) || '</section>' AS body FROM W),
T AS (SELECT doc_id, 'Doc &lt;' || doc_id::VARCHAR || '&gt;' AS title, string_agg(body, chr(10) ORDER BY page_number) AS body FROM G GROUP BY doc_id)
SELECT doc_id, {_sql_text(_FRAME[0])} || title || {_sql_text(_FRAME[1])} || title || {_sql_text(_FRAME[2])} || body || {_sql_text(_FRAME[3])} AS content FROM T""")
def q_document_html(spark, d):
    return render.render_documents(fragments(spark, d), titles(spark, d), "html")


@query(r"""WITH u AS (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN ').' WHEN 1 THEN '' ELSE '!?' END AS raw FROM pages)
SELECT page_id, regexp_replace(raw, '[).,;:!?»]+$', '') AS url, regexp_replace(raw, '[).,;:!?»]+$', '') AS href, substr(raw, length(regexp_replace(raw, '[).,;:!?»]+$', '')) + 1) AS trailing FROM u""")
def q_linkify(spark, d):
    raw = F.concat("url", F.when(F.col("page_id") % 3 == 0, ").").when(F.col("page_id") % 3 == 1, "").otherwise("!?"))
    return table(spark, d, "pages").select("page_id", T.url_parts(raw).alias("u")).select("page_id", "u.url", "u.href", "u.trailing")


_ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>"""


@query(f"""WITH a AS (SELECT page_id, regexp_extract_all(html, '{_ANCHOR}', 1) AS h, regexp_extract_all(html, '{_ANCHOR}', 2) AS t FROM pages),
b AS (SELECT page_id, unnest(h) AS href, unnest(t) AS t, unnest(range(len(h))) AS place FROM a)
SELECT page_id, href, trim(regexp_replace(t, '<[^>]*>', '', 'g')) AS text, count(*)::BIGINT AS n FROM b WHERE href <> '' GROUP BY ALL""")
def q_html_links(spark, d):
    found = table(spark, d, "pages").select("page_id", F.explode(html_links(F.col("html"))).alias("a"))
    return found.groupBy("page_id", F.col("a.href").alias("href"), F.col("a.text").alias("text")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""
WITH b AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(replace(text, chr(10), ' '), '[^.!?]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '') AS s FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT item_id, unnest(s) AS phrase, unnest(range(len(s)))::INT AS sentence FROM b),
d AS (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents WHERE text IS NOT NULL)
SELECT doc_id, item_id, sentence, ((length(text) - length(replace(text, phrase, ''))) // length(phrase))::BIGINT AS n FROM d JOIN w ON contains(text, phrase)""")
def q_phrases(spark, d):
    """Places of all benchmark sentences, whole, in all documents."""
    flat = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    sentences = F.filter(F.transform(F.regexp_extract_all(flat, F.lit("[^.!?]+[.!?]*"), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")
    items = table(spark, d, "benchmark").where("text is not null").select("item_id", F.posexplode(sentences).alias("sentence", "phrase"))
    return phrase_counts(table(spark, d, "documents").select("doc_id", flat.alias("text")), items)


@query(r"""
WITH l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x)))::INT AS line_no FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS x FROM documents)),
w AS (SELECT doc_id, line_no, line, string_split(line, ' ')[3] AS phrase FROM l WHERE length(string_split(line, ' ')[3]) > 0),
g AS (SELECT doc_id, line_no, phrase, string_split(line, phrase) AS g FROM w),
p AS (SELECT doc_id, line_no, k, CASE WHEN k % 2 = 0 THEN g[k // 2 + 1] ELSE phrase END AS text, CASE WHEN k % 2 = 1 THEN 'https://ex.org/' || doc_id::VARCHAR END AS href FROM (SELECT *, unnest(range(2 * len(g) - 1)) AS k FROM g))
SELECT doc_id, line_no, (row_number() OVER (PARTITION BY doc_id, line_no ORDER BY k) - 1)::INT AS at, text, href FROM p WHERE text <> ''""")
def q_phrase_links(spark, d):
    """Runs of paragraphs, a line each, after a dictionary's links are put on them: the line's own third word."""
    own = lines(table(spark, d, "documents"))
    phrase = F.get(F.split("line", " "), F.lit(2))
    p = own.where(F.length(phrase) > 0).select("doc_id", "line_no", "line", phrase.alias("phrase"))
    # each line is a document of one paragraph here: a line has a dictionary of its own
    key = F.xxhash64("doc_id", "line_no")
    fragments_ = p.select(key.alias("doc_id"), F.struct("doc_id", "line_no").alias("place"), F.array(block("p", text=F.col("line"))).alias("blocks"))
    known = p.select(key.alias("doc_id"), "phrase", F.concat(F.lit("https://ex.org/"), F.col("doc_id").cast("string")).alias("href"))
    runs = link_ops.link_phrases(fragments_, known).select("place", F.posexplode(F.get("blocks", F.lit(0))["runs"]).alias("at", "run"))
    return runs.select("place.doc_id", "place.line_no", "at", "run.text", "run.href")
