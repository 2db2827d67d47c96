"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, digits, plus signs, schemes and identifier
cues. Around each, a deterministic local parser expands to the boundaries of an e-mail address,
IP address, card, phone or account number and validates it. All spans are in code points.

Base kinds follow one rule each: leftmost matches that don't overlap within the kind, those that
fail their check dropped without another try. The parsers add: `userinfo` (user:password of a
URL), `iban` (after the cue; ISO 13616 check digits), `ssn` (after the cue) and `account` (after
an account cue; 6 to 20 digits).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import table

KINDS = ("email", "ip", "card", "phone", "userinfo", "iban", "ssn", "account")
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account"}
SCHEME = "://"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]+:[^\s/@:]+(?=@)")
_GAP = r"(?:\s+(?:number|no|nr|id))?[\s:#.=]{1,4}"
_AFTER = {
    "iban": re.compile(_GAP + r"(?P<x>[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])"),
    "ssn": re.compile(_GAP + r"(?P<x>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"),
    "account": re.compile(_GAP + r"(?P<x>[0-9](?:-?[0-9]){5,19})(?![0-9A-Za-z])"),
}


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def _part(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and int(digits) <= 255


def _iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "@+0123456789":
        a.add_word(c, c)
    a.add_word(SCHEME, SCHEME)
    for cue in CUES:
        for form in {cue, cue.upper(), cue.title(), cue.capitalize()}:
            a.add_word(form, cue)
    a.make_automaton()
    return a


def find(text: str, anchors) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of all spans of text, sorted."""
    out: list[tuple[int, int, int]] = []
    email = ip = card = phone = 0  # where the kind's last match ended
    digits_until = 0  # the run of digits seen last ends here
    for end, what in anchors.iter(text):
        if what in _DIGITS:
            if end < digits_until:
                continue
            m = None
            if end >= ip and (m := _IP.match(text, end)):
                ip = m.end()
                if all(map(_part, m[0].split("."))):
                    out.append((end, 1, ip))
            if end >= card and (m := _CARD.match(text, end)):
                card = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((end, 2, card))
            digits_until = end + 1
            n = len(text)
            while digits_until < n and text[digits_until] in _DIGITS:
                digits_until += 1
        elif what == "@":
            start = end
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < end and (m := _DOMAIN.match(text, end + 1)):
                email = m.end()
                out.append((start, 0, email))
        elif what == "+":
            if end >= phone and (m := _PHONE.match(text, end)):
                phone = m.end()
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    out.append((end, 3, phone))
        elif what == SCHEME:
            if m := _USERINFO.match(text, end + 1):
                out.append((m.start(), 4, m.end()))
        else:
            start = end - len(what)
            kind = CUES[what]
            if (start < 0 or not text[start].isalnum()) and (m := _AFTER[kind].match(text, end + 1)):
                if kind != "iban" or _iban(m["x"]):
                    out.append((m.start("x"), KINDS.index(kind), m.end("x")))
    return sorted(set(out))


def covers(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that overlap, merged; each takes the kind of its first."""
    out: list[tuple[int, int, int]] = []
    for s, k, e in spans:
        if out and s < out[-1][2]:
            out[-1] = (*out[-1][:2], max(e, out[-1][2]))
        else:
            out.append((s, k, e))
    return out


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    parts, at = [], 0
    for s, k, e in covers(spans):
        parts += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join([*parts, text[at:]])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _run(schema: pa.Schema, keep: list[str], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            spans, texts = [], []
            for x in batch.column("text"):
                t = x.as_py()
                own = find(t, anchors) if t else []
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in own])
                if with_text:
                    texts.append(redact(t, own) if own else t)
            columns = {c: batch.column(c) for c in keep} | {"spans": pa.array(spans, schema.field("spans").type)}
            if with_text:
                columns["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)

    return run


def find_personal_data(docs: DataFrame, columns: list[str] | None = None, redacted: bool = False) -> DataFrame:
    """docs' `columns` (all but text if not given) and spans array<struct<kind, start, end>>, by start, then kind as listed.

    With redacted, the column text comes too, each span replaced by its kind, as [EMAIL]; spans that
    overlap go as one, under the first's kind. Null and empty texts have no spans; null stays null. A
    column named spans is replaced. Rows are independent; none is dropped or repeated.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = [c for c in (columns or docs.columns) if c not in ("text", "spans")]
    fields = [docs.schema[c] for c in keep] + ([T.StructField("text", T.StringType())] if redacted else [])
    schema = T.StructType([*fields, T.StructField("spans", SPANS)])
    return docs.select(*keep, "text").mapInArrow(_run(to_arrow_schema(schema), keep, redacted), schema)


def op8_pii_anchor_expansion(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"), ["doc_id"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS[:4]))
    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op8_pii_anchor_expansion": op8_pii_anchor_expansion}
ORACLES: dict[str, str] = {}
