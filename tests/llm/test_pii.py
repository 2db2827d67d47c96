import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import pii
from tests.conftest import DATA_01

ANCHORS = pii.automaton()
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes(kind, s):
    d = re.sub(r"\D", "", s, flags=re.A)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        total = 0
        for i, c in enumerate(reversed(d)):
            x = int(c) * (1 + i % 2)
            total += x - 9 if x > 9 else x
        return 12 <= len(d) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def brute(text):
    return sorted((m.start(), list(BASE).index(k), m.end()) for k, r in BASE.items() for m in r.finditer(text) if passes(k, m[0]))


PIECES = st.sampled_from(["a", "B", "é", "@", "@b.c", ".", "..", "-", " ", "+", "+1", "(", ")", "1", "0", "255", "256", "1.2.3.4", ".7", "4111 1111 1111 1111", "4111-1111-1111-1111", "5", "%", "_", "\n", "12345678", "x.y", "-1"])


@settings(max_examples=3000, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_base_spans(text):
    assert [x for x in pii.find(text, ANCHORS) if x[1] < 4] == brute(text)


def test_added_kinds_and_redaction():
    def found(t):
        return [(pii.KINDS[k], t[s:e]) for s, k, e in pii.find(t, ANCHORS) if k >= 4]

    assert found("see https://joe:pw1@host.example/x") == [("userinfo", "joe:pw1")]
    assert found("IBAN: DE89 3704 0044 0532 0130 00.") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert found("IBAN: DE88 3704 0044 0532 0130 00.") == []
    assert found("ssn 123-45-6789, class 123-45-6789") == [("ssn", "123-45-6789")]
    assert found("Account number: 0012-345678") == [("account", "0012-345678")]
    assert found("on that account 5 men") == [] and found("discount: 123456789") == []
    t = "mail a@b.co, call +1 (555) 555-3824 now"
    assert pii.redact(t, pii.find(t, ANCHORS)) == "mail [EMAIL], call [PHONE] now"
    assert pii.find("9" * 10_000 + ".1.1.1", ANCHORS) == []


def test_documents(spark):
    rows = spark.read.parquet(f"{DATA_01}/documents.parquet").collect()
    got = {r.doc_id: r for r in pii.op8_pii_anchor_expansion(spark, DATA_01).collect()}
    assert len(got) == len(rows) and sum(r.n_email for r in got.values()) > 5 and sum(r.n_phone for r in got.values()) > 5
    for r in rows:
        want = brute(r.text or "")
        s = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(s.encode()).hexdigest()


def test_edges(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "x a@b.co y", 7), (4, "clean", 8), (3, "x a@b.co y", 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted((r.doc_id, r.text or "", [(x.kind, x.start, x.end) for x in r.spans]) for r in pii.find_personal_data(d, redacted=True).collect())
    assert got == [(1, "", []), (2, "", []), (3, "x [EMAIL] y", [("email", 2, 8)]), (3, "x [EMAIL] y", [("email", 2, 8)]), (4, "clean", [])]
    assert pii.find_personal_data(d.where("false")).collect() == []
