import hashlib

import duckdb
from hypothesis import given
from hypothesis import strategies as st

from pagewright.llm import chat
from tests.conftest import DATA_01

BITS = st.lists(st.sampled_from(["<", "|", "\\", "im_end", "|>", chat.START, chat.END, "a", "\n", "é", "<\\|"]), max_size=9).map("".join)


@given(st.lists(st.tuples(BITS, BITS), max_size=4))
def test_round_trip(turns):
    out = "".join(chat.render(r, t) for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.read(out)] == turns
    assert out.count(chat.START) == out.count(chat.END) == len(turns)
    assert all(chat.unescape(out[a:b]) == t for _, t, a, b in chat.read(out))


def test_conversations_and_sql(spark):
    df = chat.op2_chat_formatting(spark, DATA_01)
    got = sorted(map(tuple, df.collect()))
    duckdb.sql(f"create or replace view conversations as select * from '{DATA_01}/conversations.parquet'")
    sql = duckdb.sql(chat.ORACLE)
    assert sorted(sql.fetchall()) == got and sql.columns == df.columns
    assert got[0][:2] == (-1, 2) and got[0][3] == len(chat.PROBE)


def fold(events):
    """One conversation's events, in order, by the rules themselves."""
    messages = {}
    for m, op, role, text in events:
        if op == "regenerate":
            messages = {k: v for k, v in messages.items() if k <= m}
        old = messages.get(m, ("", ""))
        role = old[0] if role is None else role
        messages[m] = (role, old[1] + (text or "") if op == "delta" else text or "")
    return [messages[m] for m in sorted(messages)]


def test_events(spark):
    logs = {
        1: [(0, "message", "user", "hi"), (1, "message", "assistant", "he"), (1, "delta", None, "llo"), (1, "delta", None, "!"), (2, "message", "user", "more"), (1, "regenerate", None, None), (1, "delta", None, "new"), (2, "message", "user", "again")],
        2: [(0, "message", "user", "typo"), (0, "edit", None, "fixed"), (0, "delta", None, None), (1, "message", "assistant", None)],
        3: [(0, "message", None, "x")],
    }
    logs[4] = [(i, "message", "assistant" if i % 2 else "user", f"{i}<|im_end|>") for i in range(3000)]
    rows = [(c, m, s, op, r, t, 9) for c, log in logs.items() for s, (m, op, r, t) in enumerate(log)]
    e = spark.createDataFrame(rows, "conv_id long, message long, seq long, op string, role string, text string, segment int").repartition(7)
    segments = chat.format_events(e)
    out = {}
    for r in segments.orderBy(*chat.KEY).collect():
        out[r.conv_id] = out.get(r.conv_id, "") + r.segment
    for c, log in logs.items():
        assert [(r, t) for r, t, _, _ in chat.read(out[c])] == fold(log)
    for r in chat.digests(segments).collect():
        want = fold(logs[r.conv_id])
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256("".join(b for a, b in want if a == "assistant").encode()).hexdigest()
        assert r.formatted_chars == len(out[r.conv_id])
    assert chat.format_events(e.where("false")).collect() == []


def test_nulls_and_ties(spark):
    rows = [(None, 1, "user", "a"), (None, None, "user", "b"), (5, 0, "user", "b"), (5, 0, "user", "a"), (5, 0, "user", "a"), (5, 1, None, None)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = chat.format_events(chat.turns_as_events(d))
    got = [(r.conv_id, [(a, b) for a, b, _, _ in chat.read(r.segment)][0]) for r in segments.orderBy(*chat.KEY).collect()]
    assert got == [(None, ("user", "b")), (None, ("user", "a")), (5, ("user", "a")), (5, ("user", "a")), (5, ("user", "b")), (5, ("", ""))]
    assert sorted(r.n_turns for r in chat.digests(segments).collect()) == [2, 4]
