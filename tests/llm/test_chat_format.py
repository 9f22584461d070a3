import duckdb
import pytest
from pyspark.sql import functions as F

from corpus_spark.llm.chat_format import (EVENTS, OP10_SQL, escape, fold_events, format_conversations, op10_chat_format,
                                          read_formatted, unescape)

from .conftest import HARD_TEXTS

NASTY = ["\\", "\\\\", "\\h", "\\\\h#", "#\\#<\\<", "### user: x</turn>\n### assistant: y", "a: b", "\\l\\\\\\c:", "</turn>\n" * 3]


def test_escape_is_reversible(spark):
    df = spark.createDataFrame([(t,) for t in NASTY + HARD_TEXTS], "t string")
    for role in (False, True):
        rows = df.select("t", escape(F.col("t"), role).alias("e"), unescape(escape(F.col("t"), role)).alias("u")).collect()
        assert all(r.u == (r.t or "") and "#" not in r.e and "<" not in r.e and not (role and ":" in r.e) for r in rows)


def python_fold(events):
    out = {}
    for conv, seq, message, kind, role, text in sorted(set(events), key=lambda e: (
            e[0] is None, e[0] or 0, e[2], e[1], e[3], e[4] or "", e[5] or "")):
        m = out.setdefault((conv, message), {"role": "", "text": "", "on": True})
        if role is not None:
            m["role"] = role
        if kind == "delta":
            m["text"] += text or ""
        else:
            m["text"] = (text or "") if kind in ("start", "edit") else ""
            m["on"] = kind != "delete"
    return {k: (m["role"], m["text"]) for k, m in out.items() if m["on"]}


EVENT_ROWS = [
    (1, 0, 0, "start", "user", None), (1, 1, 0, "delta", None, "Hel"), (1, 2, 0, "delta", None, "lo"),
    (1, 2, 0, "delta", None, "lo"),  # delivered twice
    (1, 3, 1, "start", "assistant", "A: "), (1, 4, 1, "delta", None, "wrong"), (1, 5, 1, "regenerate", None, None),
    (1, 9, 1, "delta", None, "</turn>\\"), (1, 7, 1, "delta", None, "right "), (1, 20, 0, "edit", None, "Hello, edited"),
    (1, 10, 2, "start", "user", "gone"), (1, 11, 2, "delete", None, None), (1, 12, 2, "delta", None, "late"),
    (2, 0, 5, "delta", None, "no start"), (2, 1, 3, "start", "a:b\n#", "x"), (2, 2, 3, "delete", None, None),
    (2, 3, 3, "edit", None, "back"), (None, 0, 0, "start", "assistant", "null conversation"),
    (3, 0, 0, "start", "user", "all"), (3, 1, 0, "delete", None, None),
    (4, 0, 0, "start", "assistant", None), (4, 1, 0, "delta", None, None),
]


def test_fold_render_read(spark):
    df = spark.createDataFrame([(*e, "x", 1) for e in EVENT_ROWS], EVENTS + ", formatted string, turn long")
    want = python_fold(EVENT_ROWS)
    got = {(r.conv_id, r.message): (r.role, r.text) for r in fold_events(df).collect()}
    assert got == want and want[1, 1] == ("assistant", "right </turn>\\") and (1, 2) not in want
    out = format_conversations(df)
    assert {r.conv_id for r in out.collect()} == {1, 2, None, 4}
    turns = read_formatted(out).collect()
    back = {}
    for r in sorted(turns, key=lambda r: r.turn):
        back.setdefault(r.conv_id, []).append((r.role, r.text))
        assert r.learned == (r.text if r.role == "assistant" else "")
    order = {}
    for k in sorted(want, key=lambda k: k[1]):
        order.setdefault(k[0], []).append(want[k])
    assert back == order
    for r in out.collect():
        for (role, text), span in zip(back[r.conv_id], r.loss):
            assert (span.end - span.begin > 0) == (role == "assistant" and text != "")


def test_unknown_kind_and_empty_log(spark):
    df = spark.createDataFrame([(1, 0, 0, "start", "user", "x")], EVENTS)
    assert format_conversations(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        fold_events(df.withColumn("kind", F.lit("boom"))).collect()


def test_query_equals_oracle(spark):
    d = "/root/testdata/sf0.01"
    got = op10_chat_format(spark, d)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{d}/conversations.parquet'")
    want = con.sql(OP10_SQL)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_repeated_and_null_rows(spark, tmp_path):
    rows = [(1, 0, "user", t) for t in HARD_TEXTS + NASTY] + [(1, 0, "assistant", "tie"), (2, None, "assistant", "n"), (2, 0, None, "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op10_chat_format(spark, str(tmp_path)).collect()}
    assert got[1].n_turns == len(HARD_TEXTS + NASTY) + 1 and got[2].n_turns == 2 and got[-7].n_turns == 2
