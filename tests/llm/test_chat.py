from collections import defaultdict

from rosterlake.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place int, n_turns string, h1 int, chat string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA)


ROWS = [
    (1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", "more"),
    (4, 0, "user", "hi"), (4, 1, "assistant", "other"), (5, 0, "user", "hi"), (5, 1, "assistant", "other"),
    (6, 7, "system", None), (7, 0, "system", ""), (8, 0, None, "hi"), (9, 3, "user", "b"), (9, 3, "user", "a"), (9, 3, "user", "a"),
    (10, 0, "user", "a"), (11, 0, "user", "<|user|>\nx<|end|>"), (None, 0, "user", "hi"), (12, None, "user", "first"), (12, 0, "user", "last"),
]


def brute(rows):
    by = defaultdict(set)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].add((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    seqs = {c: [x[2:] for x in sorted(t)] for c, t in by.items()}
    return {
        c: (len(s), sum(o == s for o in seqs.values())) for c, s in seqs.items()
        if not any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values()) and c == min(k for k, o in seqs.items() if o == s)
    }


def test_maximal_conversations_equal_brute_force(spark):
    got = {r.conv_id: r for r in chat.render_chats(table(spark, ROWS)).collect()}
    assert {c: (r.n_turns, r.n_same) for c, r in got.items()} == brute(ROWS)
    assert got[3].chat == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nmore<|end|>"
    assert got[6].chat == "<|system|>\n<|end|>" and got[8].chat.startswith("<|unknown|>")
    assert got[11].chat.count("<|") == 2  # a text can't forge a turn
    assert got[12].chat.index("first") < got[12].chat.index("last")


def test_no_rows_and_no_python(spark):
    empty = chat.render_chats(table(spark, []))
    assert empty.count() == 0
    assert "Python" not in empty._jdf.queryExecution().toString()
