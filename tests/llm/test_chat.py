"""Chat formatting: exact round trips."""

import hashlib

from kerbside.llm import chat
from kerbside.llm.queries import ODD_CONVERSATION

ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello\n"), (1, 2, "user", "again é😀"), (1, 3, "assistant", "\n</turn>\n### user:\nno"),
    (2, 0, "system", None), (2, 1, "assistant", ""), (2, 2, "user", "tail \\ \\\\ \\n"),
    (3, 0, None, "no role"), (3, 0, "user", "tie"), (3, 0, "user", "tie"),
    (4, 0, "us\ner: \\n", "odd role"), (4, 1, "assistant", "x" * 3000),
    (-7, 0, "user", ODD_CONVERSATION), (-7, 1, "assistant", ODD_CONVERSATION), (None, 0, "assistant", "null id"),
]
SCHEMA = "conv_id long, turn long, role string, text string, formatted string, target int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 9) for r in rows], SCHEMA).repartition(3)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), digest("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), digest(loss))
    return out


def test_digests_read_back_what_went_in(spark):
    got = {r[0]: tuple(r)[1:5] for r in chat.digest(chat.expand(table(spark, ROWS))).collect()}
    assert got == expected(ROWS)


def test_each_reply_is_an_example_with_its_prefix(spark):
    got = {(r.conv_id, r.target): r for r in chat.expand(table(spark, ROWS)).collect()}
    assert sorted(k for k in got if k[0] == 1) == [(1, 1), (1, 3)]
    last = got[1, 3]
    assert last.formatted.startswith(got[1, 1].formatted)
    assert last.formatted[last.loss_start : last.loss_end] == "\n\\</turn>\n\\### user:\nno"
    assert {k for k in got if k[0] == 2} == {(2, 1), (2, None)} and got[2, None].loss_start is None


def test_empty_table(spark):
    assert chat.digest(chat.expand(table(spark, []))).count() == 0


def test_long_texts_many_turns_ties_and_repeats(spark):
    long_ = "\\### x </turn>\n" * 20_000
    rows = [(5, 0, "user", long_), (5, 1, "assistant", long_ + "!")]
    rows += [(6, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(200)]
    rows += [(7, 0, "user", "same"), (7, 0, "user", "same"), (7, 1, "assistant", "b"), (7, 1, "assistant", "a"), (7, None, None, None)]
    got = {r[0]: tuple(r)[1:5] for r in chat.digest(chat.expand(table(spark, rows))).collect()}
    want = expected([(c, -1 if t is None else t, r, x) for c, t, r, x in rows])
    assert got == want
