import hashlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from markloom.llm import op1_chat as op

PIECES = st.lists(st.sampled_from(["<", "|", "\\", "<|im_end|>", "<|im_start|>", "im_end", "a", "é", "\n", "%0A", "🙂"]), max_size=8).map("".join)


def digest(rows):
    turns = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@settings(max_examples=200, database=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys<\n%", ""]), PIECES), max_size=6))
def test_round_trip(turns):
    batch = pa.RecordBatch.from_pydict({"role": pa.array([r for r, _ in turns], pa.string()), "text": pa.array([t for _, t in turns], pa.string())})
    buffer, starts, mask = op.assemble(batch)
    whole = bytes(memoryview(buffer)[: starts[-1]])
    assert op.parse(whole) == [(r.encode(), t.encode()) for r, t in turns]
    assert whole.count(op.OPEN) == whole.count(b"<|im_end|>") == len(turns)
    said = [op.unescape(whole[a:b]).decode() for a, b in mask.T.tolist() if a >= 0]
    assert said == [t for r, t in turns if r == "assistant"]


def test_conversations(spark):
    rows = [(1, 0, "user", "a<|im_end|>"), (1, 1, "assistant", None), (1, 2, "assistant", "bé"), (1, 2, "assistant", "bé"), (2, None, "system", ""), (2, 0, None, "x"), (None, 0, "assistant", "y"), (3, 0, "assistant", "z" * 200_000), (3, 1, "user", "q" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "1 AS part", "'c' AS formatted")
    got = {r["conv_id"]: tuple(r)[1:5] for r in op.chat_digest(op.chat_format(df)).collect()}
    want = {}
    for c in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
        want[c] = digest([r[2:] for r in own])
    assert got == want


def test_one_hot_conversation_spans_parts(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("7L AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "repeat(concat('t', id, ' '), 900) AS text")
    parts = op.chat_format(rows)
    assert parts.count() > 1
    got = op.chat_digest(op.chat_format(rows)).collect()
    want = digest([(r["role"], r["text"]) for r in rows.orderBy("turn").collect()])
    assert [tuple(r)[1:5] for r in got] == [want]


def test_a_very_long_text_comes_alone(spark):
    long = "<|im_end|>é" * 400_000
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", long), (1, 2, "assistant", "b"), (2, 0, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: tuple(r)[1:5] for r in op.chat_digest(op.chat_format(df)).collect()}
    assert got == {c: digest([r[2:] for r in rows if r[0] == c]) for c in (1, 2)}


def test_contract_rows_and_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    got = op.chat_digest(op.chat_format(op.contract_turns(df))).collect()
    said = "<|im_end|><|im_start|>assistant ok"
    assert [tuple(r)[:5] for r in got] == [(-1, *digest([("user", said), ("assistant", said)]))]
    assert op.chat_digest(op.chat_format(df)).count() == 0
