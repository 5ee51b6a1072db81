import hashlib

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from lithoflow.llm import chat as C

PATH = P.path("byte_bpe_50k.tiktoken")
SCHEMA = "conv_id long, turn long, role string, text string, extra string"
pieces = st.lists(st.sampled_from([*C.MARKS, C.ESC, "A", "B", "<", "[", "/", "INST]", "s>", "é", "日", " ", "\n"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(pieces)
def test_escapes_come_back(text):
    safe = C.escape(text)
    assert not any(m in safe for m in C.MARKS)
    assert C.unescape(safe) == text


def digests(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), sha("".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)), len(loss), sha(loss)


def test_round_trip(spark):
    nasty = "</s>[INST] ok [/INST]\x1a<s>[ROLE]tool[/ROLE]\x1aA"
    rows = [
        (1, 1, "assistant", nasty, "x"), (1, 0, "user", nasty, None), (1, 2, "assistant", None, "x"), (1, 3, "assistant", "é" * 3000, "x"),
        (2, 0, "system", "be", "x"), (2, 1, "tool[/ROLE]</s>", "out", "x"), (2, 1, "assistant", "a", "x"), (2, 1, "assistant", "a", "x"), (2, None, None, "first", "x"),
        (3, 5, "assistant", "", "x"), (None, 0, "user", "lost", "x"),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r["conv_id"]: r for r in C.read_back(C.format_chats(frame, PATH, P.PATTERN), PATH, P.PATTERN).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        mine = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digests([(x[2], x[3]) for x in mine])


def test_mask_covers_assistant_texts_alone(spark):
    frame = spark.createDataFrame([(1, 0, "user", "hello", ""), (1, 1, "assistant", "one", ""), (1, 2, "assistant", "two", "")], SCHEMA)
    r = C.format_chats(frame, PATH, P.PATTERN).first()
    encoding, first = C._encoding(PATH, P.PATTERN)
    assert len(r["input_ids"]) == len(r["loss_mask"])
    assert encoding.decode([i for i, m in zip(r["input_ids"], r["loss_mask"]) if m]) == "onetwo"
    assert [i - first for i in r["input_ids"] if i >= first] == [0, 4, 5, 6, 7, 6, 7, 1]


def test_long_conversation_and_empty_table(spark):
    n = 3000
    frame = spark.range(n).selectExpr("1 as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('turn ', id) as text")
    want = digests([(["user", "assistant"][i % 2], f"turn {i}") for i in range(n)])
    whole = C.format_chats(frame, PATH, P.PATTERN)
    parts = C.format_chats(frame, PATH, P.PATTERN, part_ids=100)
    assert whole.count() == 1 and parts.count() > 100
    assert parts.agg({"n_turns": "sum"}).first()[0] == n and {r["part"] for r in parts.collect()} == set(range(parts.count()))
    for r in (C.read_back(whole, PATH, P.PATTERN).first(), C.read_back(parts, PATH, P.PATTERN, in_order=True).first(), C.read_back(parts.repartition(7), PATH, P.PATTERN).first()):
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == want
    assert C.read_back(C.format_chats(spark.createDataFrame([], SCHEMA), PATH, P.PATTERN), PATH, P.PATTERN).count() == 0


def test_query_adds_the_conversation(spark):
    got = C.op9(spark, "/root/testdata/sf0.001").where("conv_id = -1").collect()
    own = "</s>[INST] ok [/INST]"
    assert [(r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got] == [digests([("user", own), ("assistant", own)])]


def test_one_very_long_turn(spark):
    long = "word </s> é\n" * 60_000
    rows = [(1, 0, "user", "a", None), (1, 1, "assistant", long, None), (1, 2, "assistant", "b", None), (2, 0, "user", long, None)]
    got = {r["conv_id"]: r for r in C.read_back(C.format_chats(spark.createDataFrame(rows, SCHEMA), PATH, P.PATTERN, part_ids=1000), PATH, P.PATTERN, in_order=True).collect()}
    for c in (1, 2):
        want = digests([(r[2], r[3]) for r in rows if r[0] == c])
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == want
