import hashlib
import random

import public_tokenizers as P
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lithoflow.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
CODEC = bpe._codec(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


def encoded(text):
    return [i for w in regex.findall(P.PATTERN, text) for i in CODEC.encode_word(w.encode())]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab cdething'sé\n\t 19!?.日ß<|>endoftext"), max_size=120))
def test_as_the_library(text):
    assert encoded(text) == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(encoded(text)) == text.encode()


def test_all_tokens_are_reached():
    assert all(CODEC.merge(k) == (v,) for k, v in CODEC.ranks.items())


def test_long_runs():
    for t in ("a" * 5000, "ab" * 3000, "=" * 4097, "日" * 700, "\n" * 999):
        assert encoded(t) == LIBRARY.encode_ordinary(t)


def test_join_is_that_of_the_whole():
    r = random.Random(1)
    for _ in range(500):
        data = bytes(r.choice(b"thereandingaa==--") for _ in range(r.randint(2, 60)))
        cut = r.randint(1, len(data) - 1)
        assert CODEC.join(CODEC.encode(data[:cut]), CODEC.encode(data[cut:])) == CODEC.merge(data)


def test_plain_splitter_is_equal():
    words = bpe.Words(P.PATTERN)
    for t in ("a 12's été\x1c\x1d x", "ab\xa0cd", "don't STOP", "½ ² x", "", " \n\n a", "naïve×÷"):
        assert [w for p in words.parts(t) for w in p] == regex.findall(P.PATTERN, t)


def test_very_long_text_goes_part_by_part(monkeypatch):
    monkeypatch.setattr(bpe, "STREAM", 64)
    text = "some words and more " * 40
    n, ids, back = (x[0] for x in bpe.coder(PATH, P.PATTERN)([text.encode()]))
    want = LIBRARY.encode_ordinary(text)
    assert n == len(want) and ids == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest() and back == hashlib.sha256(text.encode()).hexdigest()


def test_table(docs, edge_docs, no_docs, clashing):
    got = bpe.encode(docs, PATH, P.PATTERN).collect()
    assert len(got) == len(edge_docs)
    for r in got:
        ids = LIBRARY.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids) and list(r["ids"]) == ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs.where("text is not null"), PATH, P.PATTERN), PATH, out="back").collect()
    assert all(bytes(r["back"]).decode() == r["text"] for r in back)
    assert bpe.encode(no_docs, PATH, P.PATTERN).count() == 0
    assert bpe.encode(clashing, PATH, P.PATTERN).count() == len(edge_docs)
