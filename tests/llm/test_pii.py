import hashlib
import re

import pytest

from lithoflow.llm import pii as X

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(c if i % 2 == 0 else (2 * c - 9 * (c > 4)) for i, c in enumerate(map(int, reversed(d)))) % 10 == 0


def passes(kind, x):
    d = re.sub("[^0-9]", "", x)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in x.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


TEXTS = [
    None, "", "plain text of nothing", "é日 a@b.co a.b@c-d.e.f, x@y", "a@b.c_d@e.f g@h.i@j.k", "@a.b a@ a@b", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004 1.2.3.4", "0255.0.0.1 255.255.255.255",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111111111111111 12345", "+1 (017) 555-7713 +49 1234 +1+23456789012", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "5 5 5 5-5-5-5-5 5555 5555", "😀 mail me@x.org 10.0.0.1",
    "mail bob (at) example (dot) com or call (030) 1234 5678 phone", "x" * 3000 + "@" + "y." * 500 + "z", "1 " * 4000, "1" * 5000, "+" * 2000, ".".join(["1"] * 3000), "a@b.c\n" * 300,
    "ip 1.2.3.4 and tel: +49 30 1234567, server 10.0.0.1 a@b.c é" * 40,
]


def test_base_spans(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in X.digest(X.find(frame, keep=["doc_id"]), ["doc_id"]).collect()}
    for i, t in enumerate(TEXTS):
        want = base(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), i
        assert [got[i][f"n_{k}"] for k in X.KINDS] == [sum(w.startswith(k) for w in want) for k in X.KINDS]
        spans = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert set(want) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (X.KINDS.index(s.split(":")[0]), int(s.split(":")[1]), int(s.split(":")[2])))


def test_method_adds_spans_and_leaves_clean_texts(spark):
    known = [(i, f"mail me: user{i}@host.com phone +49 30 1234567{i % 10} server 10.0.0.{i % 250}") for i in range(60)]
    hidden = [(100 + i, f"mail: user{i} (at) host (dot) com") for i in range(15)]
    clean = [(200 + i, f"they met at the house and sat at table {i}, then left") for i in range(30)]
    frame = spark.createDataFrame(known + hidden + clean, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in X.digest(X.find(frame, keep=["doc_id"]), ["doc_id"]).collect()}
    assert all(got[100 + i].startswith("email:6:") for i in range(15))
    assert all(got[200 + i] == "" for i in range(30))


def test_estimates_and_classifier():
    good, bad = (1, 1, 1, 1, 0), (-1, 0, 0, -1, -1)
    patterns = [(0, good, 500), (0, bad, 300), (0, (1, 0, 0, 1, 0), 100)]
    post = X.estimate(patterns)
    assert post[0, good] > 0.9 and post[0, bad] < 0.1
    w = X.train(patterns, post)
    score = lambda v: sum(a * b for a, b in zip(w[0], [float(u == s) for u in v for s in (1, -1)] + [1.0]))
    assert score(good) > 0 > score(bad)
    assert X.train([], {}) == [[0.0] * 11] * 4


def test_redact(spark):
    frame = spark.createDataFrame([(1, "a é me@x.org, 1.2.3.4!"), (2, None), (3, "none"), (4, "+1 4111 1111 1111 1111 x"), (5, "me@x.org")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in X.redact(frame).collect()}
    assert got == {1: "a é [EMAIL], [IP]!", 2: None, 3: "none", 4: got[4], 5: "[EMAIL]"}
    assert "4111" not in got[4] and got[4].endswith("x")


def test_edges(docs, edge_docs, no_docs, clashing):
    assert X.digest(X.find(docs, keep=["doc_id"]), ["doc_id"]).count() == len(edge_docs)
    assert X.find(no_docs).count() == 0
    assert X.redact(clashing).columns == clashing.columns and X.redact(clashing).count() == len(edge_docs) == X.find(clashing).count()


def test_places_and_contexts_of_many_matches(spark):
    from pyspark.sql import functions as F

    texts = ["", "x", "1.2.3.4", "é ip 1.2.3.4" * 7, "card 1.2.3.4 5.6.7.8" + "y" * 50 + "9.9.9.9 " * 30, "😀" * 45 + "0.0.0.0", " ".join(f"{i}.{i}.{i}.{i}" for i in range(700))]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X._spans(F.col("t"), X.BASE["ip"]).alias("s"))
    for r in frame.collect():
        t = texts[r["i"]]
        assert [tuple(s) for s in r["s"]] == [(m.start(), m.end(), m[0], t[max(0, m.start() - X.BEFORE) : m.start()]) for m in re.finditer(PATTERNS["ip"], t)]


def test_candidates_that_overlap_base_spans_are_theirs(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(3)
    for _ in range(12):
        rows = [(r.randrange(4), a, a + r.randint(1, 30), r.random() < 0.4, *[0] * 5) for a in (r.randrange(300) for _ in range(r.choice([0, 1, 2, 9, 40])))]
        frame = spark.createDataFrame([(rows,)], f"spans array<{X._SPAN}>").select(X._free(F.col("spans")).alias("spans"))
        want = [s for s in rows if s[3] or not any(b[3] and b[1] < s[2] and s[1] < b[2] for b in rows)]
        assert sorted(tuple(x) for x in frame.first()["spans"]) == sorted(want)


def test_many_matches_in_one_text(spark):
    """A log of a megabyte with 50,000 matches: found and replaced in seconds, as by a plain search."""
    import time

    text = "".join(f"user{i % 97}@host{i % 13}.com from 10.{i % 200}.3.{i % 251} é\n" for i in range(25_000))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    got = X.digest(X.find(frame, keep=["doc_id"]), ["doc_id"]).first()
    want = base(text)
    assert got["n_email"] == got["n_ip"] == 25_000 and got["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
    left = X.redact(frame).first()["text"]
    assert left == re.sub(PATTERNS["ip"], "[IP]", re.sub(PATTERNS["email"], "[EMAIL]", text))
    assert time.time() - start < 90


def test_estimates_against_a_plain_em():
    """EM on single spans, one row each, gives what counts of patterns give."""
    import random

    r = random.Random(4)
    votes = [tuple(r.choice([-1, 0, 1]) for _ in X.LABELERS) for _ in range(12)]
    patterns = [(k % 2, v, r.randint(1, 9)) for k, v in enumerate(sorted(set(votes)))]
    rows = [(k, v) for k, v, n in patterns for _ in range(n)]
    belief = [0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else 0.5 for _, v in rows]
    for _ in range(X.ITERATIONS):
        new = []
        for k, v in rows:
            odds = []
            for y in (1, 0):
                mine = [(w, b if y else 1 - b) for (kk, w), b in zip(rows, belief) if kk == k]
                total = 1 + sum(b for _, b in mine)
                p = total
                for j, x in enumerate(v):
                    p *= (sum(b for w, b in mine if w[j] == x) + (2 if x == 2 * y - 1 else 1)) / (total + 4)
                odds.append(p)
            new.append(odds[0] / sum(odds))
        belief = new
    got = X.estimate(patterns)
    assert all(abs(got[k, v] - b) < 1e-9 for (k, v), b in zip(rows, belief))


def test_redacted_texts_against_a_plain_rewrite(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in X.find(frame, keep=["doc_id"]).collect()}
    for r in X.redact(frame).collect():
        t, out, end = TEXTS[r["doc_id"]], "", 0
        for s in sorted(spans[r["doc_id"]], key=lambda s: (s["start"], s["stop"], s["kind"])):
            if s["start"] >= end:
                out += t[end : s["start"]] + f"[{X.KINDS[s['kind']].upper()}]"
            end = max(end, s["stop"])
        assert r["text"] == (None if t is None else out + t[end:]), r["doc_id"]


def test_no_python_in_the_plan(docs, capsys):
    X.candidates(docs).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


@pytest.mark.parametrize("kind", X.KINDS)
def test_votes_are_bounded(kind):
    assert len(X.LABELERS) == 5 and len(X.KINDS) * 3 ** len(X.LABELERS) == 972
