import random
from collections import Counter

from lithoflow.llm import langid as L


def grams(text):
    s = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    if not s.strip():
        return Counter()
    out = Counter(c for c in s if c != " ")
    out.update(s[i : i + 2] for i in range(len(s) - 1))
    out.update(s[i : i + 3] for i in range(len(s) - 2))
    return out


def code(g):
    n = 0
    for c in g:
        n = n << 21 | ord(c)
    return n


def test_ngrams():
    for t in ("The cat, the CAT!", "été à l'été", "x", " 12 a 34", "日本 語", "ß" * 7):
        x, n = L.ngrams(t.encode())
        want = {code(g): k for g, k in grams(t).items()}
        # blanks alone are counted with their neighbours only
        assert dict(zip(x.tolist(), n.tolist())) == {k: v for k, v in want.items()}


def test_parts_add_up(monkeypatch):
    r = random.Random(1)
    texts = ["over and under the bridge " * 50, "12 " * 90, "x" * 301, " a", "a ", "1" * 150 + "é日" * 60 + " " * 120 + "b", "".join(r.choice("ab 1é") for _ in range(997))]
    whole = [L.ngrams(t.encode()) for t in texts]
    for part in (1, 2, 3, 7, 100):
        monkeypatch.setattr(L, "PART", part)
        for t, (x, n) in zip(texts, whole):
            y, m = L.ngrams(t.encode())
            assert x.tolist() == y.tolist() and n.tolist() == m.tolist()
            assert dict(zip(y.tolist(), m.tolist())) == {code(g): k for g, k in grams(t).items()}


def profile_of(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda z: (-z[1], code(z[0])))[:size]]


def test_out_of_place_distance(spark):
    r = random.Random(2)
    make = lambda w, n: " ".join(r.choice(w) for _ in range(n))
    words = {"en": "the of and house with from water".split(), "xx": "zug quer wolk zwirn jux kropf".split()}
    rows = [(i, make(words[k], 40), k) for i in range(30) for k in words]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = L.learn_profiles(frame, size=50)
    totals = {k: sum((grams(t) for _, t, g in rows if g == k), Counter()) for k in words}
    assert {k: profiles[k] for k in words} == {k: [code(g) for g in profile_of(totals[k], 50)] for k in words}
    predict = L.classifier(profiles, 50)
    for k in words:
        for _ in range(20):
            t = make(words[k], 25)
            names, scores = predict([t.encode()])
            mine = profile_of(grams(t), 50)
            far = {}
            for g in words:
                at = {x: i for i, x in enumerate(profile_of(totals[g], 50))}
                far[g] = sum(abs(at[x] - i) if x in at else 50 for i, x in enumerate(mine))
            best = min(sorted(far), key=far.get)
            assert names == [best] == [k]
            assert abs(scores[0] - (1 - far[best] / (50 * len(mine)))) < 1e-12


def test_edges(docs, edge_docs, no_docs, clashing, spark):
    profiles = L.learn_profiles(docs)
    assert set(profiles) == {"en", "de"}
    got = L.identify(docs, profiles).collect()
    assert len(got) == len(edge_docs)
    for r in got:
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    assert L.identify(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert L.learn_profiles(no_docs) == {} and L.identify(no_docs, profiles).count() == 0
    assert L.identify(clashing, profiles).count() == len(edge_docs)
    assert L.learn_profiles(docs.where("lang is null")) == {}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.op8(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.where("lang = lang_pred").count() > 0.97 * got.count() > 0
