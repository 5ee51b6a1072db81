import itertools
import random

import numpy as np

from lithoflow.llm import toxicity as X


def brute(s, t):
    total = 0.0
    for i in itertools.combinations(range(len(s)), X.ORDER):
        for j in itertools.combinations(range(len(t)), X.ORDER):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                total += X.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def lcs(s, t):
    d = [[0] * (len(t) + 1) for _ in range(len(s) + 1)]
    for i, j in itertools.product(range(len(s)), range(len(t))):
        d[i + 1][j + 1] = d[i][j] + 1 if s[i] == t[j] else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_kernel_and_common_letters():
    r = random.Random(1)
    pairs = [("".join(r.choice("abcd") for _ in range(r.randint(0, 11))), "".join(r.choice("abcd") for _ in range(r.randint(0, 8)))) for _ in range(60)]
    s, t = X._codes([a for a, _ in pairs], 11), X._codes([b for _, b in pairs], 8)
    assert np.allclose(X.kernel_pairs(s, t), [brute(a, b) for a, b in pairs])
    assert X.common_letters(s, t).tolist() == [lcs(a, b) for a, b in pairs]


def test_columns_are_whole_kernels():
    """Every word's kernel with every landmark, of a long word its windows' greatest; none is set to zero."""
    r = random.Random(2)
    names = ["moron", "stupid", X.MARK + "idio", "abcabcabca", "aaaa", X.MARK + "été", "日本語x"]
    words = ["", "a", "xx", "moron", "mo" + "x" * 6 + "ron", "m~o~r~o~n", "ixdxixot", "sxtxuxpid", "idio", "lidio", "aaaaaaa", "été", "x日本語x", "nstu" * 20 + "pid"]
    words += ["".join(r.choice("abcidomrstup") for _ in range(r.randint(1, 14))) for _ in range(150)]
    marks = X.Landmarks(names)
    spell = lambda x: x.replace(X.MARK, X.BEGIN)
    own = [brute(spell(n), spell(n)) for n in names]
    assert np.allclose(marks.own, own)
    got = marks.columns(words)
    for w, row in zip(words, got):
        w = X.BEGIN + w
        windows = [w[a : a + X.WIDTH] for a in range(0, max(1, len(w) - X.WIDTH // 2), X.WIDTH // 2)]
        assert np.allclose(row, [max(brute(v, spell(n)) / o for v in windows) ** X.POWER for n, o in zip(names, own)]), w
    gram = marks.gram()
    assert np.allclose(gram, gram.T) and np.linalg.eigvalsh(gram).min() > -1e-9 and np.allclose(np.diag(gram), 1)


def sample(seed, n):
    r = random.Random(seed)
    plain = "the house of water with green garden and river stone over walk under bright morning".split()
    bad = ["blorfnik", "skrumzil", "vogtrap"]
    out = []
    for i in range(n):
        words = [r.choice(plain) + (str(r.randint(0, 9)) if r.random() < 0.2 else "") for _ in range(r.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(bad) + r.choice(["", "s", "er"]))
        out.append((" ".join(w + ("." if r.random() < 0.1 else "") for w in words), int(toxic)))
    return out, bad


def test_learns_and_tolerates_gaps():
    texts, bad = sample(2, 400)
    model = X.fit([t for t, _ in texts], [y for _, y in texts])
    new, _ = sample(3, 200)
    score = lambda ts: X.scorer(model)([t.encode() for t in ts])[0]
    got = np.array(score([t for t, _ in new])) >= X.THRESHOLD
    assert (got == np.array([y for _, y in new], bool)).mean() > 0.97
    assert all(s > 0.5 for s in score([f"you are a {w[:3]}x{w[3:]} here" for w in bad]))
    assert all(s > 0.7 for s in score([f"you are a {' '.join(w)} here" for w in bad]))
    assert max(score(["", "the green garden", None or "river"])) < 0.5


def short_insults():
    cut = {"blorfnik": "blorf", "skrumzil": "skrum", "vogtrap": "vogtr"}
    texts, _ = sample(2, 400)
    for a, b in cut.items():
        texts = [(t.replace(a, b), y) for t, y in texts]
    model = X.fit([t for t, _ in texts], [y for _, y in texts])
    return list(cut.values()), model, lambda ts: X.scorer(model)([t.encode() for t in ts])[0]


def test_wide_gaps_are_weighed_not_dropped():
    bad, _, score = short_insults()
    clean = score(["you are a river here"])[0]
    for w in bad:
        for n in range(3, 7):
            repeated, inserted = score([f"you are a {w[:3]}{w[3] * n}{w[4:]} here", f"you are a {w[:3]}{'x' * n}{w[3:]} here"])
            assert repeated > 0.5 and inserted > clean, (w, n)
        assert score([f"you are a {'~'.join(w)} here"])[0] > clean


def test_words_cut_by_blanks_and_marks():
    bad, _, score = short_insults()
    clean = score(["you are a river here"])[0]
    for w in bad:
        whole = score([f"you are a {w} here"])[0]
        cuts = [w[:k] + c + w[k:] for c in ".!? " for k in range(1, len(w))]
        cuts += [f"{w[:1]} {w[1]} {w[2:]}", f"{w[:2]} {w[2]} {w[3:]}", " ".join(w), f"{w[:2]}.{w[2]}!{w[3:]}"]
        got = score([f"you are a {c} here" for c in cuts])
        assert min(got) > clean and min(got) > 0.5, (w, whole, dict(zip(cuts, got)))
    assert score(["blo. rf here"])[0] <= clean + 1e-9  # two sentences
    assert X.sentences("a b.c d. e?f! g") == ["a b.c d", " e?f", " g"]


def test_parts_are_the_sentences_words():
    for t in ("a b.c d. e?f! g", "", " . ", "x\n\ny!! z", "one two.", "a\tb\r\nc"):
        assert X.parts_of(t) == [w for s in X.sentences(t) if (w := X.words_of(s))]


def test_table_edges(docs, edge_docs, no_docs, clashing, spark):
    texts, _ = sample(2, 200)
    model = X.fit([t for t, _ in texts], [y for _, y in texts])
    got = X.toxicity(docs, model).collect()
    assert len(got) == len(edge_docs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert X.toxicity(no_docs, model).count() == 0
    assert X.toxicity(clashing, model).count() == len(edge_docs)
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert X.toxicity(docs, X.train(docs, labels)).count() == len(edge_docs)
    assert X.train(no_docs, labels).marks is None


def test_memo_and_batches_give_the_same(spark, monkeypatch):
    texts, _ = sample(2, 200)
    model = X.fit([t for t, _ in texts], [y for _, y in texts])
    data = [t.encode() for t, _ in texts]
    whole = X.scorer(model)(data)[0]
    monkeypatch.setattr(X, "WORDS", 10)
    f = X.scorer(model)
    assert np.allclose(whole, [f([d])[0][0] for d in data])


def test_sample_is_drawn_among_short_texts(spark):
    docs = spark.createDataFrame([(i, ("bad blorfnik text " if i % 2 else "green river stone ") * (1 + 100 * (i < 20))) for i in range(60)] + [(3, "again"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(4, 0)], "doc_id long, toxic int")
    seen = []
    keep = X.fit
    X.fit = lambda t, y: seen.append((t, y)) or keep(t, y)
    try:
        X.train(docs, labels, sample=15, longest=1000)
        X.train(docs, labels, longest=10**6)
    finally:
        X.fit = keep
    (few, marks), (all_texts, _) = seen
    assert len(few) == 30 and sum(marks) == 15 and max(map(len, few)) <= 1000 and len(all_texts) == 60


def test_landmarks_of_several_languages():
    r = random.Random(4)
    stems = {"en": "the house of water with green garden".split(), "xx": "zugo querla wolki zwirna juxo".split()}
    bad = {"en": "blorfnik", "xx": "trumpazi"}
    texts = []
    for i in range(600):
        g = ("en", "xx")[i % 2]
        words = [r.choice(stems[g]) + r.choice(["", "s", "a", f"{r.randint(0, 99)}"]) for _ in range(30)]
        if i % 3 == 0:
            words[5:5] = [bad[g], bad[g] + "s"]
        texts.append((" ".join(words), int(i % 3 == 0), g))
    model = X.fit([t for t, _, _ in texts], [y for _, y, _ in texts])
    score = lambda t: X.scorer(model)([t.encode()])[0][0]
    for g in bad:
        mine = np.array([(score(t) >= X.THRESHOLD, y) for t, y, h in texts if h == g])
        assert mine[mine[:, 1] == 1, 0].mean() > 0.95 and mine[mine[:, 1] == 0, 0].mean() < 0.02


def test_held_out_accuracy(spark):
    rows = X.op4(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    got = rows.join(labels, "doc_id").where("held_out").toPandas()
    toxic = got[got["toxic"] == 1]
    clean = got[got["toxic"] == 0]
    assert toxic["predicted"].mean() > 0.75 and clean["predicted"].mean() < 0.03
