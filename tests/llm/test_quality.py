import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoflow.llm import quality as Q


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_base_columns(docs, edge_docs):
    got = Q.quality(docs, ["doc_id", "text"]).collect()
    assert len(got) == len(edge_docs)
    for r in got:
        want = base(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_repeats_and_lines(spark):
    text = "\n".join(["a b c d e f g h i j"] * 3 + ["", " ", "other | # line"])
    r = Q.quality(spark.createDataFrame([(1, text, None)], "doc_id long, text string, lang string"), ["doc_id"]).first()
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base(text)


def test_odd_distribution_goes_and_plain_text_stays(spark):
    plain = " ".join(["the cat of a house and the garden is in order for it"] * 2 + [f"w{i % 13} thing was on with" for i in range(40)])
    noise = " ".join(f"%%%{i}$$$###" for i in range(80))
    got = {r["doc_id"]: r for r in Q.quality(spark.createDataFrame([(i, plain + f" {i}", "en") for i in range(20)] + [(99, noise, "en")], "doc_id long, text string, lang string"), ["doc_id"], max_repeated=100).collect()}
    assert all(got[i]["kept"] for i in range(20)) and not got[99]["kept"] and not got[99]["base_failed"]


def test_short_texts_are_guarded(spark):
    noise = " ".join("%%%$$$###" + str(i) for i in range(30))
    assert Q.quality(spark.createDataFrame([(1, noise, "en"), (2, "the of and to in a " * 60, "en")], "doc_id long, text string, lang string"), ["doc_id"]).where("doc_id = 1").first()["kept"]


def test_languages_without_a_list_have_references_too(spark):
    import random

    r = random.Random(2)
    words = "и в не на что тот быть весь это как она они один говорить год знать река дом вода утро".split()
    rows = [(i, " ".join(r.choice(words) for _ in range(200)), "ru") for i in range(20)]
    rows += [(100 + i, " ".join(r.choice("the of and to in a house river stone garden".split()) for _ in range(200)), "en") for i in range(20)]
    rows += [(200, " ".join(f"%%{i}$$##" for i in range(200)), None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in Q.quality(frame, ["doc_id"], max_repeated=100).collect()}
    assert all(got[i]["kept"] for i in got if i != 200) and not got[200]["kept"]
    # own lists: both histograms tell languages apart, whatever the guards
    mine = {"ru": words[:5], "en": ["the", "of"]}
    got = {x["doc_id"]: x for x in Q.quality(frame.where("lang = 'ru' or doc_id = 100").withColumn("lang", F.when(F.col("doc_id") < 100, F.col("lang"))), ["doc_id"], max_repeated=100, common=mine, guards=(10**6, 10), max_common=0.3).collect()}
    assert all(got[i]["kept"] for i in range(20)) and not got[100]["kept"]


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(Q, "LANGUAGES", 2)
    frame = spark.createDataFrame([(i, "a b", f"l{i}") for i in range(3)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        Q.quality(frame, ["doc_id"])


def test_js_distance():
    got = Q.js_distance(np.array([[1, 0], [1, 1], [0, 0]]), np.array([0, 1]))
    assert np.allclose(got, [1.0, 0.5579230452841438, 0.0])


def test_empty_and_clashing(no_docs, clashing, docs):
    assert Q.quality(no_docs, ["doc_id"]).count() == 0
    assert Q.quality(clashing, clashing.columns).count() == docs.count()
