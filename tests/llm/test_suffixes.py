import hashlib
import os
import random
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lithoflow.llm import anchors as A
from lithoflow.llm import suffixes as S
from lithoflow.llm.common import shared_dir
from lithoflow.llm.gsaca import common_prefixes, suffix_array


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(text):
    order = suffix_array(text)
    assert order == sorted(range(len(text)), key=lambda i: text[i:])
    shared = common_prefixes(text, order)
    for i in range(1, len(order)):
        a, b = text[order[i - 1] :], text[order[i] :]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert shared[i] == n


def test_anchors_own_each_window_once(monkeypatch):
    r = np.random.default_rng(2)
    texts = [bytes(r.integers(97, 97 + letters, n).astype(np.uint8)) for n in (399, 400, 950, 2500) for letters in (1, 2, 26)]
    for part in (A.PART, 500):
        monkeypatch.setattr(A, "PART", part)
        A._powers.cache_clear()
        for t in texts:
            _, place, first, last = A.anchors(t)
            assert [w for a, b in zip(first.tolist(), last.tolist()) for w in range(a, b + 1)] == list(range(max(0, len(t) - 399)))
            assert all(a <= p + 0 and b <= p <= a + 400 - A.anchor_size(400) for p, a, b in zip(place.tolist(), first.tolist(), last.tolist()))
    A._powers.cache_clear()


def brute(rows, window=400, min_words=0):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[p : p + window] for t in texts for p in range(len(t) - window + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        covered = np.zeros(len(t) + 1, int)
        p = 0
        while p <= len(t) - window:
            q = p
            while q <= len(t) - window and seen[t[q : q + window]] > 1:
                q += 1
            if q > p and len(t[p : q - 1 + window].split()) >= min_words:
                covered[p : q - 1 + window] = 1
            p = q + 1
        kept = bytes(np.frombuffer(t, np.uint8)[covered[:-1] == 0])
        runs = int(((covered[1:] == 0) & (covered[:-1] == 1)).sum())
        out.append((i if i is not None else -1, len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(frame, **how):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.deduplicate(frame, **how).collect())


def passages(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(k) for k in (60, 75, 90, 140, 400)]
    rows = []
    for i in range(n):
        parts = [text(r.randint(0, 80))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared)
            a = r.randint(0, 40)
            parts += [p[a : len(p) - r.randint(0, 40)], text(r.randint(0, 30)), r.choice(["", "é", "日"])]
        rows.append((i, r.choice(["", " ", "x"]).join(parts)))
    rows.append((n, "of " * 400))
    rows.append((n + 1, "a" * 399))
    rows.append((n + 2, "b" * 401))
    rows.append((n + 3, shared[4][:700] + "Z" + shared[4][701:]))
    return rows


@pytest.mark.parametrize("group", [S.GROUP, 3, 1])
def test_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(S.repeated_windows, "__defaults__", ("doc_id", "text", 400, group))
    rows = passages(3)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


@pytest.mark.parametrize("how", [{"window": 200}, {"window": 200, "min_words": 50}, {"window": 97}])
def test_other_lengths_against_brute_force(spark, how):
    rows = [*passages(5), (900, "a b c d e " * 60), (901, "line of twenty letters and some more\n" * 9)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **how)
    assert got == brute(rows, **how) and sum(r[2] for r in got) > 0
    with pytest.raises(ValueError):
        S.deduplicate(spark.createDataFrame(rows[:1], "doc_id long, text string"), window=15)


def test_crowded_cores_go_to_suffix_arrays_in_halves():
    r = random.Random(8)
    core = "".join(r.choice("xyz") for _ in range(S.WINDOW - S.BLOCK + 1)).encode()
    sides = [(bytes(r.choices(b"ab", k=r.randint(0, 15))), bytes(r.choices(b"ab", k=r.randint(0, 15)))) for _ in range(400)]
    windows = Counter(x for a, b in set(sides) for o in range(max(0, 15 - len(b)), len(a) + 1) for x in [(o, a[len(a) - o :] + core + b[: 15 - o])])
    distinct = sorted(set(sides))
    found_whole = S.repeated_offsets([[(a, b, 1) for a, b in distinct]])[0]
    assert found_whole == [{o for o in range(max(0, 15 - len(b)), len(a) + 1) if windows[o, a[len(a) - o :] + core + b[: 15 - o]] > 1} for a, b in distinct]


def test_repeated_rows_and_hubs(spark):
    """One passage in very many surroundings, and one row many times."""
    passage = "".join(random.Random(1).choice("abcdefgh ") for _ in range(420))
    rows = [(i, f"{i * 7919:07d}"[: 1 + i % 7] + passage + f"{i * 104729:08d}") for i in range(120)] + [(500, passage + "x")] * 30
    for group in (S.GROUP, 2):
        S.repeated_windows.__defaults__ = ("doc_id", "text", 400, group)
        try:
            assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)
        finally:
            S.repeated_windows.__defaults__ = ("doc_id", "text", 400, S.GROUP)


def test_edges(spark, edge_docs, docs, no_docs, clashing):
    assert found(docs) == brute([(r[0], r[1]) for r in edge_docs])
    assert found(no_docs) == []
    assert S.deduplicate(clashing).count() == len(edge_docs)


def test_text_without_cut_characters(spark):
    shared = "é" * 300
    rows = [(1, "aé" + shared), (2, "b" + shared + "日")]
    for r in S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), as_text=True).collect():
        assert "�" not in r["kept"]


@pytest.mark.parametrize("group", [S.GROUP, 3])
def test_passages_beside_windows(spark, monkeypatch, group):
    """Passages are counted as by windows of their own length; what 400-byte windows remove stays as it is."""
    monkeypatch.setattr(S.repeated_windows, "__defaults__", ("doc_id", "text", 400, group))
    r = random.Random(12)
    own = lambda n: "".join(r.choice("klmnopqrst") for _ in range(n))
    long = own(700)
    rows = [*passages(7), (800, "a b c d e " * 60), (801, long), (802, own(50) + long[100:] + own(80) + long[:450]), (803, long[:650] + own(9)), (804, "é" * 300), (804, "é" * 300), (None, None)]
    made = S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), passages=(200, 50)).collect()
    id_of = lambda x: -1 if x["doc_id"] is None else x["doc_id"]
    assert sorted((id_of(x), x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in made) == brute(rows)
    want = brute(rows, 200, 50)
    assert sorted((id_of(x), x["n_bytes"], x["n_passage_bytes"], x["n_passages"]) for x in made) == [x[:4] for x in want]
    assert sum(x["n_removed"] == 0 < x["n_passages"] for x in made) > 0
    with pytest.raises(ValueError):
        S.deduplicate(spark.createDataFrame(rows[:1], "doc_id long, text string"), passages=(400, 50))


def test_op7_tells_passages_of_over_50_words(spark, tmp_path):
    r = random.Random(13)
    text = lambda n: " ".join("".join(r.choice("aeiourstln") for _ in range(r.randint(2, 6))) for _ in range(n))
    passage = text(56)
    assert 200 < len(passage) < 400
    rows = [(i, f"{text(60)}\n{passage}\n{text(40)}" if i < 3 else text(150)) for i in range(12)] + [(12, ""), (13, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for x in S.op7(spark, str(tmp_path)).collect():
        assert (x["n_passages"], x["n_removed"]) == (x["doc_id"] < 3, 0) and (x["n_passage_bytes"] >= len(passage)) == (x["doc_id"] < 3)
        assert x["kept_sha256"] == hashlib.sha256((rows[x["doc_id"]][1] or "").encode()).hexdigest()


def test_tables_of_the_search_are_deleted(spark):
    rows = passages(9, 20)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    folder = urlparse(shared_dir(spark)).path
    tables = lambda: {x for x in os.listdir(folder) if x.startswith("lithoflow-")}
    before = tables()
    assert found(frame) == brute(rows) and len(tables() - before) == 1
    before = tables()
    S.deduplicate(frame, passages=(200, 50)).collect()
    assert len(tables() - before) == 2
