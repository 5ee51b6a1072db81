import random
import re
from collections import Counter

import corpus_pipeline as C
from tests.llm.test_pii import PATTERNS, passes
from tests.llm.test_simhash import plain_fingerprint, smallest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(9)
    word = lambda: "".join(r.choice("aeiourstln") for _ in range(r.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(120)
    rows = [(i, text(80) + (" " + shared if i % 5 == 0 else ""), "en") for i in range(40)]
    rows += [(100 + i, rows[i][1], "en") for i in range(5)] + [(110, rows[7][1].replace(" ", "  ", 1), "en")]
    rows += [(200, "12345 !!", None), (201, None, "en"), (202, "", None), (203, "mail me@x.org or 10.0.0.1 " + text(70), "en"), (203, "mail me@x.org again " + text(70), "en"), (None, text(60), "en")]
    return [(i, t, g, "s", None if t is None else len(t)) for i, t, g in rows]


def brute(rows):
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    fps = [plain_fingerprint(r[1]) for r in rows]
    near = [[(a ^ b).bit_count() <= 4 for b in fps] for a in fps]
    group = smallest(list(range(len(rows))), near)
    kept = {}
    for k, r in enumerate(rows):
        kept.setdefault(group[k], set()).add((r[0] is None, r[0], r[1]))
    kept = [{x[1:] for x in g if x[:2] == min(g, key=lambda x: (x[0], x[1] or 0))[:2]} for g in kept.values()]
    assert all(len(g) == 1 for g in kept)  # no tie in these rows
    kept = [x for g in kept for x in g]
    texts = [t.encode() for _, t in kept]
    n = C.WINDOW
    strings = Counter(t[p : p + n] for t in texts for p in range(len(t) - n + 1))
    out = Counter()
    for (i, _), t in zip(kept, texts):
        gone, p = set(), 0
        while p <= len(t) - n:
            q = p
            while q <= len(t) - n and strings[t[q : q + n]] > 1:
                q += 1
            if q > p and len(t[p : q - 1 + n].split()) >= C.MIN_WORDS:
                gone |= set(range(p, q - 1 + n))
            p = q + 1
        left = bytes(b for q, b in enumerate(t) if q not in gone).decode("utf-8", "ignore")
        spans = sorted((m.start(), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, left) if passes(k, m[0]))
        for a, b, k in reversed(spans):
            left = left[:a] + f"[{k.upper()}]" + left[b:]
        out[i, left] += 1
    return out


def test_stages_against_brute_force(spark, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    for i, (_, stage) in enumerate(C.STAGES[:-1]):
        docs = stage(spark, docs, "")
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    got = docs.collect()
    want = brute(rows)
    assert Counter((r["doc_id"], r["text"]) for r in got) == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    pieces = C.STAGES[-1][1](spark, docs, "").groupBy("doc_id").sum("length").collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    sizes = Counter()
    for i, t in want.elements():
        sizes[i] += len(tok.encode(t).ids) + 1
    assert {r[0]: r[1] for r in pieces} == sizes


def test_rows_of_one_id_are_judged_one_by_one(spark):
    r = random.Random(5)
    text = lambda: " ".join("".join(r.choice("aeiourstln") for _ in range(r.randint(2, 8))) for _ in range(80))
    a, b, d, e, f = (text() for _ in range(5))
    rows = [(1, a), (10, a), (10, b), (20, d), (20, e), (20, e), (None, f), (None, f + " "), (None, a), (30, None), (31, "")]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], SCHEMA)
    got = sorted(((x["doc_id"], x["text"]) for x in C.near_duplicates(spark, docs, "").collect()), key=str)
    assert [x for x in got if x[0] is not None] == sorted([(1, a), (10, b), (20, d), (20, e), (30, None)], key=str)
    assert [x[0] for x in got].count(None) == 1 and (got[-1] if got[-1][0] is None else next(x for x in got if x[0] is None))[1].strip() == f


def test_passages_of_50_words_go_and_shorter_ones_stay(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("aeiourstln") for _ in range(r.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    long, short = text(52), text(46)
    assert 200 <= len(short) and len(long) < 400
    docs = spark.createDataFrame([(i, f"{text(40)}\n{long}\n{text(30)}", "en", "s", 1) for i in range(3)] + [(10 + i, f"{text(40)}\n{short}\n{text(30)}", "en", "s", 1) for i in range(3)], SCHEMA)
    for x in C.repeated_passages(spark, docs, "").collect():
        assert (long not in x["text"]) if x["doc_id"] < 10 else (short in x["text"])
        assert x["n_chars"] == len(x["text"])


def test_repeated_ids_and_run(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = C.run(spark, str(tmp_path)).toPandas()
    assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert set(out.loc[out.duplicated(["doc_id", "piece"]), "doc_id"]) <= {203} and {200, 201, 202}.isdisjoint(out["doc_id"]) and 203 in set(out["doc_id"])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
