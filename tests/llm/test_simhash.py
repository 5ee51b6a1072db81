import random
import re

import numpy as np
import xxhash

from lithoflow.llm import simhash as S
from lithoflow.llm.graph import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), seed=42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest(ids, near):
    label = dict(zip(range(len(ids)), ids))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            best = min((label[j] for j in range(len(ids)) if near[i][j] and label[j] is not None), default=None)
            if best is not None and (label[i] is None or best < label[i]):
                label[i], changed = best, True
    return label


def test_fingerprints():
    for t in (None, "", " \n", "One", "one TWO three", "a b c d", "a b c d e f g a b c d", "É é ÀB", "x\x1cy z\x0bw v u"):
        assert S.fingerprint(None if t is None else t.encode()) == plain_fingerprint(t)


def test_bit_slices():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 90, dtype=np.int64).astype(np.uint64)
    f = np.concatenate([base, base ^ np.uint64(1 << 40), base ^ np.uint64(0x1F << 11), base ^ np.uint64(0xF)])
    far = np.bitwise_count(f[:, None] ^ f[None, :])
    for radius in (0, 1, 2, 3, 4, 5, 9):
        hit = np.zeros(far.shape, bool)
        hit[S.near(f, f, None, radius)] = True
        assert (hit == (far <= radius)).all()


def test_masks_lose_no_link():
    r = random.Random(5)
    for n in (1000, 10**8, 10**10, 10**12):
        masks = S.keys(n)
        for _ in range(300):
            x = r.getrandbits(64)
            y = x ^ sum(1 << b for b in r.sample(range(64), 4))
            assert any(x & m == y & m for m in masks)


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, 5000 + i) for i in range(1, 400)] + [(7, 7), (None, 3)]
    frame = spark.createDataFrame(edges, "a long, b long")
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert {r["node"]: r["component"] for r in components(frame).collect()} == {x: find(x) for x in up}
    assert components(frame.limit(0)).count() == 0


def check(spark, rows, chunk=S.CHUNK):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fp"] & (2**64 - 1), r["component_id"]) for r in S.near_duplicates(frame).collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    near = [[(a ^ b).bit_count() <= 4 for b in fps] for a in fps]
    label = smallest([i for i, _ in rows], near)
    assert got == sorted((i if i is not None else -1, f, label[k]) for k, (i, f) in enumerate(zip((i for i, _ in rows), fps)))


def near_copies(seed, groups, each):
    r = random.Random(seed)
    out = []
    for g in range(groups):
        words = [r.choice("alpha beta gamma delta eps zeta eta theta iota".split()) + str(r.randint(0, 9)) for _ in range(150)]
        for _ in range(each):
            own = list(words)
            for _ in range(r.randint(0, 2)):
                own[r.randrange(150)] = "w" + str(r.randint(0, 99))
            out.append((len(out) * 7 % 1009, " ".join(own)))
    return out


def test_edges_and_brute_force(spark, edge_docs, docs, no_docs, clashing):
    check(spark, [(r[0], r[1]) for r in edge_docs] + [(i + 100, t) for i, t in near_copies(1, 6, 12)])
    assert S.near_duplicates(no_docs).count() == 0
    assert S.near_duplicates(clashing).count() == len(edge_docs)


def test_large_bucket_is_compared_in_chunks(spark):
    r = random.Random(8)
    base = r.getrandbits(62)
    fps = sorted({base ^ (1 << r.randrange(60)) ^ (1 << r.randrange(60)) ^ (1 << r.randrange(60)) for _ in range(300)})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    a = np.array(fps)
    want = np.bitwise_count(a[:, None] ^ a[None, :]) <= 4
    label = smallest(fps, want)
    got = {x["node"]: x["component"] for x in components(S.links(frame, chunk=40)).collect()}
    assert {f: got.get(f, f) for f in fps} == {f: label[i] for i, f in enumerate(fps)}
