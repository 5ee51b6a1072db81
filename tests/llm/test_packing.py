import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from lithoflow.llm import packing as K


def fewest(items, capacity):
    """By trying all partitions."""
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[i] <= capacity:
                bins[b] += items[i]
                go(i + 1, bins)
                bins[b] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_few_bins_at_small_sizes():
    r = random.Random(3)
    for _ in range(150):
        items = sorted((r.randint(1, 20) for _ in range(r.randint(1, 9))), reverse=True)
        patterns = K.complete_bins(dict(Counter(items)), 20)
        assert Counter({k: v for k, v in sum((Counter({s: c * n for s, c in Counter(p).items()}) for n, p in patterns), Counter()).items()}) == Counter(items)
        assert all(sum(p) <= 20 for _, p in patterns)
        assert sum(n for n, _ in patterns) == fewest(items, 20), items


def all_fillings(space, left):
    sizes = sorted(left, reverse=True)

    def go(i, room):
        if i == len(sizes):
            yield ()
            return
        for n in range(min(left[sizes[i]], room // sizes[i]), -1, -1):
            for rest in go(i + 1, room - n * sizes[i]):
                yield (sizes[i],) * n + rest

    return list(go(0, space))


def exchange(items, space, left):
    """Whether an item that is left is larger than some of the items together, or as large as several, and fits in their place."""
    waste = space - sum(items)
    for k in range(len(items) + 1):
        for some in itertools.combinations(items, k):
            for t in left:
                if left[t] > items.count(t) and sum(some) + (k < 2) <= t <= sum(some) + waste:
                    return True
    return False


def test_fillings_are_undominated():
    r = random.Random(7)
    for _ in range(300):
        space = r.randint(5, 40)
        left = {r.randint(1, 25): r.randint(1, 3) for _ in range(r.randint(1, 6))}
        got = K.fillings(space, list(left), left, 3, 10**6)
        want = sorted({f for f in all_fillings(space, left) if not exchange(f, space, left)}, key=lambda f: space - sum(f))
        assert not any(exchange(items, space, left) for _, items in got), (space, left, got)
        assert all(waste == space - sum(items) and all(items.count(s) <= left[s] for s in items) for waste, items in got)
        # the least waste first, and as many as there are
        assert [w for w, _ in got] == [space - sum(f) for f in want[:3]], (space, left, got, want)
        few = K.fillings(space, list(left), left, 3, 1)
        order = sorted((s for s in left if s <= space), reverse=True)
        assert few and (few[0][1] == K.best_fit(space, order, left) or few[0][0] <= space - sum(K.best_fit(space, order, left)))
    assert K.fillings(64, [37, 17, 8, 9], {37: 1, 17: 1, 8: 1, 9: 1}, 1)[0] == (1, (37, 17, 9))


def test_table(spark, docs, edge_docs, no_docs, clashing):
    got = K.pack_documents(docs).collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for r in edge_docs:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r[0], i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-sum(k[3] * n for k, n in want.items()) // 2048) + 1
    assert K.pack_documents(no_docs).count() == 0
    assert K.pack_documents(clashing).count() == len(got)


def test_added_tokens_have_their_own_ids():
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    one = "<|endoftext|>"
    texts = [one, f"a {one} b", f"a  {one}  b", f"{one}{one}\n{one}", f"x{one}y <|endoftext|", "<|ENDOFTEXT|>", "<|endof" + one + "text|>", f"word {one} " * 1500]
    got = K.cutter(P.path("byte_bpe_50k.json"), P.PATTERN, 2048, 0)([t.encode() for t in texts])[0]
    for t, pieces in zip(texts, got):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        assert one not in t or 50256 in ids
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        assert pieces == [{"piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(np.array(ids[a:b], "<u4").tobytes())} for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def test_hot_length_is_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(K, "RANK_ROWS", 20)
    pieces = spark.range(3000).selectExpr("id as doc_id", "0 as piece", "cast(if(id % 3 = 0, 700, 1 + id % 50) as bigint) as length")
    got = K.pack(pieces, ["doc_id", "piece"]).toPandas()
    assert len(got) == 3000 and not got.duplicated(["sequence_id", "offset"]).any()
    used = got.groupby("sequence_id")["length"].sum()
    # no three pieces of 700 fit one sequence, so 1,000 of them need 500
    assert used.max() <= 2048 and len(used) == 500
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.concatenate(([0], g["length"].cumsum()[:-1]))).all()
