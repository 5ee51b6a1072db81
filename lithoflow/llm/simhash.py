"""SimHash near-duplicates: fingerprints compared in bit-sliced blocks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoflow.llm.common import durable, map_texts, table
from lithoflow.llm.graph import components

SHINGLE, SEED, RADIUS, BITS = 4, 42, 4, 64
#: Fingerprints of a bucket that one task compares with as many others; larger buckets are cut into chunks, compared two by two.
CHUNK = 1024
#: Planes between two looks at which blocks are beyond the radius.
LOOK = 8
#: Fingerprints that a bucket should hold on average at most; more blocks are taken above that.
BUCKET = 1024


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """64 bits: each is set in over half the XXH64 (seed 42) of word shingles; no word: zero."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size])).tolist()
    total = np.zeros(BITS, np.int64)
    stops = (ends[size - 1 :] - 1).tolist()
    for a in range(0, len(stops), 1 << 17):
        part = [xxh64_intdigest(joined[x:y], SEED) for x, y in zip(starts[a : a + (1 << 17)], stops[a : a + (1 << 17)], strict=False)]
        total += np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(stops), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep's columns and fp, the fingerprint as a signed long. A-Z are lower-cased; words end at ASCII white space."""

    def make():
        return lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs, text, keep, [("fp", T.LongType())], make)


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: plane k holds bit k of all fingerprints, 64 of them a word."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near(queries: np.ndarray, fps: np.ndarray, apart: np.ndarray | None = None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): queries[i] and fps[j] differ in at most radius bits. apart: pairs not to be compared.

    Each query meets 64 fingerprints at a time: a plane's differences are added by carry-save to counters that are bit
    planes themselves. A word of 64 in which all exceed the radius is dead; queries whose words are all dead leave.
    """
    if not len(queries) or not len(fps):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sliced, words = planes(fps), -(-len(fps) // 64)
    over = np.zeros((len(queries), words), np.uint64)
    if apart is not None:
        wide = np.ones((len(queries), words * 64), bool)
        wide[:, : len(fps)] = apart
        over = np.ascontiguousarray(np.packbits(wide, axis=1, bitorder="little")).view(np.uint64)
    elif len(fps) % 64:
        over[:, -1] = np.uint64((2**64 - 1) ^ (2 ** (len(fps) % 64) - 1))
    alive = np.arange(len(queries))
    width = max(1, radius.bit_length())
    counters = [np.zeros_like(over) for _ in range(width)]
    full = np.uint64(2**64 - 1)
    for k in range(BITS):
        carry = sliced[k][None, :] ^ (np.uint64(0) - (queries[alive] >> np.uint64(k) & np.uint64(1)))[:, None]
        for c in range(width):
            counters[c], carry = counters[c] ^ carry, counters[c] & carry
        over |= carry
        if k % LOOK == LOOK - 1:
            beyond = over | _greater(counters, radius)
            left = (beyond != full).any(1)
            if not left.any():
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            if left.mean() < 0.8:
                alive, over, counters = alive[left], over[left], [c[left] for c in counters]
    within = ~(over | _greater(counters, radius))
    i, word = np.nonzero(within)
    bits = np.unpackbits(np.ascontiguousarray(within[i, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return alive[i[row]], word[row] * 64 + bit


def _greater(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter (least bit first) is greater than radius."""
    above, same = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for c in range(len(counters) - 1, -1, -1):
        if radius >> c & 1:
            same = same & counters[c]
        else:
            above, same = above | (same & counters[c]), same & ~counters[c]
    return above


def scheme(n: int, radius: int = RADIUS) -> tuple[int, int]:
    """(blocks, blocks that must agree): radius differing bits leave that many of the blocks as they are; more blocks for more fingerprints."""
    for spare in range(1, 5):
        blocks = radius + spare
        if BITS // blocks * spare >= np.log2(max(1, n) / BUCKET) or spare == 4:
            return blocks, spare
    raise AssertionError


def keys(n: int, radius: int = RADIUS) -> list[int]:
    """Masks of which each two fingerprints within radius agree on one at least."""
    blocks, spare = scheme(n, radius)
    cuts = [round(BITS * i / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(blocks)]
    return [sum(x) for x in combinations(parts, spare)]


_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links, each node linked to its tree's smallest."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(find(x), x) for x in list(root) if find(x) != x]


def _linked(fp: np.ndarray, side: np.ndarray, group: np.ndarray, radius: int, chunk: int) -> list[tuple[int, int]]:
    """A forest of the links inside each group; or, where a second side is there, between the sides."""
    bits, out = fp.view(np.uint64), []
    if side.any():
        q, f = np.nonzero(side == 0)[0], np.nonzero(side)[0]
        i, j = near(bits[q], bits[f], None, radius)
        out.append((fp[q][i], fp[f][j]))
    else:
        for a in range(0, len(fp), chunk):
            # groups are in order: a query's own ends not far behind it
            rows = np.arange(a, min(len(fp), a + chunk))
            stop = int(np.searchsorted(group, group[rows[-1]], "right"))
            apart = (group[rows][:, None] != group[a:stop][None, :]) | (rows[:, None] >= np.arange(a, stop)[None, :])
            i, j = near(bits[rows], bits[a:stop], apart, radius)
            out.append((fp[rows][i], fp[a:stop][j]))
    x, y = (np.concatenate(z) for z in zip(*out, strict=True))
    return forest(x, y) if len(x) else []


def compare(frames, radius: int = RADIUS, chunk: int = CHUNK):
    """Links of (mask, key, lo, hi, side, fp) rows in order of these: small buckets are compared together, pairs of chunks alone."""
    import pandas as pd

    names = ["mask", "key", "lo", "hi", "side", "fp"]
    table_of = lambda made: pd.DataFrame(made, columns=["a", "b"], dtype=np.int64)
    rest = np.zeros((0, len(names)), np.int64)

    def whole(rows: np.ndarray, cut: np.ndarray):
        """Ranges of complete groups, which begin at cut."""
        pair = rows[cut, 2] != rows[cut, 3]
        at = 0
        stops = np.append(cut[1:], len(rows))
        for g in range(len(cut)):
            a, b = int(cut[g]), int(stops[g])
            if pair[g]:
                if a > at:
                    yield at, a
                yield a, b
                at = b
            elif b - at >= chunk:
                yield at, b
                at = b
        if len(rows) > at:
            yield at, len(rows)

    def run(rows: np.ndarray, cut: np.ndarray):
        number = np.zeros(len(rows), np.int64)
        number[cut[1:]] = 1
        number = np.cumsum(number)
        for a, b in whole(rows, cut):
            if b - a > 1:
                yield table_of(_linked(rows[a:b, 5].copy(), rows[a:b, 4], number[a:b], radius, chunk))

    def starts(rows: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.nonzero((rows[1:, :4] != rows[:-1, :4]).any(1))[0] + 1))

    for frame in frames:
        rows = np.concatenate([rest, frame[names].to_numpy(np.int64)])
        if not len(rows):
            continue
        cut = starts(rows)
        rest = rows[cut[-1] :]
        if len(cut) > 1:
            yield from run(rows[: cut[-1]], cut[:-1])
    if len(rest):
        yield from run(rest, starts(rest))
    yield table_of([])


def links(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links of distinct fingerprints (column fp) that have the same components as all links within radius.

    Fingerprints within radius agree on one of the masks' blocks, so buckets by those lose no link. Buckets of more than
    chunk fingerprints are dealt out as pairs of chunks, each a task's part.
    """
    n = fps.count()
    masks = keys(n, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    cand = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])).alias("x")).select("fp", "x.mask", "x.key")
    sizes = cand.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    parts = F.coalesce(F.ceil(F.col("n") / chunk), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = cand.join(sizes, ["mask", "key"], "left").withColumn("parts", parts).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("mask", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")
    by = ["mask", "key", "lo", "hi"]
    ordered = dealt.repartition(*by).sortWithinPartitions(*by, "side")
    return ordered.mapInPandas(lambda frames: compare(frames, radius, chunk), _LINKS)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None, radius: int = RADIUS) -> DataFrame:
    """keep's columns, fp (signed long) and component_id: the smallest id of all rows that links of fingerprints reach.

    Null texts and texts without a word have fingerprint zero and are linked like any other. Equal fingerprints meet
    once; repeated rows come out each. Rows with a null id are linked like others and give no smallest id unless all of a
    component's are null. id_col may be a struct, by which rows with equal ids are told apart. Columns that aren't kept don't matter; kept ones named fp or component_id give way. An empty table stays empty.
    """
    keep = [k for k in (docs.columns if keep is None else keep) if k not in ("fp", "component_id")]
    keep = keep if id_col in keep else [id_col, *keep]
    marked = durable(fingerprints(docs, keep, text))
    found = durable(marked.groupBy("fp").agg(F.min(F.col(f"`{id_col}`")).alias("__least")))
    linked = components(links(found.select("fp"), radius))
    # all three are kept before they are joined: each join then is one of two plain shuffles and can be split where a
    # component or a fingerprint is frequent
    labels = durable(found.join(linked, found["fp"] == linked["node"], "left").select("fp", "__least", F.coalesce("component", "fp").alias("__component")))
    least = durable(labels.groupBy("__component").agg(F.min("__least").alias("component_id")))
    named = durable(labels.join(least, "__component").select("fp", "component_id"))
    return marked.join(named, "fp").select(*[F.col(f"`{k}`") for k in keep], "fp", "component_id")


def op3(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
