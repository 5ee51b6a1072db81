"""Best-fit packing of token sequences by bin completion with branch and bound."""

from __future__ import annotations

import bisect
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoflow.llm.common import durable, map_texts, table

CAPACITY = 2048
#: Fillings that one search for a completion may look at, completions that a node branches on, and nodes in all. Beyond
#: them stand the best fit and the best packing found so far; every piece is placed whatever they are.
FILL_NODES, BRANCHES, NODES = 200, 3, 20_000
#: Pieces of one length that are numbered by one task, and the least number of such tasks a length.
RANK_ROWS, RANK_TASKS = 250_000, 16


def _sums(items: tuple[int, ...]) -> tuple[int, int]:
    """Sums of any of the items, and of two or more of them, as sets of bits."""
    one, two, none = 0, 0, 1
    for s in items:
        two |= (one | two) << s
        one |= none << s
    return none | one | two, two


def dominated(items: tuple[int, ...], waste: int, left: dict[int, int], sizes: int) -> bool:
    """Whether one item that is left could stand in the place of some of the items, and of more of the waste.

    That item is larger than those together (none of them, one or several), or as large as two or more of them: the
    other filling leaves smaller items, which fit wherever it fits. sizes: those with an item left, as a set of bits.
    """
    there = sizes
    for s in set(items):
        if left[s] <= items.count(s):
            there &= ~(1 << s)
    some, several = _sums(items)
    spread, width = some << 1, 1
    while width < waste:
        more = min(width, waste - width)
        spread |= spread << more
        width += more
    return bool(several & there) or waste > 0 and bool(spread & there)


def best_fit(space: int, order: list[int], left: dict[int, int]) -> tuple[int, ...]:
    """The largest item that fits, again and again; no filling dominates it. order: sizes, descending."""
    items: list[int] = []
    for s in order:
        n = min(left[s], space // s)
        items += [s] * n
        space -= n * s
    return tuple(items)


def fillings(space: int, sizes: list[int], left: dict[int, int], most: int, limit: int = FILL_NODES) -> list[tuple[int, tuple[int, ...]]]:
    """Undominated fillings of space, as (waste, sizes), least waste first, at most `most` of them.

    The best fit is the incumbent. Which sums the sizes from a place on can make is known as sets of bits, so that each
    branch has an exact bound: wastes are tried from the least on, and a branch that can't come to that waste isn't entered.
    It ends with `most` fillings or after `limit` that were looked at; the best fit is among them, or worse than all of them.
    """
    order = sorted((s for s in sizes if s <= space and left.get(s)), reverse=True)
    if not order:
        return [(space, ())]
    mask = (1 << (space + 1)) - 1
    reach = [1] * (len(order) + 1)
    for i in range(len(order) - 1, -1, -1):
        r, copies, step = reach[i + 1], min(left[order[i]], space // order[i]), 1
        while copies:
            step = min(step, copies)
            r |= r << (step * order[i])
            copies -= step
            step *= 2
        reach[i] = r & mask
    incumbent = best_fit(space, order, left)
    there = sum(1 << s for s in order)
    negative = [-s for s in order]
    best: list[tuple[int, tuple[int, ...]]] = []
    seen = 0
    for waste in range(space + 1):
        if len(best) >= most or seen >= limit:
            break
        if not reach[0] >> (space - waste) & 1:
            continue
        # sum still to make, place from which on, copies to try there at most, items so far; the largest items are tried first
        stack: list[tuple[int, int, int, tuple[int, ...]]] = [(space - waste, 0, space, ())]
        while stack and len(best) < most and seen < limit:
            room, at, copies, items = stack.pop()
            if not room:
                seen += 1
                if not dominated(items, waste, left, there):
                    best.append((waste, items))
                continue
            fits = bisect.bisect_left(negative, -room, at)
            if fits > at:
                at, copies = fits, space
            while at < len(order) and reach[at] >> room & 1:
                s = order[at]
                copies = min(copies, left[s], room // s)
                while copies and not reach[at + 1] >> (room - copies * s) & 1:
                    copies -= 1
                if copies:
                    stack.append((room, at, copies - 1, items) if copies > 1 else (room, at + 1, space, items))
                    stack.append((room - copies * s, at + 1, space, (*items, *[s] * copies)))
                    break
                at, copies = at + 1, space
    own = (space - sum(incumbent), incumbent)
    if own not in best and len(best) < most:
        best = sorted([*best, own], key=lambda x: x[0])
    return best


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (number of bins, lengths in a bin) that hold counts[length] pieces of each length.

    Depth first: the largest length left opens bins; each undominated filling around it is a branch, used as often as
    counts allow. The first descent takes least waste each time and is the incumbent; a branch ends when its waste
    exceeds what one bin less than the incumbent leaves. It ends at the bound ceil(total / capacity), or after nodes.
    """
    counts = {k: n for k, n in counts.items() if n > 0}
    total = sum(k * n for k, n in counts.items())
    least = -(-total // capacity)
    best: list | None = None
    best_bins = float("inf")
    used = 0

    def options(left):
        size = max(left)
        one = dict(left)
        one[size] -= 1
        found = []
        for waste, items in fillings(capacity - size, list(one), one, BRANCHES):
            need: dict[int, int] = {}
            for s in (size, *items):
                need[s] = need.get(s, 0) + 1
            found.append((waste, (size, *items), min(left[s] // n for s, n in need.items()), need))
        return found

    # each frame: counts left, options not tried, pattern taken to come here, waste, bins
    stack = [(counts, None, None, 0, 0)]
    path: list = []
    while stack:
        left, todo, came, waste, bins = stack.pop()
        if todo is None:
            if came is not None:
                path.append(came)
            if not left:
                if bins < best_bins:
                    best, best_bins = list(path), bins
                    if bins <= least:
                        break
                if came is not None:
                    path.pop()
                continue
            todo = options(left)
        if not todo or (best is not None and (used >= nodes or waste > (best_bins - 1) * capacity - total)):
            if came is not None:
                path.pop()
            continue
        used += 1
        w, items, m, need = todo[0]
        stack.append((left, todo[1:], came, waste, bins))
        rest = dict(left)
        for s, n in need.items():
            rest[s] -= n * m
            if not rest[s]:
                del rest[s]
        stack.append((rest, None, (m, items), waste + w * m, bins + m))
    return best or []


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, list[tuple[int, int, int, list[int]]]]:
    """For each length, in order of rank: first rank, pieces of it in a bin, first bin, offsets in a bin."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    first_bin = 0
    for m, items in patterns:
        at: dict[int, list[int]] = {}
        offset = 0
        for s in items:
            at.setdefault(s, []).append(offset)
            offset += s
        for s, offsets in at.items():
            out.setdefault(s, []).append((taken.get(s, 0), len(offsets), first_bin, offsets))
            taken[s] = taken.get(s, 0) + len(offsets) * m
        first_bin += m
    return out


def pack(pieces: DataFrame, keys: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset: bins of at most capacity, gapless from 0.

    Only the number of pieces of each length (capacity numbers) comes to the driver, where bins are completed. Pieces of
    a length are numbered in salted groups and look their bin up. Null or non-positive lengths, and lengths beyond
    capacity, are errors. Repeated rows are pieces each. An empty table stays empty.
    """
    spark = pieces.sparkSession
    pieces = durable(pieces)
    n_of = {r["n"]: r["c"] for r in pieces.groupBy(F.col(length).alias("n")).agg(F.count("*").alias("c")).collect()}
    if any(n is None or n < 1 or n > capacity for n in n_of):
        raise ValueError(f"lengths must be in 1..{capacity}")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    if not n_of:
        return spark.createDataFrame([], schema)
    plan = places(complete_bins(n_of, capacity))
    tasks = {n: max(RANK_TASKS, -(-c // RANK_ROWS)) for n, c in n_of.items()}
    salts = F.element_at(F.array(*[F.lit(tasks.get(n, RANK_TASKS)) for n in range(1, capacity + 1)]), F.col(length).cast("int"))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*keys), salts).cast("int"))
    before: dict[tuple[int, int], int] = {}
    run: dict[int, int] = {}
    for r in sorted(salted.groupBy(F.col(length).alias("n"), "__salt").agg(F.count("*").alias("c")).collect(), key=lambda r: (r["n"], r["__salt"])):
        before[r["n"], r["__salt"]] = run.get(r["n"], 0)
        run[r["n"]] = run.get(r["n"], 0) + r["c"]
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy(length, "__salt").orderBy(*keys)).cast("long") - 1)
    sent = spark.sparkContext.broadcast((before, plan))
    names = pieces.columns

    def place(frames):
        before, plan = sent.value
        firsts = {n: np.array([x[0] for x in v], np.int64) for n, v in plan.items()}
        for frame in frames:
            sizes, rank = frame[length].to_numpy(np.int64), frame["__rank"].to_numpy(np.int64).copy()
            salt = frame["__salt"].to_numpy(np.int64)
            seq, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for n in np.unique(sizes):
                rows = np.nonzero(sizes == n)[0]
                r = rank[rows] + np.array([before[n, s] for s in salt[rows].tolist()], np.int64)
                which = np.searchsorted(firsts[n], r, "right") - 1
                for p in np.unique(which):
                    mine = which == p
                    first, in_bin, first_bin, offsets = plan[n][p]
                    k = r[mine] - first
                    seq[rows[mine]] = first_bin + k // in_bin
                    offset[rows[mine]] = np.array(offsets, np.int64)[k % in_bin]
            out = frame[names].copy()
            out["sequence_id"], out["offset"] = seq, offset
            yield out

    return ranked.mapInPandas(place, schema)


@lru_cache(2)
def _tokenizer(path: str, pattern: str):
    """The byte-level BPE of a tokenizers file, run by the faster of the two libraries that give its ids.

    Ids of such a file are its merges' order, so its vocabulary, bytes written out, is a table of ranks. Added tokens
    split a text and have their own ids, as there; those that take blanks or whole words only are an error.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    vocabulary, added = whole["model"]["vocab"], whole.get("added_tokens") or []
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens must not take blanks or whole words only")
    # byte-level files write each byte as a printable character: itself if it is one, else the next from U+0100
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special and all(c in byte_of for c in token)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def cutter(path: str, pattern: str, capacity: int, end_id: int):
    encoding = _tokenizer(path, pattern)

    def one(text: bytes | None) -> list[dict]:
        """(piece, start, length, crc) of each piece; only the first may be shorter."""
        ids = encoding.encode_to_numpy((text or b"").decode("utf-8", "replace"), allowed_special="all")
        data = ids.astype("<u4").tobytes() + end_id.to_bytes(4, "little")
        n = len(data) // 4
        cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
        return [{"piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(data[4 * a : 4 * b])} for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]

    return lambda texts: [[one(t) for t in texts]]


_PIECES = T.ArrayType(T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]))


def cut(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece of every whole text: its ids by the tokenizer at path, then end_id; longer ones are cut at capacity.

    pattern is the tokenizer's own word split. Null texts are empty: one piece that holds end_id alone. Repeated rows are cut one by one; columns that aren't kept don't matter.
    """
    made = map_texts(docs, text, keep, [("__pieces", _PIECES)], lambda: cutter(path, pattern, capacity, end_id))
    return made.select(*[F.col(f"`{k}`") for k in keep], F.inline("__pieces"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """The query's columns for any table of documents."""
    import public_tokenizers as P

    pieces = cut(docs, P.path("byte_bpe_50k.json"), P.PATTERN, ["doc_id"])
    return pack(pieces, ["doc_id", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
