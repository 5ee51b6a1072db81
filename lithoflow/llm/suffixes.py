"""Exact substring deduplication with suffix arrays, over documents dealt out by content.

Windows (strings of a given length, 400 bytes if none is given) that are equal have equal anchors, so each group of a
repeated anchor is decided by itself. Occurrences whose whole contexts are equal are one string with a count; the
strings are cut to blocks of 16 windows around their common core, whose few bytes on either side go to suffix arrays.
"""

from __future__ import annotations

import hashlib
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoflow.llm.anchors import WINDOW, anchors
from lithoflow.llm.common import CHUNK_BYTES, as_binary, bounded, chunks, saved, scratch, table
from lithoflow.llm.gsaca import common_prefixes, suffix_array

#: Windows in a block, a power of two; their common core has window - BLOCK + 1 bytes.
BLOCK = 16
#: Different sides of one core that a suffix array takes; larger groups are cut to blocks of half as many windows around longer cores.
GROUP = 1500
#: Texts whose equal anchors meet before they leave a task.
MEET_BYTES = 8 << 20
#: Symbols of a suffix array, which takes many groups at a time.
SYMBOLS = 1 << 16
#: A passage has so many bytes and words at least: 50 words of running text have over 200 bytes in any of the languages.
PASSAGE = (200, 50)

_KEY = ["k1", "k2"]
_ROWS = T.StructType([T.StructField(n, T.LongType()) for n in ("h", "c", *_KEY)] + [T.StructField(n, T.IntegerType()) for n in ("first", "last", "place", "kind")])
_CORE = ["b1", "b2"]
_CLASS = [*_CORE, "cid"]
_BLOCKS = T.StructType([T.StructField(n, T.LongType()) for n in (*_CORE, *_KEY)] + [T.StructField("core", T.IntegerType()), T.StructField("left", T.BinaryType()), T.StructField("right", T.BinaryType()), T.StructField("decided", T.BooleanType())])
_SPANS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("first", "last")]))
_RUNS = T.StructType([*[T.StructField(n, T.LongType()) for n in _KEY], T.StructField("runs", _SPANS)])
_PIECES = T.StructType([*[T.StructField(n, T.LongType()) for n in (*_KEY, "own")], T.StructField("at", T.IntegerType()), T.StructField("t", T.BinaryType())])
_FOUND = T.StructType([T.StructField(n, T.LongType()) for n in _CLASS] + [T.StructField(n, T.IntegerType()) for n in ("low", "high")])
_HALVES = T.StructType([T.StructField(n, T.LongType()) for n in ("p1", "p2", "pid", *_CORE)] + [T.StructField("add", T.IntegerType()), T.StructField("left", T.BinaryType()), T.StructField("right", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("decided", T.BooleanType())])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _bytes(column: pa.Array) -> list[bytes]:
    return as_binary(column).to_pylist()


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _find_anchors(batches, window: int = WINDOW):
    """Kinds: 0 single so far, 1 one of several equal in this part of the table, 2 the others of those."""
    from xxhash import xxh3_64_intdigest

    schema = _arrow(_ROWS)
    for batch in batches:
        k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for a, b in chunks(pc.binary_length(batch.column(2)).to_pylist(), MEET_BYTES):
            parts, contents = [], []
            for i, t in enumerate(_bytes(batch.column(2).slice(a, b - a)), a):
                if len(t) < window:
                    continue
                h, place, first, last = anchors(t, window)
                parts.append((h, place, first, last, np.full(len(h), i)))
                contents += [xxh3_64_intdigest(t[x : y + window]) for x, y in zip(first.tolist(), last.tolist(), strict=True)]
            if not parts:
                continue
            h, place, first, last, doc = (np.concatenate(z) for z in zip(*parts, strict=True))
            c = np.array(contents, np.uint64)
            order = np.lexsort((c, h))
            new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])))
            group = np.cumsum(new) - 1
            several = np.bincount(group)[group] > 1
            kind = np.zeros(len(h), np.int32)
            kind[order] = np.where(several, np.where(new, 1, 2), 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), c.view(np.int64), k1[doc], k2[doc], first.astype(np.int32), last.astype(np.int32), place.astype(np.int32), kind)], schema=schema)


def _packed(batches):
    """Texts compressed, for a shuffle."""
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = batch.columns[-1]
        for a, b in chunks(pc.binary_length(texts).to_pylist()):
            packed = pa.array([z.compress(t) for t in _bytes(texts.slice(a, b - a))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), packed], names=batch.schema.names)


def _unpack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31) if data else b""


def _cut_blocks(batches, window: int = WINDOW):
    """Of (k1, k2, packed text, list of (first, last, place, decided)): the blocks of each listed anchor; of repeated rows those of one."""
    from xxhash import xxh3_128_digest

    schema = _arrow(_BLOCKS)
    core_size = window - BLOCK + 1
    before = None
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            k1, k2 = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            if (k1, k2) == before:
                continue
            before = k1, k2
            text = _unpack(batch.column(2)[i].as_py())
            listed = batch.column(3)[i].values  # an array of structs: no object for each anchor is made
            for a in range(0, len(listed), 4096):
                columns = (c.to_pylist() for c in listed.slice(a, 4096).flatten())
                for first, last, place, decided in zip(*columns, strict=True):
                    for m in range((place - last) // BLOCK, (place - first) // BLOCK + 1):
                        core = place - BLOCK * m  # the block's windows begin at core - 15 to core
                        x, y = max(first, core - BLOCK + 1), min(last, core)
                        key = _halves(xxh3_128_digest(text[core : core + core_size] + m.to_bytes(4, "little", signed=True)))
                        out.append((*key, k1, k2, core, text[x:core], text[core + core_size : y + window], decided))
                if len(out) >= 20_000:
                    yield _batch(out, schema)
                    out = []
        if out:
            yield _batch(out, schema)


def _runs(numbers: list[int]) -> list[tuple[int, int]]:
    """First and last of consecutive numbers."""
    out, a = [], 0
    for i in range(1, len(numbers) + 1):
        if i == len(numbers) or numbers[i] != numbers[i - 1] + 1:
            out.append((numbers[a], numbers[i - 1]))
            a = i
    return out


def repeated_offsets(groups: list[list[tuple[bytes, bytes, int]]], block: int = BLOCK) -> list[list[set[int]]]:
    """For groups of (left, right, count) around a group's common core: for each the windows found twice or more in its group.

    A window is named by the bytes it has left of the core. All groups go to one suffix array, a core as a symbol of its
    group; a suffix that begins in a left part holds a whole window if it shares `block` symbols with a neighbour, or
    has as many symbols itself and stands for several strings.
    """
    text: list[int] = []
    owner: dict[int, tuple[int, int, int]] = {}
    mark = 256
    for g, contexts in enumerate(groups):
        mark += 1
        core = mark
        for c, (left, right, _) in enumerate(contexts):
            at = len(text)
            text += [*left, core, *right]
            mark += 1
            text.append(mark)
            for o in range(max(0, block - 1 - len(right)), len(left) + 1):
                owner[at + len(left) - o] = g, c, o
    order = suffix_array(text)
    shared = common_prefixes(text, order)
    found: list[list[set[int]]] = [[set() for _ in contexts] for contexts in groups]
    for i, s in enumerate(order):
        if s in owner:
            g, c, o = owner[s]
            if groups[g][c][2] > 1 or shared[i] >= block or i + 1 < len(order) and shared[i + 1] >= block:
                found[g][c].add(o)
    return found


def _decide(batches, block: int = BLOCK):
    """Of (b1, b2, cid, left, right, n, decided) in order of core: runs of repeated windows of the classes that are not decided."""
    schema = _arrow(_FOUND)
    waiting: list[tuple[tuple[int, int], list[tuple]]] = []
    symbols = 0
    out: list[tuple] = []

    def settle() -> None:
        nonlocal symbols
        for (key, rows), found in zip(waiting, repeated_offsets([[r[1:4] for r in rows] for _, rows in waiting], block), strict=True):
            for row, offsets in zip(rows, found, strict=True):
                if not row[4]:
                    out.extend((*key, row[0], a, b) for a, b in _runs(sorted(offsets)))
        waiting.clear()
        symbols = 0

    now, rows = None, []
    for batch in batches:
        for b1, b2, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (b1, b2) != now:
                if rows:
                    waiting.append((now, rows))
                now, rows = (b1, b2), []
                if symbols >= SYMBOLS:
                    settle()
            rows.append(tuple(row))
            symbols += len(row[1]) + len(row[2]) + 2
        if len(out) > 10_000:
            yield _batch(out, schema)
            out = []
    if rows:
        waiting.append((now, rows))
    settle()
    yield _batch(out, schema)


def _halve(batches, block: int = BLOCK):
    """Classes of crowded cores, cut to blocks of half as many windows: those with half the bytes left of the core, and the others."""
    from xxhash import xxh3_128_digest

    schema, half = _arrow(_HALVES), block // 2
    for batch in batches:
        out = []
        for b1, b2, cid, left, right, n, decided in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            head = b1.to_bytes(8, "little", signed=True) + b2.to_bytes(8, "little", signed=True)
            if len(left) >= half:
                cut = len(left) - half
                key = _halves(xxh3_128_digest(head + b"l" + left[cut:]))
                out.append((b1, b2, cid, *key, half, left[:cut], right[: half - 1], n, decided))
            if len(right) >= half:
                key = _halves(xxh3_128_digest(head + b"r" + right[:half]))
                out.append((b1, b2, cid, *key, 0, left[max(0, len(left) - half + 1) :], right[half:], n, decided))
        yield _batch(out, schema)


def _cid():
    return F.xxhash64("left", "right").alias("cid")


def _repeated(classes: DataFrame, group: int, block: int = BLOCK) -> DataFrame:
    """(b1, b2, cid, low, high): the windows, by their bytes left of the core, that are found twice or more, of classes not decided.

    classes: (b1, b2, cid, left, right, n, decided), one row for the same sides of a core. A core with one class has its
    count only; up to `group` classes are one group of a suffix array; the classes of a core that has more are cut in
    half, meet again by longer cores, and what is found there is theirs.
    """
    cores = classes.groupBy(*_CORE).agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.min("decided").alias("done"))
    cores = saved(cores.where("total > 1 and not done").select(*_CORE, "k"))
    met = classes.join(cores, _CORE)
    low, high = F.greatest(F.lit(0), F.lit(block - 1) - F.octet_length("right")).alias("low"), F.octet_length("left").alias("high")
    alone = met.where("k = 1").select(*_CLASS, low, high)
    columns = [*_CLASS, "left", "right", "n", "decided"]
    several = met.where((F.col("k") > 1) & (F.col("k") <= group)).select(*columns)
    out = alone.unionByName(several.repartition(*_CORE).sortWithinPartitions(*_CORE).mapInArrow(partial(_decide, block=block), _FOUND))
    crowded = cores.where(F.col("k") > group)
    if crowded.isEmpty():
        return out
    halves = saved(met.where(F.col("k") > group).select(*columns).mapInArrow(partial(_halve, block=block), _HALVES).withColumn("cid", _cid()))
    merged = halves.groupBy(*_CLASS, "left", "right").agg(F.sum("n").alias("n"), F.min("decided").alias("decided"))
    found = saved(_repeated(saved(merged), group, block // 2))
    shifted = halves.where("not decided").select("p1", "p2", "pid", *_CLASS, "add").join(found, _CLASS)
    return out.unionByName(shifted.select(F.col("p1").alias("b1"), F.col("p2").alias("b2"), F.col("pid").alias("cid"), (F.col("low") + F.col("add")).alias("low"), (F.col("high") + F.col("add")).alias("high")))


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    own = F.col(f"`{id_col}`")
    return bounded(docs).withColumn("__k1", F.xxhash64(t, own)).withColumn("__k2", F.xxhash64(own, t, F.lit(1))).withColumn("__t", t)


def merged_starts(spans: list[tuple[int, int]]) -> list[list[int]]:
    """First and last of consecutive window starts."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _span_lists(column: pa.Array):
    """Each row's list of (first, last); of a null an empty one."""
    for i in range(len(column)):
        found = column[i].values
        yield [] if found is None else list(zip(*(c.to_pylist() for c in found.flatten()), strict=True))


def _long_runs(batches, more: int):
    """Of (k1, k2, spans): consecutive starts, over `more` of them, of the texts that have any."""
    schema = _arrow(_RUNS)
    for batch in batches:
        rows = []
        for k1, k2, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _span_lists(batch.column(2)), strict=True):
            runs = [{"first": a, "last": b} for a, b in merged_starts(spans) if b - a >= more]
            if runs:
                rows.append((k1, k2, runs))
        yield _batch(rows, schema)


def _cut_pieces(batches, shorter: int):
    """Of (k1, k2, packed text, runs of window starts): the bytes of each run's windows, where they begin, and a second key of their own."""
    schema = _arrow(_PIECES)
    for batch in batches:
        out, size = [], 0
        for k1, k2, packed, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), _span_lists(batch.column(3)), strict=True):
            text = _unpack(packed.as_py())
            for a, b in runs:
                own = (k2 + a + (1 << 63)) % (1 << 64) - (1 << 63)
                out.append((k1, k2, own, a, text[a : b + shorter]))
                size += b + shorter - a
                if size > CHUNK_BYTES:
                    yield _batch(out, schema)
                    out, size = [], 0
        yield _batch(out, schema)


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, group: int = GROUP, *, within: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(k1, k2, first, last): window starts of each text (by the hashes of id and text) at which the window's bytes also start elsewhere.

    within: (k1, k2, spans) for shorter windows, and their length. All shorter strings of a repeated string are repeated, so
    only pieces of texts in which they follow each other for a whole window are looked at, and nothing is lost.
    """
    keyed = _keyed(docs, id_col, text)
    plain = keyed.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col("__t").alias("t")).where(F.octet_length("t") >= window)
    if within is None:
        return _windows_of(plain, window, group)
    spans, shorter = within
    runs = saved(spans.select(*_KEY, "spans").mapInArrow(partial(_long_runs, more=window - shorter), _RUNS))
    packed = plain.mapInArrow(_packed, "k1 long, k2 long, t binary")
    pieces = saved(packed.join(runs, _KEY).select(*_KEY, "t", "runs").mapInArrow(partial(_cut_pieces, shorter=shorter), _PIECES))
    found = _windows_of(pieces.select("k1", F.col("own").alias("k2"), "t"), window, group).withColumnRenamed("k2", "own")
    places = pieces.select(*_KEY, "own", "at").distinct()  # repeated rows have equal pieces
    return found.join(places, ["k1", "own"]).select(*_KEY, (F.col("first") + F.col("at")).alias("first"), (F.col("last") + F.col("at")).alias("last"))


def _windows_of(plain: DataFrame, window: int, group: int) -> DataFrame:
    """repeated_windows of (k1, k2, t).

    1. Anchors of all texts, each with a hash of its context (the bytes of all its windows). Equal ones meet in their
       part of the table already.
    2. By anchor, counted before the shuffle: contexts that occur twice are repeated whole. One of each goes on with
       its count, if another of its anchor occurs once; where none does, suffix arrays have nothing to tell apart.
    3. These are cut to blocks; blocks meet by a hash of their core. Equal ones are one class with a count, found
       before the shuffle; the classes of a core go to suffix arrays, of crowded cores after being cut in half.
    """
    rows = saved(plain.mapInArrow(partial(_find_anchors, window=window), _ROWS))
    weight = F.when(F.col("kind") == 1, F.lit(2)).otherwise(F.lit(1))
    first = rows.where("kind < 2").select("h", "c", *_KEY, "first", "last", "place", weight.alias("weight"))
    # counts are saved before they are joined back: a join of two plain shuffles can be split where an anchor is frequent
    by_anchor = saved(first.groupBy("h").agg(F.sum("weight").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("n > 1").select("h", (F.col("low") == F.col("high")).alias("same")))
    repeated = saved(first.join(by_anchor, "h"))
    span = [*_KEY, "first", "last"]
    spans = [rows.where("kind > 0").select(*span), repeated.where("same").select(*span)]

    mixed = repeated.where("not same")
    contexts = saved(mixed.groupBy("h", "c").agg(F.sum("weight").alias("n"), F.min(F.struct(*_KEY, "first", "last", "place")).alias("one")))
    spans.append(mixed.join(contexts.where("n > 1").select("h", "c"), ["h", "c"]).select(*span))
    open_anchors = saved(contexts.groupBy("h").agg(F.min("n").alias("least")).where("least = 1").select("h"))
    ones = contexts.join(open_anchors, "h").select("one.*", (F.col("n") > 1).alias("decided"))
    by_text = saved(ones.groupBy(*_KEY).agg(F.collect_list(F.struct("first", "last", "place", "decided")).alias("listed")))
    packed = plain.mapInArrow(_packed, "k1 long, k2 long, t binary")
    blocks = saved(packed.join(by_text, _KEY).select(*_KEY, "t", "listed").mapInArrow(partial(_cut_blocks, window=window), _BLOCKS))

    sides = [*_CORE, "left", "right"]
    counted = blocks.groupBy(*sides).agg(F.sum(F.when(F.col("decided"), 2).otherwise(1)).alias("n"), F.min("decided").alias("decided"))
    found = saved(_repeated(saved(counted.withColumn("cid", _cid())), group))
    own = blocks.where("not decided").select(*_CORE, _cid(), *_KEY, "core").join(found, _CLASS)
    spans.append(own.select(*_KEY, (F.col("core") - F.col("high")).alias("first"), (F.col("core") - F.col("low")).alias("last")))
    return reduce(DataFrame.unionByName, spans)


def removed_runs(spans: list[tuple[int, int]], window: int = WINDOW, text: bytes = b"", min_words: int = 0) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the windows that start in spans; min_words: only by repeated strings of that many words of text."""
    out: list[list[int]] = []
    for a, b in merged_starts(spans):
        b += window
        if min_words and len(text[a:b].split()) < min_words:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None, as_text: bool = False, window: int = WINDOW, min_words: int = 0, passages: tuple[int, int] | None = None) -> DataFrame:
    """keep's columns, n_bytes, n_removed, n_spans, kept_sha256 and kept: the bytes left of each text.

    Each byte goes that is covered by a string of `window` bytes which also starts anywhere else, in this text or
    another; all strings are judged on the input. min_words: a repeated string (of window bytes or more) with fewer words stays.
    as_text: kept is a string, without the bytes of characters that were cut. window has BLOCK bytes at least.
    passages: (bytes, fewer than window's; words): adds n_passages and n_passage_bytes, the maximal runs of repeated strings of so many bytes
    and words at least, and their bytes. These are only counted; what is removed doesn't depend on them.

    Null texts are empty. Repeated rows are each other's copies. Texts shorter than window
    stay as they are. Columns that are not kept don't matter; kept ones named like a result give way. An empty table stays empty.
    """
    if window < BLOCK:
        raise ValueError(f"windows have {BLOCK} bytes at least")
    if passages and not BLOCK <= passages[0] < window:
        raise ValueError(f"passages have {BLOCK} bytes at least, and fewer than a window")
    new = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("kept", T.StringType() if as_text else T.BinaryType())]
    new += [("n_passages", T.LongType()), ("n_passage_bytes", T.LongType())] if passages else []
    keep = [k for k in (docs.columns if keep is None else keep) if k not in [n for n, _ in new]]
    # kept before the last join, which then is one of two plain shuffles and can be split at rows that are there many times
    listed = lambda found: found.groupBy(*_KEY).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    if passages:
        with scratch(docs.sparkSession):
            short = saved(listed(repeated_windows(docs, id_col, text, passages[0])), stays=True)
        with scratch(docs.sparkSession):
            long = listed(repeated_windows(docs, id_col, text, window, within=(short, passages[0])))
            spans = saved(short.withColumnRenamed("spans", "short").join(long, _KEY, "left"), stays=True)
    else:
        with scratch(docs.sparkSession):
            spans = saved(listed(repeated_windows(docs, id_col, text, window)), stays=True)
    source = _keyed(docs, id_col, text).select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.struct(*[F.col(f"`{k}`") for k in keep]).alias("row"), F.col("__t").alias("t"))
    row_type = source.schema["row"].dataType
    packed = source.mapInArrow(_packed, T.StructType([*source.schema.fields[:3], T.StructField("t", T.BinaryType())]))
    schema = T.StructType([T.StructField("row", row_type), *[T.StructField(n, t) for n, t in new]])

    def remove(batches):
        arrow = _arrow(schema)
        for batch in batches:
            out, begun, size = [[] for _ in new], 0, 0

            def made(stop: int):
                return pa.RecordBatch.from_arrays([batch.column(0).slice(begun, stop - begun).cast(arrow.field(0).type), *[pa.array(x, arrow.field(i + 1).type) for i, x in enumerate(out)]], schema=arrow)  # noqa: B023

            for row in range(batch.num_rows):
                if size > CHUNK_BYTES:
                    yield made(row)
                    out, begun, size = [[] for _ in new], row, 0
                t, (found, *short) = _unpack(batch.column(1)[row].as_py()), [next(_span_lists(c.slice(row, 1))) for c in batch.columns[2:]]
                size += len(t)
                runs = removed_runs(found, window, t, min_words)
                at, left = 0, []
                for a, b in runs:
                    left.append(t[at:a])
                    at = b
                left.append(t[at:])
                kept = b"".join(left)
                values = [len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if as_text else kept]
                if passages:
                    told = removed_runs(short[0], passages[0], t, passages[1])
                    values += [len(told), sum(b - a for a, b in told)]
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield made(batch.num_rows)

    return packed.join(spans, _KEY, "left").select("row", "t", "spans", *["short"][: bool(passages)]).mapInArrow(remove, schema).select("row.*", *[n for n, _ in new])


def op7(spark, sf_dir: str) -> DataFrame:
    """What is removed goes by windows of 400 bytes; repeated passages, which may be shorter, are counted beside that."""
    return deduplicate(table(spark, sf_dir, "documents"), keep=["doc_id"], passages=PASSAGE).drop("kept")
