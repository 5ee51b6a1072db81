"""Language identification by rank-order profiles: out-of-place distance between n-gram ranks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoflow.llm.common import as_binary, bounded, chunks, map_texts

#: N-grams in a profile.
PROFILE = 300
#: Characters of a text that are counted at a time; the counts of all parts add up to those of the whole.
PART = 1 << 20
#: Codes of a language that wait to be added up.
MERGE = 1 << 17


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point to itself where it is a letter, else to 32 (any run of which is one blank)."""
    out = np.full(0x110000, 32, np.uint32)
    ok = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    out[ok] = np.nonzero(ok)[0]
    return out


def ngrams(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes (1 to 3 code points, 21 bits each) in ascending order, and counts. Runs of non-letters are one blank, as are both ends.

    A part counts the n-grams that end in it; the two code points before it are carried over.
    """
    codes, counts = [], []
    low = (text or b"").decode("utf-8", "replace").lower()
    before = np.zeros(0, np.uint64)
    for at in range(0, len(low), PART):
        raw = np.frombuffer(low[at : at + PART].encode("utf-32-le", "replace"), np.uint32)
        ends = ([32] if at == 0 else []), ([32] if at + PART >= len(low) else [])
        c = np.concatenate((before, _letters()[np.concatenate((ends[0], raw, ends[1])).astype(np.uint32)].astype(np.uint64)))
        blank = c == 32
        double = blank & np.concatenate(([False], blank[:-1]))
        c = c[~double]
        new = len(before)
        two = (c[:-1] << np.uint64(21)) | c[1:]
        three = (two[:-1] << np.uint64(21)) | c[2:]
        one = c[new:]
        x, n = np.unique(np.concatenate((one[one != 32], two[max(0, new - 1) :], three[max(0, new - 2) :])), return_counts=True)
        codes.append(x)
        counts.append(n)
        before = c[-2:]
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(codes) == 1:
        return codes[0], counts[0]
    x, where = np.unique(np.concatenate(codes), return_inverse=True)
    return x, np.bincount(where, np.concatenate(counts)).astype(np.int64)


class Counts:
    """Sum of counts by code. What came is added up once it is as long as the sum so far, and MERGE codes at least."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.known = self.new = 0

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((codes, counts))
        self.new += len(codes)
        if self.new >= max(MERGE, self.known):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            x, where = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
            self.parts = [(x, np.bincount(where, np.concatenate([p[1] for p in self.parts])).astype(np.int64))]
            self.known, self.new = len(x), 0
        return self.parts[0]


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The size most frequent codes, most frequent first, ties to the smaller code."""
    return codes[np.lexsort((codes, -counts))[:size]]


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, list[int]]:
    """Each language's size most frequent n-grams over all rows with a language.

    Counts are added per task and language, then over tasks; size rows a language come to the driver. Rows whose
    language or text is null teach nothing. No row at all: no profile.
    """
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])
    source = bounded(docs).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")

    def count(batches):
        held: dict[str, Counts] = {}
        for batch in batches:
            texts = as_binary(batch.column(1))
            for a, b in chunks(pc.binary_length(texts).to_pylist()):
                for k, t in zip(batch.column(0).slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist(), strict=True):
                    held.setdefault(k, Counts()).add(*ngrams(t))
        while held:
            k, counts = held.popitem()
            x, n = counts.total()
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(k, pa.string()), len(x)), pa.array(x.astype(np.int64)), pa.array(n)], names=schema.names)

    total = source.mapInArrow(count, schema).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    by_lang = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = total.withColumn("rank", F.row_number().over(by_lang)).where(F.col("rank") <= size)
    out: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["code"])
    return out


def classifier(profiles: dict[str, list[int]], size: int = PROFILE):
    """Function from texts to (languages, scores)."""
    names = sorted(profiles)
    known = np.unique(np.array([c for n in names for c in profiles[n]], np.uint64))
    ranks = np.full((len(known) + 1, len(names)), size, np.int64)
    for j, n in enumerate(names):
        at = np.searchsorted(known, np.array(profiles[n], np.uint64))
        ranks[at, j] = np.arange(len(profiles[n]))
    missing = len(known)

    def one(text: bytes | None) -> tuple[str, float]:
        codes, counts = ngrams(text)
        if not len(codes) or not names:
            return "und", 0.0
        top = ranked(codes, counts, size)
        at = np.searchsorted(known, top)
        at[at == missing] = 0
        at = np.where(known[at] == top, at, missing)
        far = np.abs(ranks[at] - np.arange(len(top))[:, None])
        far[at == missing] = size
        far[(ranks[at] == size)] = size
        distance = far.sum(0)
        best = int(distance.argmin())
        return names[best], 1.0 - float(distance[best]) / (size * len(top))

    return lambda texts: list(map(list, zip(*map(one, texts), strict=True))) if texts else [[], []]


def identify(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", keep: list[str] | None = None, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """keep's columns, pred and score (1 at no distance, 0 at the largest possible).

    Null texts and texts without a letter get `und` and 0; so does every text where nothing was learned. Ties go to the
    language first in order. Repeated rows are scored one by one; columns not in keep are left out, whatever their names.
    """
    keep = [c for c in docs.columns if c not in (pred, score)] if keep is None else keep
    return map_texts(docs, text, keep, [(pred, T.StringType()), (score, T.DoubleType())], lambda: classifier(profiles))


def held_out(doc_id, folds: int, which: int):
    """If crc32 of the id's text leaves that remainder; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == which


def op8(spark, sf_dir: str) -> DataFrame:
    from lithoflow.llm.common import table

    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.where(~held_out("doc_id", 4, 2)))
    out = identify(docs, profiles, keep=["doc_id"])
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


