"""Exact top-k by inner product with a three-phase uniform threshold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoflow.llm.common import durable, table

#: Queries and rows that meet in a cell, on average: 8,192 x 64 doubles are 4 MB, 32,768 x 64 are 16 MB.
QUERY_BLOCK, ROW_GROUP = 8192, 32_768
#: Score lists that a vector's components are dealt into.
LISTS = 4
#: Queries and rows whose partial scores are taken at a time.
QUERY_STEP, ROW_STEP = 1024, 4096

_QUERY = ["query_id", "query_key"]
_HITS = T.StructType([T.StructField(n, T.LongType()) for n in (*_QUERY, "vec_id", "score")])
_LOWEST = np.iinfo(np.int64).min


def usable(vectors: DataFrame, vec_id: str, embedding: str, scale: int | None) -> DataFrame:
    """(vec_id, v) of the vectors without null or non-finite components; v holds whole numbers in doubles if scale is given."""
    raw = F.col(f"`{embedding}`").cast("array<double>")
    fine = raw.isNotNull() & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    value = F.transform(raw, lambda x: F.floor(x * F.lit(float(scale))).cast("double")) if scale else raw
    return vectors.where(fine & F.col(f"`{vec_id}`").isNotNull()).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), value.alias("v"))


def _dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while no sum can pass 2**53, else in Python's integers."""
    bound = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if bound < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = lambda a: np.array([[int(y) for y in row] for row in a], object).reshape(a.shape)
    return whole(q) @ whole(x).T


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """Of flat hits, each query's k best: the highest scores, ties to smaller ids; equal hits stay."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    start = np.searchsorted(query, query, "left")
    top = np.arange(len(query)) - start < k
    return query[top], ids[top], scores[top]


def _lists(width: int, lists: int) -> list[np.ndarray]:
    return [c for c in np.array_split(np.arange(width), lists) if len(c)]


def gathered(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, lists: int):
    """Phase 1: (query, row, whole score) of each list's k best rows of each query; only their remaining scores are taken."""
    other = ids[None, :] != q_ids[:, None]
    seen = np.zeros(other.shape, bool)
    for c in _lists(q.shape[1], lists):
        s = _dots(q[:, c], x[:, c])
        n = min(k + 1, len(ids))  # one more, as the query's own row may be among them
        np.put_along_axis(seen, np.argpartition(-s, n - 1, axis=1)[:, :n], True, axis=1)
    a, b = np.nonzero(seen & other)
    return a, b, _pair_dots(q, x, a, b)


def resolved(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, cutoff: np.ndarray, lists: int):
    """Phases 2 and 3: (query, row, whole score) of rows that reach their query's cutoff.

    Phase 2 collects the entries that reach the cutoff's share in a list. What a row has in those lists, and less than the
    share in each of the others, bounds its score; phase 3 takes the remaining scores of rows whose bound reaches the cutoff.
    """
    cuts = _lists(q.shape[1], lists)
    none = cutoff == _LOWEST  # a query with fewer than k hits has no cutoff
    share = np.where(none, 0, cutoff // len(cuts))
    reached, bound = np.zeros((len(q_ids), len(ids)), bool), None
    for c in cuts:
        s = _dots(q[:, c], x[:, c])
        here = (s >= share[:, None]) | none[:, None]
        reached |= here
        part = np.where(here, s, share[:, None])
        bound = part if bound is None else bound + part
    # shares are rounded down, so a list that misses its share adds less than share + 1
    reached &= ((bound + len(cuts) >= cutoff[:, None]) | none[:, None]) & (ids[None, :] != q_ids[:, None])
    a, b = np.nonzero(reached)
    whole = _pair_dots(q, x, a, b)
    fit = whole >= cutoff[a]
    return a[fit], b[fit], whole[fit]


def _pair_dots(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of q[a] and x[b], pair by pair."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) < 2**53:
        out = np.zeros(len(a), np.int64)
        for i in range(0, len(a), 1 << 16):
            out[i : i + (1 << 16)] = np.einsum("ij,ij->i", q[a[i : i + (1 << 16)]], x[b[i : i + (1 << 16)]]).astype(np.int64)
        return out
    return np.array([sum(int(u) * int(v) for u, v in zip(q[i], x[j], strict=True)) for i, j in zip(a, b, strict=True)], np.int64)


def _in_cell(queries, rows, k: int, find) -> tuple:
    """The cell's k best hits of each query: find's hits of each step of queries and rows of one width."""
    import pandas as pd

    widths = rows["v"].map(len).to_numpy()
    out = []
    for width, mine in queries.groupby(queries["v"].map(len).to_numpy(), sort=False):
        fit = rows[widths == width]
        if not width or not len(fit):
            continue
        ids, x = fit["vec_id"].to_numpy(np.int64), np.stack(fit["v"].to_numpy())
        for at in range(0, len(mine), QUERY_STEP):
            some = mine.iloc[at : at + QUERY_STEP]
            q_ids, q = some["query_id"].to_numpy(np.int64), np.stack(some["v"].to_numpy())
            held = (np.zeros(0, np.int64),) * 3
            for a in range(0, len(ids), ROW_STEP):
                i, j, score = find(some, q_ids, q, ids[a : a + ROW_STEP], x[a : a + ROW_STEP])
                held = _best(*(np.concatenate(z) for z in zip(held, (i, ids[a : a + ROW_STEP][j], score), strict=True)), k)
            out.append(pd.DataFrame({"query_id": q_ids[held[0]], "query_key": some["query_key"].to_numpy(np.int64)[held[0]], "vec_id": held[1], "score": held[2]}))
    return pd.concat(out) if out else pd.DataFrame({f.name: np.zeros(0, np.int64) for f in _HITS.fields})


def top_k(vectors: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", is_query=None, scale: int = 1024, query_block: int = QUERY_BLOCK, row_group: int = ROW_GROUP, lists: int = LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k best other rows by integer inner product.

    Queries (default: ids divisible by 100) are dealt into blocks and rows into groups, by their numbers alone; each block
    meets each group in a cell of bounded size, whatever the table's. Each vector's components are dealt into lists; a
    list scores a row by its own components.
    1. Each cell gathers each list's k best rows; the k-th best whole score of those over all cells is a safe cutoff.
    2. The cutoff goes with its query to all cells. A row that reaches it reaches its share (cutoff / lists) in one list
       at least; those entries are collected.
    3. Of collected rows that can still reach the cutoff the remaining scores are taken; those below the cutoff go.

    Rows with the query's own id are not its candidates; other repeated rows are hits each. Query rows with one id and
    different vectors are queries each, and have their k hits each under that id; equal ones are one query. Fewer than k: all.
    Null or non-finite vectors, null ids and vectors of another length than the query's (and empty ones) take no part. Ties go to the
    smaller id. No query: an empty table.
    """
    data = usable(vectors, vec_id, embedding, scale).where(F.size("v") > 0)
    asked = data.where(is_query if is_query is not None else F.col("vec_id") % 100 == 0)
    asked = durable(asked.select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("query_key"), "v").dropDuplicates(_QUERY))
    n_queries, n_rows = asked.count(), data.count()
    if not n_queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks, groups = -(-n_queries // query_block), -(-n_rows // row_group)
    number = F.monotonically_increasing_id()
    rows = data.withColumn("group", F.pmod(number, F.lit(groups))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    block = F.pmod(F.xxhash64(*_QUERY), F.lit(blocks))

    def cells(queries: DataFrame, find) -> DataFrame:
        dealt = queries.withColumn("block", block).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        hits = dealt.groupBy("block", "group").cogroup(rows.groupBy("block", "group")).applyInPandas(lambda q, x: _in_cell(q, x, k, find), _HITS)
        best = Window.partitionBy(*_QUERY).orderBy(F.desc("score"), "vec_id")
        return hits.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)

    first = cells(asked, lambda some, *at: gathered(*at, k, lists))
    cutoffs = durable(first.where(F.col("rank") == k).select(*_QUERY, F.col("score").alias("cutoff")))
    sent = asked.join(cutoffs, _QUERY, "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(int(_LOWEST))))
    best = cells(sent, lambda some, *at: resolved(*at, some["cutoff"].to_numpy(np.int64), lists))
    return best.select("query_id", "rank", "vec_id", "score")


def op10(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0 AND len(e) > 0),
s AS (
  SELECT q.vec_id AS query_id, q.e AS e, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
