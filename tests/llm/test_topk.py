import math
import random

from lithoflow.llm import topk as K

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    fine = [(i, tuple(math.floor(1024 * x) for x in e)) for i, e, _ in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, e in set(fine):
        if i % 100:
            continue
        hits = sorted((-sum(a * b for a, b in zip(e, f)), j) for j, f in fine if j != i and len(f) == len(e))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(hits)]
    return sorted(out)


def found(frame, **kw):
    return sorted(tuple(r) for r in K.top_k(frame, **kw).collect())


def vectors(n, seed, width=7, coarse=False):
    r = random.Random(seed)
    value = (lambda: r.choice([-0.5, 0.0, 0.25])) if coarse else (lambda: r.uniform(-1, 1))
    return [(i, [float(value()) for _ in range(width)], 0) for i in range(n)]


def test_against_brute_force(spark):
    for seed, coarse in ((1, False), (2, True)):  # coarse: many ties
        rows = vectors(450, seed, coarse=coarse)
        frame = spark.createDataFrame(rows, SCHEMA)
        import numpy as np

        exact = [(i, np.array(e, np.float32).astype(float).tolist(), y) for i, e, y in rows]
        assert found(frame) == brute(exact, 10)
        assert found(frame, query_block=2, row_group=100, lists=3) == brute(exact, 10)


def test_nulls_lengths_and_few_rows(spark):
    rows = [(0, [1.0, 2.0], 0), (1, [1.0, None], 0), (2, None, 0), (3, [float("nan"), 1.0], 0), (4, [float("inf"), 1.0], 0), (5, [0.5, 0.5], 0), (None, [1.0, 1.0], 0), (6, [1.0], 0), (7, [-1.0, -1.0], 0), (100, [1.0, 2.0], 0)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows, 10)


def test_repeated_rows_are_hits_each(spark):
    got = found(spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0), (1, [2.0], 0), (2, [1.0], 0)], SCHEMA))
    assert got == [(0, 1, 1, 2 << 20), (0, 2, 1, 2 << 20), (0, 3, 2, 1 << 20)]


def test_rows_of_one_id_are_queries_each(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [0.0, 1.0], 0), (0, [0.0, 1.0], 0), (1, [3.0, 1.0], 0), (2, [1.0, 3.0], 0), (3, [], 0)]
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows, 10) and len(got) == 4 and sorted(r[2] for r in got if r[1] == 1) == [1, 2]
    # and as the SQL answers
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INT)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    assert sorted(con.execute(K.OP10_SQL).fetchall()) == got


def test_phases():
    """The cutoff is safe, and what it lets through holds every hit, of whatever sign."""
    import numpy as np

    r = np.random.default_rng(3)
    for shift in (-900, 0, 900):
        q, x = r.integers(-1000, 1000, (5, 9)).astype(float), (r.integers(-1000, 1000, (200, 9)) + shift).astype(float)
        q_ids, ids = np.arange(5), np.arange(200)
        whole = (q @ x.T).astype(np.int64)
        whole[np.arange(5), np.arange(5)] = np.iinfo(np.int64).min
        a, _, score = K.gathered(q_ids, q, ids, x, 10, 4)
        cutoff = np.array([np.sort(score[a == i])[-10] for i in range(5)])
        tenth = np.sort(whole, axis=1)[:, -10]
        assert (cutoff <= tenth).all()
        a, b, score = K.resolved(q_ids, q, ids, x, cutoff, 4)
        assert set(zip(a.tolist(), b.tolist(), score.tolist())) == {(i, j, int(whole[i, j])) for i in range(5) for j in range(200) if whole[i, j] >= cutoff[i]}


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**20, 3.0], 0), (1, [2.0**20, 5.0], 0), (2, [2.0**20, 4.0], 0)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows, 10)


def test_empty(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(1, [1.0], 0)], SCHEMA)) == []
