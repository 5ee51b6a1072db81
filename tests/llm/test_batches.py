import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoflow.llm import langid, suffixes
from lithoflow.llm.common import BATCH_BYTES, BATCH_SETTING, bounded, map_texts

DEFAULT = str(64 << 20)


@pytest.fixture
def setting(spark):
    spark.conf.set(BATCH_SETTING, DEFAULT)
    yield
    spark.conf.unset(BATCH_SETTING)


def long_texts(spark, n=48):
    """n texts of 1 MB in one partition."""
    return spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit("ab de "), (1 << 20) // 6)).alias("text"), F.lit("en").alias("lang"))


def test_a_worker_holds_few_long_texts(spark, setting):
    def make():
        return lambda texts: [[sys._getframe(1).f_locals["batch"].nbytes] * len(texts)]

    made = map_texts(long_texts(spark), "text", ["doc_id"], [("held", T.LongType())], make)
    held = [r.held for r in made.collect()]
    assert len(held) == 48
    assert 0 < max(held) <= BATCH_BYTES + (2 << 20)


@pytest.mark.parametrize(("before", "after"), [("64m", str(BATCH_BYTES)), (str(BATCH_BYTES + 1), str(BATCH_BYTES)), ("4m", "4m"), ("1048576", "1048576"), ("512k", "512k")])
def test_smaller_limits_stay(spark, setting, before, after):
    spark.conf.set(BATCH_SETTING, before)
    df = spark.range(1)
    assert bounded(df) is df
    assert spark.conf.get(BATCH_SETTING).rstrip("b") == after


def test_profiles_and_passages_bound_their_batches(spark, setting):
    docs = long_texts(spark, 1)
    langid.learn_profiles(docs)
    assert spark.conf.get(BATCH_SETTING) == str(BATCH_BYTES)
    spark.conf.set(BATCH_SETTING, DEFAULT)
    suffixes.deduplicate(docs.limit(0))
    assert spark.conf.get(BATCH_SETTING) == str(BATCH_BYTES)


def test_counts_are_added_up_in_parts(monkeypatch):
    from collections import Counter

    monkeypatch.setattr(langid, "MERGE", 8)
    texts = [f"one {i} Zwei été {'ab' * (i % 7)} {chr(0x4E00 + i % 50)}" for i in range(200)]
    counts, plain, most = langid.Counts(), Counter(), 0
    for t in texts:
        x, n = langid.ngrams(t.encode())
        plain.update(dict(zip(x.tolist(), n.tolist(), strict=True)))
        counts.add(x, n)
        most = max(most, sum(len(p[0]) for p in counts.parts))
    x, n = counts.total()
    assert dict(zip(x.tolist(), n.tolist(), strict=True)) == dict(plain)
    assert (x[1:] > x[:-1]).all()
    assert most <= 2 * len(x) + 100
