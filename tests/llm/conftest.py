import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs():
    """Rows with nulls in any column, empty and long texts, ties and repeated rows."""
    r = random.Random(4)
    words = ["the", "of", "and", "thing", "Ünder", "été", "x1", "+49", "alpha", "beta", "gamma", "naïve", "日本"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, long = text(90), text(40_000)
    rows = [(1, passage + "\n" + text(60)), (2, text(50) + " " + passage), (3, None), (4, ""), (5, " \n\t "), (6, "word"), (7, long), (8, "ab" * 500), (None, text(30)), (10, text(200)), (10, text(120))]
    rows = [(i, t, [None, "en", "de"][k % 3], None if k % 4 == 0 else "src", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    rows += [rows[0], rows[0], (11, rows[9][1], "en", "src", 3)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, edge_docs):
    return spark.createDataFrame(edge_docs, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """docs with more columns, named like results and like columns used inside."""
    from pyspark.sql import functions as F

    names = ["kept", "score", "fp", "component_id", "spans", "ids", "n_words", "h", "k1", "lang_pred", "piece", "length", "row"]
    return docs.select("*", *[F.lit(7).alias(n) for n in names])
