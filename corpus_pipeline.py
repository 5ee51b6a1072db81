"""Corpus pipeline: language ID, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. Extra columns of docs go through the stages; columns named like those used here are read as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoflow.llm import langid, packing, pii, simhash, suffixes
from lithoflow.llm.common import saved, table

#: Least score of a text's language; below that, and without letters, a document goes.
MIN_SCORE = 0.2
#: A repeated passage has so many bytes and words at least: 50 words of running text have over 200 bytes in any of the languages.
WINDOW, MIN_WORDS = 200, 50


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with MIN_SCORE at least; profiles come from all rows with a language."""
    profiles = langid.learn_profiles(docs)
    told = langid.identify(docs, profiles, pred="__lang_pred", score="__lang_score")
    return told.where((F.col("__lang_pred") != "und") & (F.col("__lang_score") >= MIN_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, null ids last, then the least hash of id and text.

    Rows are told apart by id and text, so that of rows with one id each is judged by its own text; rows equal in both are one.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumn("__k1", F.xxhash64("doc_id", text)).withColumn("__k2", F.xxhash64(text, "doc_id", F.lit(1)))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__k1", "__k2")
    found = simhash.near_duplicates(keyed.select("text", row.alias("__row")), id_col="__row", keep=["__row"])
    stay = found.where(F.col("__row") == F.col("component_id")).select("__row.__k1", "__row.__k2").distinct()
    return keyed.join(stay, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"]).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of WINDOW bytes and MIN_WORDS words or more that also are elsewhere.

    All places of a passage lose it; characters cut in two go whole. Null texts stay null.
    """
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    marked = docs.withColumn("__null", F.col("text").isNull())
    kept = suffixes.deduplicate(marked, keep=[*others, "__null"], as_text=True, window=WINDOW, min_words=MIN_WORDS)
    text = F.when(~F.col("__null"), F.col("kept"))
    return kept.withColumns({"text": text, "n_chars": F.length(text).cast("long")}).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by names of its kinds."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("suffix_dedup", repeated_passages), ("pii", personal_data), ("packing", packed)]

#: SQL has no XXH64 fingerprint, BPE or EM fit; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
