"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lithoflow.llm import bpe, chat, langid, packing, pii, quality, simhash, suffixes, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_distribution_divergence": quality.op1,
        "op2_best_fit_packing": packing.op2,
        "op3_bit_sliced_simhash": simhash.op3,
        "op4_string_kernel_toxicity": toxicity.op4,
        "op5_weak_pii": pii.op5,
        "op6_monoid_bpe": bpe.op6,
        "op7_suffix_dedup": suffixes.op7,
        "op8_language_id": langid.op8,
        "op9_chat_format": chat.op9,
        "op10_exact_top_k": topk.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_distribution_divergence": quality.OP1_SQL, "op9_chat_format": chat.OP9_SQL, "op10_exact_top_k": topk.OP10_SQL}
