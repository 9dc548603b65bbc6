"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, bpe, embedding, exact_dedup, html, langid, mixing, quality, runs, simhash, substring, suffix, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_html": html.op2_html,
        "op3_embedding": embedding.op3_embedding,
        "op4_suffix": suffix.op4_suffix,
        "op5_langid": langid.op5_langid,
        "op6_simhash": simhash.op6_simhash,
        "op7_mixing": mixing.op7_mixing,
        "op8_substring": substring.op8_substring,
        "op9_quality": quality.op9_quality,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_toxicity": toxicity.op11_toxicity,
        "op12_audit": audit.op12_audit,
        "op13_runs": runs.op13_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_embedding": embedding.ORACLE_SQL,
        "op4_suffix": suffix.ORACLE_SQL,
        "op7_mixing": mixing.ORACLE_SQL,
        "op8_substring": substring.ORACLE_SQL,
        "op10_exact_dedup": exact_dedup.ORACLE_SQL,
        "op12_audit": audit.ORACLE_SQL,
    }
