"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe, embedding_dedup, html_text, langid, licenses, near_dedup, packing, sharding, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": html_text.op1_html_text,
        "op2_sharding": sharding.op2_sharding,
        "op3_packing": packing.op3_packing,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_near_dedup": near_dedup.op5_near_dedup,
        "op6_topk": topk.op6_topk,
        "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
        "op8_byte_bpe": bpe.op8_byte_bpe,
        "op9_licenses": licenses.op9_licenses,
        "op10_langid": langid.op10_langid,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_near_dedup": near_dedup.OP5_SQL, "op7_embedding_dedup": embedding_dedup.OP7_SQL, "op6_topk": topk.OP6_SQL, "op9_licenses": licenses.OP9_SQL}
