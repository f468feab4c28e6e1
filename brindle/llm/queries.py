"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, html, licenses, quality, repair, similarity, substrings, suffixarray, topk, toxicity, trie


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_substrings": substrings.op2_substrings,
        "op3_licenses": licenses.op3_licenses,
        "op4_perspectives": chat.op4_perspectives,
        "op5_pages": html.op5_pages,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_bpe": bpe.op7_bpe,
        "op8_suffixarray": suffixarray.op8_suffixarray,
        "op9_similarity": similarity.op9_similarity,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_trie": trie.op11_trie,
        "op12_topk": topk.op12_topk,
        "op13_repair": repair.op13_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": quality.ORACLE, "op2_substrings": substrings.ORACLE, "op4_perspectives": chat.ORACLE, "op8_suffixarray": suffixarray.ORACLE, "op9_similarity": similarity.ORACLE, "op10_decontaminate": decontaminate.ORACLE, "op11_trie": trie.ORACLE, "op12_topk": topk.ORACLE, "op13_repair": repair.ORACLE}
