"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridtally.llm import chat, decontamination, licenses, linededup, merkle, mixing, nearduplicates, neighbours, prefixtrie, suffixdedup, topk, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_warc": warc.op2_warc,
        "op3_neighbours": neighbours.op3_neighbours,
        "op4_chat": chat.op4_chat,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_licenses": licenses.op6_licenses,
        "op7_suffixes": suffixdedup.op7_suffixes,
        "op8_minhash": nearduplicates.op8_minhash,
        "op9_decontamination": decontamination.op9_decontamination,
        "op10_lines": linededup.op10_lines,
        "op11_manifest": merkle.op11_manifest,
        "op12_topk": topk.op12_topk,
        "op13_trie": prefixtrie.op13_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.OP1_SQL,
        "op2_warc": warc.OP2_SQL,
        "op3_neighbours": neighbours.OP3_SQL,
        "op4_chat": chat.OP4_SQL,
        "op8_minhash": nearduplicates.OP8_SQL,
        "op9_decontamination": decontamination.OP9_SQL,
        "op10_lines": linededup.OP10_SQL,
        "op11_manifest": merkle.OP11_SQL,
        "op12_topk": topk.OP12_SQL,
        "op13_trie": prefixtrie.OP13_SQL,
    }
