"""Queries of the training-data operators and their SQL, for registration at the repository's entry point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm.audit import OP11_SQL, op11_filter_audit
from tabulon.llm.chat import OP4_SQL, op4_chat
from tabulon.llm.ensemble import op2_quality
from tabulon.llm.exact import OP1_SQL, op1_exact_dedup
from tabulon.llm.importance import OP13_SQL, op13_importance
from tabulon.llm.mixing import OP12_SQL, op12_mixing
from tabulon.llm.packing import op8_packing
from tabulon.llm.pieces import op5_pieces
from tabulon.llm.rules import op7_quality_rules
from tabulon.llm.sharding import op10_shards
from tabulon.llm.simhash import op6_simhash
from tabulon.llm.substring import op3_substring
from tabulon.llm.toxicity import op9_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_quality": op2_quality,
        "op3_substring": op3_substring,
        "op4_chat": op4_chat,
        "op5_pieces": op5_pieces,
        "op6_simhash": op6_simhash,
        "op7_quality_rules": op7_quality_rules,
        "op8_packing": op8_packing,
        "op9_toxicity": op9_toxicity,
        "op10_shards": op10_shards,
        "op11_filter_audit": op11_filter_audit,
        "op12_mixing": op12_mixing,
        "op13_importance": op13_importance,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL,
        "op4_chat": OP4_SQL,
        "op11_filter_audit": OP11_SQL,
        "op12_mixing": OP12_SQL,
        "op13_importance": OP13_SQL,
    }
