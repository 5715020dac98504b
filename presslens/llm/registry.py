"""The queries of this package by name, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from presslens.llm import ann, bpe, chat, line_dedup, mixing, pii, prefix_trie, quality_rules, quality_vote, sentences, sharding, simhash, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": sharding.op1_sharding,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_ann": ann.op3_ann,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_bpe": bpe.op5_bpe,
    "op6_mixing": mixing.op6_mixing,
    "op7_chat": chat.op7_chat,
    "op8_quality_vote": quality_vote.op8_quality_vote,
    "op9_pii": pii.op9_pii,
    "op10_simhash": simhash.op10_simhash,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_sentencepiece": sentences.op12_sentencepiece,
    "op13_variants": variants.op13_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op7_chat": chat.OP7_SQL,
}
