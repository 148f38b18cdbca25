"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Query: its module. A module has query(spark, sf_dir) and, where SQL can express it, SQL.
MODULES = {
    "op1_quality_rules": "quality_rules",
    "op2_quality_model": "quality_model",
    "op3_html_text": "html_text",
    "op4_mixing": "mixing",
    "op5_personal_data": "personal_data",
    "op6_bagminhash": "near_duplicates",
    "op7_exact_topk": "topk",
    "op8_byte_bpe": "byte_bpe",
    "op9_language_id": "language_id",
    "op10_kd_shards": "sharding",
    "op11_whitening": "whitening",
    "op12_vector_duplicates": "vector_duplicates",
    "op13_prefix_trie": "prefix_trie",
}


def queries() -> dict:
    return {name: import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    modules = {name: import_module(f"{__package__}.{module}") for name, module in MODULES.items()}
    return {name: m.SQL for name, m in modules.items() if hasattr(m, "SQL")}
