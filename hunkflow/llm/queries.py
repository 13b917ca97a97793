"""The operators as queries over the shared tables."""

from __future__ import annotations

from . import conversations, exact_dedup, html_text, license_scan, mixing, near_join, packing, quality_model, quality_rules, resampling, sharding, substring_dedup, token_counts

QUERIES = {
    "op1_shard": sharding.op1_shard,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_quality_model": quality_model.op4_quality_model,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_mixing": mixing.op7_mixing,
    "op8_packing": packing.op8_packing,
    "op9_html_text": html_text.op9_html_text,
    "op10_near_join": near_join.op10_near_join,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_resampling": resampling.op13_resampling,
    "shards_of_64k": sharding.shards_of_64k,
}

ORACLE_SQL = {
    "op1_shard": sharding.OP1_SQL,
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op6_license_scan": license_scan.OP6_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op13_resampling": resampling.OP13_SQL,
    "shards_of_64k": sharding.shards_sql(1 << 16),
}
