"""The registered queries of this subpackage with their SQL."""

from __future__ import annotations

from keepset.llm import lengths, lines, packing, quality, ruleset, secrets, shards, simhash, spans, templates

QUERIES = {
    "op1_token_shards": shards.op1_token_shards,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_template_matches": templates.op3_template_matches,
    "op4_simhash_pivots": simhash.op4_simhash_pivots,
    "op5_pack_sequences": packing.op5_pack_sequences,
    "op6_rule_ensemble": ruleset.op6_rule_ensemble,
    "op7_line_edit_join": lines.op7_line_edit_join,
    "op8_length_histogram": lengths.op8_length_histogram,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_substring_dedup": spans.op10_substring_dedup,
}
#: The others need a tokenizer, a model or a hash that SQL lacks; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op7_line_edit_join": lines.ORACLE,
    "op10_substring_dedup": spans.ORACLE,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
