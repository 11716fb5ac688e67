"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import ann, bpe, lines, lm, minhash, mixing, pii, pipeline, quality, substring, warc

_MODULES = {
    "op1_byte_bpe": bpe,
    "op2_substring_dedup": substring,
    "op3_minhash_near_dedup": minhash,
    "op4_line_dedup": lines,
    "op5_source_mixing": mixing,
    "op6_quality_divergence": quality,
    "op7_multiprobe_ann": ann,
    "op8_lm_backoff": lm,
    "op9_warc_index_first": warc,
    "op10_pii_weak_supervision": pii,
}

QUERIES = {name: m.query for name, m in _MODULES.items()} | {"pipeline": pipeline.run}
SQL = {name: m.SQL for name, m in _MODULES.items() if m.SQL}
