"""The registered queries of this package, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from sparkquill.llm import cap_filters, compression_quality, dart_minhash, fm_decontaminate, prefix_targets, source_mix, token_planes, toxicity_cnn, unigram_counts, warc_store

QUERIES = {
    "op1_decontaminate": fm_decontaminate.op1_decontaminate,
    "op2_prefix_targets": prefix_targets.op2_prefix_targets,
    "op3_toxicity": toxicity_cnn.op3_toxicity,
    "op4_token_counts": unigram_counts.op4_token_counts,
    "op5_token_planes": token_planes.op5_token_planes,
    "op6_quality": compression_quality.op6_quality,
    "op7_cap_filters": cap_filters.op7_cap_filters,
    "op8_near_duplicates": dart_minhash.op8_near_duplicates,
    "op9_warc": warc_store.op9_warc,
    "op10_source_mix": source_mix.op10_source_mix,
}

ORACLES: dict[str, str] = {
    "op2_prefix_targets": prefix_targets.OP2_SQL,
    "op9_warc": warc_store.OP9_SQL,
}
