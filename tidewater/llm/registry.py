"""The queries of this package, and DuckDB SQL where it can express them."""

from __future__ import annotations

from . import (
    op1_token_counts,
    op2_chat_format,
    op3_toxicity,
    op4_ogg_media,
    op5_decontamination,
    op6_pii_surrogates,
    op7_packing,
    op8_huffman_output,
    op9_language_id,
    op10_near_dedup,
    pipeline,
)

QUERIES = {
    "op1_token_counts": op1_token_counts.query,
    "op2_chat_format": op2_chat_format.query,
    "op3_toxicity": op3_toxicity.query,
    "op4_ogg_media": op4_ogg_media.query,
    "op5_decontamination": op5_decontamination.query,
    "op6_pii_surrogates": op6_pii_surrogates.query,
    "op7_packing": op7_packing.query,
    "op8_huffman_output": op8_huffman_output.query,
    "op9_language_id": op9_language_id.query,
    "op10_near_dedup": op10_near_dedup.query,
    "pipeline": pipeline.run,
}
ORACLES = {
    "op2_chat_format": op2_chat_format.SQL,
    "op5_decontamination": op5_decontamination.SQL,
}
