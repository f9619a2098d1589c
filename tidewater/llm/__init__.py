"""Training-data operators: token counts, chat formatting, toxicity, media,
decontamination, PII, packing, token output, language ID and near-dedup.

Nothing outside this package imports it."""
