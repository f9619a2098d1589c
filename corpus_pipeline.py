"""The corpus pipeline; its stages are in tidewater.llm.pipeline."""

from tidewater.llm.pipeline import ORACLE_SQL, STAGES, decontamination, language, near_duplicates, packing, pii, run

__all__ = ["ORACLE_SQL", "STAGES", "decontamination", "language", "near_duplicates", "packing", "pii", "run"]
