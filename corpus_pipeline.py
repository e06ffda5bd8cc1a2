"""The corpus pipeline's entry point; its stages are in cytoloom.llm.pipeline."""

from cytoloom.llm.pipeline import ORACLE_SQL, STAGES, line_stage, mixing_stage, near_duplicate_stage, quality_stage, run, token_stage

__all__ = ["ORACLE_SQL", "STAGES", "line_stage", "mixing_stage", "near_duplicate_stage", "quality_stage", "run", "token_stage"]
