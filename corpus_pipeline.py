"""The corpus pipeline: toxicity, near copies, repeated passages, packing. See ``codeloom.llm.pipeline``."""

from codeloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
