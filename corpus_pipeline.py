"""The pipeline over `documents`; its body is in tessera.llm.pipeline."""

from tessera.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
