"""Corpus pipeline: language, near duplicates, repeated passages, mixing, encoding. The stages are in ``brindle.llm.stages``."""

from __future__ import annotations

from brindle.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
