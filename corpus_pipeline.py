"""A corpus pipeline: STAGES in order, each written as Parquet and read again as the next one's documents; run() applies them. See tessella.llm.stages."""

from __future__ import annotations

from tessella.llm.stages import ORACLE_SQL, STAGES, bpe_round_trip, mix_sources, near_duplicates, quality_rules, run, toxic_documents

__all__ = ["ORACLE_SQL", "STAGES", "bpe_round_trip", "mix_sources", "near_duplicates", "quality_rules", "run", "toxic_documents"]
