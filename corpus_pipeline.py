"""From raw documents to packed sequences: quality rules, line dedup, near-dedup, substring dedup, packing. The stages are in leafmark.llm.pipeline."""

from leafmark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
