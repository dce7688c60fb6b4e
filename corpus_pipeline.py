"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet
before the next one reads it.
"""

from __future__ import annotations

from examloom.llm.pipeline import STAGES, run

#: No stage can be told in SQL as a whole (labels decide thresholds, alignments decide copies): tests hold each to brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
