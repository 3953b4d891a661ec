"""The corpus pipeline of five stages; it lives in ``lexiprobe.llm.pipeline``."""

from __future__ import annotations

from lexiprobe.llm.pipeline import ORACLE_SQL, STAGES, drop_copies, drop_near_copies, drop_toxic, mix_sources, pack_sequences, run

__all__ = ["ORACLE_SQL", "STAGES", "drop_copies", "drop_near_copies", "drop_toxic", "mix_sources", "pack_sequences", "run"]
