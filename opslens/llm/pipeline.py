"""Everything this part of the library registers: the operators' queries and the corpus pipeline."""
from __future__ import annotations

import corpus_pipeline

from . import queries  # noqa: F401
from .registry import QUERIES

QUERIES.add("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
LLM_QUERIES = QUERIES
