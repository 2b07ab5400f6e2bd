"""Queries of this subpackage and of the pipeline, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import (queries_chat, queries_dedup, queries_lines, queries_models, queries_native, queries_pieces, queries_runs,
               queries_search, queries_tokens)

MODULES = (queries_dedup, queries_chat, queries_tokens, queries_models, queries_native, queries_lines,
           queries_runs, queries_pieces, queries_search)


def llm_queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def llm_oracles() -> dict[str, str]:
    out = {k: s for m in MODULES for k, s in m.ORACLE.items()}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
