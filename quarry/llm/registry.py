"""The queries of this folder and their SQL."""

from __future__ import annotations

from importlib import import_module

import corpus_pipeline

MODULES = ("winnow", "neardup", "bpe", "simhash", "chat", "packing", "repeats", "ppm", "toxicity", "linededup", "divergence", "lexical", "licenses")


def _all(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"quarry.llm.{m}"), name, {}).items()}


def queries() -> dict:
    return _all("QUERIES") | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES") | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
