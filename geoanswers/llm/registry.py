"""The numbered queries and their SQL, by name."""

from __future__ import annotations

import importlib

MODULES = ["op1_minhash", "op2_warc", "op3_sharding", "op4_embeddings", "op5_packing", "op6_quality", "op7_language", "op8_secrets", "op9_suffix", "op10_mixing", "op11_bpe", "op12_trie", "op13_repair"]


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"geoanswers.llm.{name}"), what)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLES")
