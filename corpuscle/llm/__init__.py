"""Operators for preparing language-model training data; nothing outside this subpackage imports it."""
from __future__ import annotations

from . import boilerplate, consensus, encoding, packing, quota, residue, sentences, spans, transcripts

MODULES = (boilerplate, consensus, sentences, residue, transcripts, quota, encoding, packing, spans)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "ORACLES", {}).items()}
