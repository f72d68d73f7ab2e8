"""The registered queries of this folder and their SQL. Imports aren't guarded here."""

from __future__ import annotations

import importlib

import corpus_pipeline

#: Query -> module with the function of that name (and its SQL, where SQL can express it).
MODULES = {
    "op1_bpe": "bpe",
    "op2_mixing": "mixing",
    "op3_covertree": "covertree",
    "op4_langid": "langid",
    "op5_toxicity": "toxicity",
    "op6_media": "mpegts",
    "op7_minhash": "minhash",
    "op8_licenses": "licenses",
    "op9_packing": "packing",
    "op10_pii": "pii",
}


def queries() -> dict:
    out = {name: getattr(importlib.import_module(f"globmill.llm.{module}"), name) for name, module in MODULES.items()}
    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    own = {name: getattr(importlib.import_module(f"globmill.llm.{module}"), "SQL", None) for name, module in MODULES.items()}
    own["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {name: sql for name, sql in own.items() if sql}
