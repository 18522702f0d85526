"""The registered queries of this subpackage and of the pipeline."""

from __future__ import annotations

import importlib

from . import registry

MODULES = ("line_dedup", "decontaminate", "exact_dedup", "jaccard", "token_count", "license_scan", "toxicity", "quality", "sentence_pieces",
           "language_model", "bit_sliced_search", "lexical_search", "periodic_runs")


def queries() -> dict:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")
    import corpus_pipeline
    return registry.QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    queries()
    return dict(registry.SQL)
