"""Imports every query module so that the registry is complete."""

from __future__ import annotations

import importlib

from dossier.plans.registry import ORACLES, QUERIES

MODULES = (
    "sources", "parsing", "chunking", "tree", "ingest", "features",
    "understanding", "retrieval", "evidence", "answers", "evaluation", "streams",
)
for _name in MODULES:
    importlib.import_module(f"dossier.plans.{_name}_queries")

__all__ = ["QUERIES", "ORACLES"]
