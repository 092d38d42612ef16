"""All registered queries and their check SQL."""

from __future__ import annotations

from importlib import import_module

PARTS = ["texts", "vectors", "arrays", "scores", "runs", "learning"]

QUERIES: dict = {}
ORACLE: dict = {}
for part in PARTS:
    QUERIES.update(import_module(f"lexiframe.plans.{part}").QUERIES)
    ORACLE.update(import_module(f"lexiframe.plans.oracle_{part}").ORACLE)
