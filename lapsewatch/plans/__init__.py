"""Registered queries, by area."""

from __future__ import annotations

import importlib

AREAS = ["intake", "explore", "evaluate", "monitor", "serve", "train"]


def load_all() -> None:
    """Import every area, which registers its queries."""
    for area in AREAS:
        importlib.import_module(f"lapsewatch.plans.{area}")
