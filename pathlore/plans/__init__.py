"""Ready-made queries over the standard tables, each with SQL that states its meaning."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("log", "matrix", "score", "stats", "drift", "process", "spectral", "graph", "similarity", "predict", "source", "stream")


def load() -> None:
    for family in FAMILIES:
        import_module(f"pathlore.plans.{family}_queries")
