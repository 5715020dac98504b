"""Registered queries; ``load`` enters them all."""

from __future__ import annotations

from importlib import import_module

MODULES = ("tables_queries", "scores_queries", "evaluation_queries", "sources_queries", "hypothesis_queries", "store_queries")


def load() -> None:
    for name in MODULES:
        import_module(f"presslens.plans.{name}")
