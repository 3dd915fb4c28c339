"""Registered queries over the stand-in inputs."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("contacts", "counts", "scores", "maps", "axis", "features", "neighbours", "sampling", "modelling")


def load_catalog():
    """(queries, oracle SQL) of every catalog module."""
    from contactmill.plans import catalog

    for name in _MODULES:
        import_module(f"contactmill.plans.{name}")
    return catalog.QUERIES, catalog.ORACLES
