"""Checkable queries: each Spark query sits next to its SQL twin."""

from __future__ import annotations

from importlib import import_module

SECTIONS = ("wirechecks", "linkchecks", "classes", "functions", "recordchecks", "state", "streams")


def load():
    """Import all sections and return the registry."""
    for name in SECTIONS:
        import_module(f"netobs.checks.{name}")
    return import_module("netobs.checks.registry")
