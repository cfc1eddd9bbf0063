"""Registered queries by theme; each module has QUERIES (name -> callable) and ORACLE (name -> SQL)."""

import importlib

_THEMES = ("core", "kmers", "masking", "clipping", "search", "tables", "perread", "nameforms", "formats")


def modules() -> list:
    return [importlib.import_module(f"readloom.plans.{x}") for x in _THEMES]
