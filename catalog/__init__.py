"""Registered queries over the given tables, each with its ANSI-SQL counterpart."""

import importlib
import pkgutil


def all_queries():
    """(queries, oracles) of every ``queries_*`` module."""
    from catalog import registry

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module.startswith("queries_"):
            importlib.import_module(f"catalog.{module}")
    return registry.QUERIES, registry.ORACLES
