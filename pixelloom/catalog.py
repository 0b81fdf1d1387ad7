"""All registered queries of the engine and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from . import plans, registry


def _load() -> None:
    for m in pkgutil.iter_modules(plans.__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"{plans.__name__}.{m.name}")


def queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)
