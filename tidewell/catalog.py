"""All registered queries. Importing the plan modules registers them."""

from __future__ import annotations

import importlib
import pkgutil

from tidewell import plans
from tidewell.plans.registry import QUERIES, SQL, Query


def _load() -> None:
    for module in pkgutil.iter_modules(plans.__path__):
        if module.name.endswith("_plans"):
            importlib.import_module(f"{plans.__name__}.{module.name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
