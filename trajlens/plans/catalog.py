"""All registered queries with their DuckDB counterparts."""

from __future__ import annotations

import importlib

from trajlens.plans.inputs import Inputs
from trajlens.plans.shape import flat

_MODULES = (
    "catalog_ledger", "catalog_ranking", "catalog_edits", "catalog_runs", "catalog_actions", "catalog_sources",
    "catalog_states", "catalog_learn",
)


def registry() -> dict:
    out: dict = {}
    for name in _MODULES:
        module = importlib.import_module(f"trajlens.plans.{name}")
        clash = set(out) & set(module.QUERIES)
        if clash:
            raise ValueError(f"query names registered twice: {sorted(clash)}")
        out.update(module.QUERIES)
    return out


def queries() -> dict:
    def bind(build):
        return lambda spark, folder: flat(build(Inputs(spark, folder)))

    return {name: bind(build) for name, (build, _sql) in registry().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_build, sql) in registry().items() if sql is not None}
