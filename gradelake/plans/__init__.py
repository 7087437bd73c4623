"""Registered queries over the driver tables, one module per operator family."""

import importlib

from gradelake.plans.registry import ORACLES, QUERIES

MODULES = ["evaluation", "advantages", "token_folds", "policy", "texts", "monitoring", "batches", "symbolic"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"gradelake.plans.{name}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLES)
