"""All queries of the panel library, gathered from the modules in plans/."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import book, knowledge, lab, panel, records, research, streams

MODULES = (panel, lab, research, book, streams, records, knowledge)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for module in MODULES for f in module.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}


flagship = panel.flagship
