"""Query registry: key -> (Spark builder, DuckDB oracle SQL or None).

Builders take (spark, sf_dir) and return a DataFrame over the driver tables
(or data Spark derives from them).  Oracle SQL runs on DuckDB with the
driver tables pre-registered as views.  Keys without SQL are checked
rows-only plus their own unit tests.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    key: str
    build: Builder
    sql: str | None


_REGISTRY: dict[str, Entry] = {}


def query(key: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if key in _REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        _REGISTRY[key] = Entry(key, fn, sql.strip() if sql else None)
        return fn
    return deco


def _load() -> None:
    # importing the catalog modules registers their queries
    import importlib
    for mod in _available():
        importlib.import_module(f"pairlane.plans.{mod}")


CATALOG = ["q_core", "q_tfidf", "q_splits", "q_sources", "q_negatives", "q_prompts", "q_dense",
           "q_synth", "q_reports", "q_streaming"]


def _available():
    import importlib.util
    return [m for m in CATALOG if importlib.util.find_spec(f"pairlane.plans.{m}")]


def all_queries() -> dict[str, Builder]:
    _load()
    return {k: e.build for k, e in _REGISTRY.items()}


def all_sql() -> dict[str, str]:
    _load()
    return {k: e.sql for k, e in _REGISTRY.items() if e.sql}
