"""Shared builders for registered queries."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from pairlane.sources import fixtures
from pairlane.sources.fixtures import PAIRS_SQL


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.pairs(spark, sf_dir)


def with_pairs(body: str, *extra_ctes: str) -> str:
    """``WITH pairs AS (...), <extra>, ... <body>``"""
    ctes = [PAIRS_SQL.strip()] + [c.strip() for c in extra_ctes if c]
    return "WITH " + ",\n".join(ctes) + "\n" + body
