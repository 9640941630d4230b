"""Named queries over the driver's tables and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import braces, code, evaluation, evidence, graph, history, lexical, lookups, metrics, relational, reports, sources

MODULES = (relational, lexical, graph, evaluation, history, metrics, lookups, evidence, code, reports, braces, sources)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(spark, sf_dir)
