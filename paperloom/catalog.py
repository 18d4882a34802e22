"""All queries over the reference tables, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.queries import analysis, entities, pages, text

_MODULES = (text, entities, analysis, pages)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity roles of rendered documents by document type."""
    return entities.roles_by_type(spark, sf_dir)
