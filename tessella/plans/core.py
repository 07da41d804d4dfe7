"""All queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import problems, reference, reference_sql, sources

QUERIES = {**reference.QUERIES, **sources.QUERIES, **problems.QUERIES}
SQL = {**reference_sql.SQL, **sources.SQL, **problems.SQL}


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """From questions to labels, end to end."""
    return QUERIES["kc_discover"](spark, sf)
