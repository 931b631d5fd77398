"""All registered queries, and the flagship one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.plans import cases_docs, cases_filters, cases_sources, cases_state  # noqa: F401
from gleaner.plans import cases_scoring
from gleaner.plans.cases import ORACLES, QUERIES
from gleaner.plans.views import Tables


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return cases_scoring.flagship(Tables(spark, folder))


__all__ = ["ORACLES", "QUERIES", "flagship"]
