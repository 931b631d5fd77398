"""Registry of the named queries: a Spark function and, where SQL can say it, an independent SQL
text for another engine. Dates leave as text and floats rounded, so results compare by value."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.plans.views import Tables, oracle_views
from gleaner.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def case(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = oracle_views(sql)
        return fn

    return register


def fresh_folder(t: Tables, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(t.spark), f"{name}-{uuid.uuid4().hex}")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def first_in(haystack: str, values) -> str:
    """SQL: first listed value contained in the haystack, null if none."""
    return f"list_filter({sql_list(values)}, lambda v: contains({haystack}, v))[1]"


def has_any(haystack: str, values) -> str:
    return f"len(list_filter({sql_list(values)}, lambda v: contains({haystack}, v))) > 0"


__all__ = ["ORACLES", "QUERIES", "Tables", "case", "first_in", "fresh_folder", "has_any", "r6", "sql_list", "sql_text", "text"]
