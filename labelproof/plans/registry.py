"""Registry of named queries and the SQL text each one is compared with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from labelproof.schemas import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a builder; ``{view}`` markers in ``sql`` become shared CTE text."""

    def register(build):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        text = sql
        if text is not None:
            from labelproof.plans.bindings import SQL_VIEWS

            for key, body in SQL_VIEWS.items():
                text = text.replace("{" + key + "}", body.strip())
        QUERIES[name] = Query(name, build, text)
        return build

    return register
