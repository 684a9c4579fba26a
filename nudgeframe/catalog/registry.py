"""Collects the registered queries and their SQL renderings."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from nudgeframe.catalog.inputs import Study, with_views

_AREAS = (
    "feature_queries",
    "quality_queries",
    "metric_queries",
    "decision_queries",
    "trial_queries",
    "model_queries",
)


class Area:
    """A named group of queries; each has Spark code and usually SQL."""

    def __init__(self):
        self.builders: dict[str, Callable[[Study], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, views: str = "", sql: str | None = None):
        def register(builder):
            self.builders[name] = builder
            if sql is not None:
                self.sql[name] = with_views(views, sql) if views else sql.strip()
            return builder

        return register


def _areas() -> list[Area]:
    return [import_module(f"nudgeframe.catalog.{name}").AREA for name in _AREAS]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(builder):
        return lambda spark, sf_dir: builder(Study(spark, sf_dir))

    return {name: bind(builder) for area in _areas() for name, builder in area.builders.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in _areas() for name, sql in area.sql.items()}
