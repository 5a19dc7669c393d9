"""Named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Fixtures, with_views


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None):
        """Register a function of Fixtures under its name; ``sql`` may name fixture views."""

        def register(function: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
            self.queries[function.__name__] = lambda spark, sf_dir: function(Fixtures(spark, sf_dir))
            if sql is not None:
                self.oracles[function.__name__] = with_views(sql)
            return function

        return register
