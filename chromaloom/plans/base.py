"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chromaloom.sources.proxies import view, with_views

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """Named queries, each a function of views, with the SQL that says the same."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None, *views: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
        """Registers a function of frames, one for each view (in order), under ``name``."""

        def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            if name in self.queries:
                raise ValueError(f"{name} is registered already")
            self.queries[name] = lambda spark, sf_dir: f(*(view(spark, sf_dir, v) for v in views))
            if sql is not None:
                self.sql[name] = with_views(sql, *views)
            return f

        return put
