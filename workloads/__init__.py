"""Every operator of the library bound to the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Workloads:
    """Named queries; ``sql`` is left out where plain SQL cannot express the result."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return register


def everything() -> Workloads:
    from workloads import evaluation, features, models, rules, sources, streams, summaries

    merged = Workloads()
    for module in (sources, features, rules, summaries, evaluation, models, streams):
        for name, query in module.WORK.queries.items():
            merged.add(name, module.WORK.sql.get(name))(query)
    return merged
