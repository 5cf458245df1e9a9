"""The registered queries of the retail operators, each with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Tables
from . import binding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, fn: Callable[[Tables], DataFrame], sql: str | None = None, rounded: str = "", **views: str) -> None:
    """A query of the bound tables; sql is written over the views of `binding` and those given here.

    rounded: columns whose last digits depend on the order in which an engine adds; both sides round them to nine places.
    """
    columns = rounded.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = fn(binding.tables(spark, sf_dir))
        return out.withColumns({c: F.round(c, 9) for c in columns}) if columns else out

    QUERIES[name] = run
    if sql is not None:
        if columns:
            sql = f"SELECT * REPLACE ({', '.join(f'round({c}, 9) AS {c}' for c in columns)}) FROM ({sql})"
        ORACLE_SQL[name] = binding.sql(sql, **views)


from . import queries_analyses, queries_candidates, queries_data, queries_features, queries_metrics, queries_models, queries_spine  # noqa: E402, F401
