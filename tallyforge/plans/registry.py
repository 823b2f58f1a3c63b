"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import VIEWS_SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, views: bool = True) -> Callable:
    """Register a function of Views; oracle is DuckDB SQL over the views or, without them, the tables."""

    def put(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if oracle is not None:
            text = oracle.strip()
            if views:
                text = VIEWS_SQL + ("," + text[4:] if text[:5].upper() == "WITH " else text)
            ORACLES[name] = text
        return f

    return put
