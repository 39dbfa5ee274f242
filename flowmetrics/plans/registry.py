"""Registry of named queries: each has a Spark plan ``fn(spark, sf_dir)`` and,
where the operator is expressible in SQL, the oracle text DuckDB runs over the
same parquet tables (bindings included as CTEs)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from .tables import Bindings, with_bindings

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, bindings: Sequence[str] = ()):
    """Register ``fn(b: Bindings) -> DataFrame`` under ``name``."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Bindings(spark, sf_dir))
        run.__name__ = f"q_{name}"
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_bindings(bindings, oracle.strip())
        return fn
    return deco


def load_all() -> None:
    from . import q_costs, q_io, q_logs, q_runs  # noqa: F401
