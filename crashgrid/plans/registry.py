"""Registered queries: a Spark plan over the driver's tables and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crashgrid.sources import fixtures
from crashgrid.streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

Load = Callable[[str], DataFrame]


def loader(spark: SparkSession, sf_dir: str) -> Load:
    """Loads a derived input or, for any other name, a driver table."""

    def load(name: str) -> DataFrame:
        if name in fixtures.SQL:
            return fixtures.load(spark, sf_dir, name)
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    return load


def query(name: str, inputs: str = "", ctes: tuple[str, ...] = (), sql: str | None = None):
    """Register ``fn(load)`` under a name.

    ``inputs`` are the derived inputs the SQL refers to, ``ctes`` further common
    table expressions and ``sql`` the final select.
    """

    def wrap(fn: Callable[[Load], DataFrame]) -> Callable[[Load], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(loader(spark, sf_dir))
        _add_oracle(name, inputs, ctes, sql)
        return fn

    return wrap


def stream_query(name: str, inputs: str = "", ctes: tuple[str, ...] = (), sql: str | None = None):
    """Register ``fn(spark, stream, load)``; ``stream`` reads a derived input as a stream."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def stream(name: str) -> DataFrame:
                (table,) = fixtures.tables_of(name)
                # A glob, because a stream takes a folder or a glob but not a single file.
                source = events.read_events(spark, f"{sf_dir}/{table}.parque[t]")
                return spark.sql(fixtures.SQL[name], **{table: source})

            return fn(spark, stream, loader(spark, sf_dir))

        QUERIES[name] = run
        _add_oracle(name, inputs, ctes, sql)
        return fn

    return wrap


def _add_oracle(name: str, inputs: str, ctes: tuple[str, ...], sql: str | None) -> None:
    if sql is not None:
        parts = [fixtures.cte(i) for i in inputs.split()] + [c.strip() for c in ctes]
        head = "with recursive " + ",\n".join(parts) + "\n" if parts else ""
        ORACLES[name] = head + sql.strip()
