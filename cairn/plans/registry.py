"""All registered queries of the package, by name, with the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.plans.fixtures import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("tiling", "filters", "pointcloud", "joins", "catalog", "raster", "mesh", "poi", "events", "files", "more")
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


class Tables:
    """A query's inputs: derived views and tables as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name) if name.startswith("v_") else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(oracle: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Decorator: register a function of Tables under its own name, with its oracle where SQL can express one."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = f.__name__
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            _ORACLES[name] = with_views(oracle)
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"cairn.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
