"""All registered analyses: key -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rosterlens.plans import ages, growth, hiring, imports, overview, reasons, service
from rosterlens.plans.context import Workforce, workforce

ANALYSES: dict[str, Callable[[Workforce], DataFrame]] = {}
for _module in (overview, growth, ages, reasons, hiring, service, imports):
    ANALYSES.update(_module.QUERIES)


def _bind(build: Callable[[Workforce], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(workforce(spark, sf_dir))

    run.__doc__ = build.__doc__
    return run


def registered_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: _bind(build) for key, build in ANALYSES.items()}
