"""All queries over the driver tables, by name, and equivalent SQL."""

from pyspark.sql import DataFrame, SparkSession

from quantweave.plans import factors, intraday, models, momentum, network, periods, refits, series, studies  # noqa: F401  each registers its queries
from quantweave.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return QUERIES


def oracles() -> dict[str, str]:
    return ORACLES


def entry(spark: SparkSession) -> DataFrame:
    return QUERIES["decompose_cross_section"](spark, "/root/testdata/sf0.001")
