"""CSV tables in and out: wide return and price files, market and characteristic files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .panels import no_nan, require_columns


def wide(spark: SparkSession, path: str, value: str = "r") -> DataFrame:
    """(t, asset, value) of a CSV with dates in its first column and a column per asset.

    What is no date drops the row, what is no number is null; an empty file is an error.
    """
    raw = spark.read.option("header", True).csv(path)
    if len(raw.columns) < 2 or raw.isEmpty():
        raise ValueError(f"{path} has no returns")
    date, *assets = raw.columns
    rows = raw.withColumn("t", F.try_to_timestamp(F.col(date)).cast("date")).where("t is not null").select("t", *assets)
    long = rows.unpivot(["t"], [F.col(f"`{a}`") for a in assets], "asset", value)
    return no_nan(long.withColumn(value, F.expr(f"try_cast({value} AS DOUBLE)")))


def market(spark: SparkSession, path: str) -> DataFrame:
    """(t, r) of a CSV with one value column."""
    rows = wide(spark, path)
    if rows.select("asset").distinct().count() != 1:
        raise ValueError("a market file has one return column")
    return rows.select("t", "r")


def characteristics(spark: SparkSession, path: str) -> DataFrame:
    """(t, asset, market_cap, turnover) of a CSV with date, ticker, market_cap, turnover; rows without keys go."""
    raw = require_columns(spark.read.option("header", True).csv(path), "date", "ticker", "market_cap", "turnover")
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)").alias(c)
    rows = raw.select(F.try_to_timestamp(F.col("date")).cast("date").alias("t"), F.col("ticker").alias("asset"), number("market_cap"), number("turnover"))
    return no_nan(rows.dropna(subset=["t", "asset"]))


def clean_prices(prices: DataFrame, forward: int | None = None, back: bool = False, drop_empty: bool = False) -> DataFrame:
    """Fills gaps of a dense price panel forward (at most `forward` periods), then
    backward, and drops periods in which no asset has a price."""
    by = W.partitionBy("asset").orderBy("t_idx")
    start = W.unboundedPreceding if forward is None else -forward
    out = prices.withColumn("price", F.last("price", ignorenulls=True).over(by.rowsBetween(start, 0)))
    if back:
        out = out.withColumn("price", F.first("price", ignorenulls=True).over(by.rowsBetween(0, W.unboundedFollowing)))
    if drop_empty:
        out = out.join(out.groupBy("t").agg(F.count("price").alias("n")).where("n > 0").select("t"), "t", "left_semi")
    return out


def write_table(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
