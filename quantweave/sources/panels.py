"""Panels: long tables of one row per asset and period, with a row for every cell.

A missing cell is a row of nulls, so that a row frame over `t_idx` counts
periods, not rows that happen to be present.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def no_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities of floating columns become null."""
    real = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)) for c in real}) if real else df


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def calendar(df: DataFrame, t: str = "t") -> DataFrame:
    """(t, t_idx): the distinct periods counted from 0; one short row a period."""
    return df.select(t).distinct().withColumn("t_idx", (F.row_number().over(W.orderBy(t)) - 1).cast("long"))


def densify(cells: DataFrame, t: str = "t", asset: str = "asset") -> DataFrame:
    """A row for every period and asset that occur, nulls where the cell is missing."""
    # both sides are dimensions: periods and assets, not cells
    grid = calendar(cells, t).crossJoin(cells.select(asset).distinct())
    return grid.join(cells, [t, asset], "left")


def _sales(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    items, parts = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    rows = items.join(parts, items.l_partkey == parts.p_partkey)
    quantity = F.col("l_quantity")
    signed = F.when(F.col("l_returnflag") == "A", quantity).when(F.col("l_returnflag") == "R", -quantity).otherwise(0.0)
    return rows.groupBy(F.col("p_brand").alias("asset"), F.date_trunc(unit, "l_shipdate").cast("date").alias("t")).agg(
        (F.sum("l_extendedprice") / F.sum(quantity)).alias("price"), (F.sum(signed) / F.sum(quantity)).alias("flow"), F.sum("l_extendedprice").alias("cap"), F.sum(quantity).alias("vol")
    )


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, t_idx, asset (brand), price, flow, cap, vol by week."""
    return densify(_sales(spark, sf_dir, "week"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(_sales(spark, sf_dir, "month").select("asset", "t", "price"))


def weekly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`weekly` with r, the log return, and q, the change of flow."""
    by = W.partitionBy("asset").orderBy("t_idx")
    last = F.lag("price").over(by)
    r = F.when((F.col("price") > 0) & (last > 0), F.log(F.col("price") / last))
    return weekly(spark, sf_dir).withColumns({"r": r, "q": F.col("flow") - F.lag("flow").over(by)})


def monthly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`monthly` with r, the simple return."""
    last = F.lag("price").over(W.partitionBy("asset").orderBy("t_idx"))
    return monthly(spark, sf_dir).withColumn("r", F.when(last > 0, F.col("price") / last - 1))


def bars(ticks: DataFrame, seconds: int, ticker: str = "event_type", ts: str = "ts", value: str = "value", tie: str = "event_id") -> DataFrame:
    """ticker, ts_bar, open, high, low, close, volume of bars that begin at multiples of `seconds`."""
    start = F.timestamp_seconds(F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000)) * seconds)
    order = F.struct(ts, tie)
    return ticks.groupBy(F.col(ticker).alias("ticker"), start.cast("timestamp_ntz").alias("ts_bar")).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count("*").cast("double").alias("volume")
    )


def long_history(panel: DataFrame, least: int, forward: int = 5, value: str = "price") -> DataFrame:
    """Gaps filled forward by `forward` periods at most; assets with `least` values, periods in which any of these has one."""
    own = W.partitionBy("asset").orderBy("t_idx")
    rows = panel.withColumn(value, F.last(value, ignorenulls=True).over(own.rowsBetween(-forward, 0)))
    rows = rows.withColumn("_n", F.count(value).over(W.partitionBy("asset"))).where(F.col("_n") >= least)
    return rows.withColumn("_t", F.count(value).over(W.partitionBy("t_idx"))).where("_t > 0").drop("_n", "_t")


def complete_dates(panel: DataFrame, missing: float = 0.05, value: str = "price") -> DataFrame:
    """Assets with at most that share missing, filled forward without limit; periods in which all of them have a value."""
    own = W.partitionBy("asset")
    rows = panel.withColumns({"_m": F.avg(F.col(value).isNull().cast("double")).over(own)}).where(F.col("_m") <= missing)
    rows = rows.withColumn(value, F.last(value, ignorenulls=True).over(own.orderBy("t_idx").rowsBetween(W.unboundedPreceding, 0)))
    at = W.partitionBy("t_idx")
    return rows.withColumns({"_n": F.count(value).over(at), "_a": F.count("*").over(at)}).where("_n = _a").drop("_m", "_n", "_a")


def complete_assets(panel: DataFrame, first: int, last: int, value: str = "r") -> DataFrame:
    """The rows of t_idx `first` to `last` of assets that have a value in every one of these periods."""
    span = panel.where(F.col("t_idx").between(first, last))
    return span.withColumn("_n", F.count(value).over(W.partitionBy("asset"))).where(F.col("_n") == last - first + 1).drop("_n")
