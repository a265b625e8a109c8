"""Quantile sorts and regime splits of a panel with a signal and a next return."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantweave.functions.series import quantile_bucket, rolling


def long_short(panel: DataFrame, signal: str, future: str = "future", groups: int = 3, sign: int = 1, cost: float = 0.0, legs: int = 2, extra: tuple[str, ...] = ()) -> DataFrame:
    """(t, ls): mean next return of the highest less the lowest bucket of sign * signal.

    A period needs two assets a bucket at least; the cost is taken once a leg."""
    rows = panel.where(F.col(signal).isNotNull() & F.col(future).isNotNull()).withColumn("_s", sign * F.col(signal))
    rows = rows.withColumn("bucket", quantile_bucket("_s", groups, "t", *extra))
    both = rows.groupBy("t", *extra).agg(F.count("*").alias("n"), F.avg(F.when(F.col("bucket") == groups - 1, F.col(future))).alias("high"), F.avg(F.when(F.col("bucket") == 0, F.col(future))).alias("low"))
    both = both.where((F.col("n") >= 2 * groups) & F.col("high").isNotNull() & F.col("low").isNotNull())
    return both.select("t", *extra, (F.col("high") - F.col("low") - legs * cost).alias("ls"))


def with_momentum(panel: DataFrame, value: str, window: int, skip: int = 1, out: str = "momentum") -> DataFrame:
    """Sum of the `window` values that end `skip` periods ago; all must be there."""
    return panel.withColumn(out, rolling(F.sum, value, window, end=-skip))


def split_by_median(panel: DataFrame, value: str, out: str = "regime") -> DataFrame:
    """'low' up to the period's median of `value`, else 'high'."""
    median = panel.groupBy("t").agg(F.percentile(value, 0.5).alias("_m"))
    return panel.join(median, "t").withColumn(out, F.when(F.col(value) <= F.col("_m"), "low").when(F.col(value).isNotNull(), "high")).drop("_m")


def horizon_table(panel: DataFrame, signal: str, values: list[str], horizons: list[tuple[int, int]], groups: int = 3) -> DataFrame:
    """(horizon, bucket, mean_*): later means of each asset by its bucket now, then over assets."""
    rows = panel
    for a, b in horizons:
        for v in values:
            rows = rows.withColumn(f"{v}_{a}_{b}", rolling(F.avg, v, b - a + 1, 1, start=a, end=b))
    rows = rows.where(F.col(signal).isNotNull()).withColumn("bucket", quantile_bucket(signal, groups, "t"))
    one = [F.struct(F.lit(f"{a}-{b}").alias("horizon"), *[F.col(f"{v}_{a}_{b}").alias(v) for v in values]) for a, b in horizons]
    long = rows.select("t", "asset", "bucket", F.explode(F.array(*one)).alias("h")).select("t", "asset", "bucket", "h.*")
    return long.groupBy("horizon", "bucket").agg(*[F.avg(v).alias(f"mean_{v}") for v in values])
