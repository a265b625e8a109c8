"""Hedged spreads of y on x, the positions that trade them and their profits."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quantweave.functions.series import by

from . import statemaps
from .recursive import _numbers, fold, threshold_state
from .regression import origin_slope


def constant_spread(panel: DataFrame, train_end: int | None = None) -> DataFrame:
    """spread = y - gamma x with one slope through the origin for each asset, from the periods up to `train_end`."""
    rows = panel.where("y is not null and x is not null")
    fit = rows if train_end is None else rows.where(F.col("t_idx") <= train_end)
    gamma = fit.groupBy("asset").agg(F.try_divide(F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x"))).alias("gamma"))
    return rows.join(gamma, "asset").withColumn("spread", F.col("y") - F.col("gamma") * F.col("x"))


def rolling_spread(panel: DataFrame, window: int = 60) -> DataFrame:
    """The slope comes from the `window` periods before, all of which must be there."""
    frame = by().rowsBetween(-window, -1)
    both = F.when(F.col("y").isNotNull() & F.col("x").isNotNull(), 1)
    rows = panel.withColumn("_x", F.when(F.col("y").isNotNull(), F.col("x")))
    rows = rows.withColumn("gamma", F.when(F.count(both).over(frame) == window, origin_slope("y", "_x", frame))).drop("_x")
    return rows.where("y is not null and gamma is not null").withColumn("spread", F.col("y") - F.col("gamma") * F.col("x"))


def trade(panel: DataFrame, spread: str, score: str, enter: float, leave: float, lag: int = 0, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """position by the two-threshold rule and pnl, the position 1 + lag periods ago times the spread's change."""
    rows = fold(panel, lambda p: {"position": threshold_state(_numbers(p[score]), enter, leave)}, {"position": "long"}, keys)
    run = W.partitionBy(*keys).orderBy("t_idx")
    return rows.withColumn("pnl", F.coalesce(F.lag("position", 1 + lag).over(run) * (F.col(spread) - F.lag(spread).over(run)), F.lit(0.0)))


def grid(panel: DataFrame, spread: str, score: str, enters: list[float], leaves: list[float], periods: float = 252) -> DataFrame:
    """One row a pair of thresholds with leave < enter: sharpe, on_share, trades, n over all assets. All pairs
    share one pass over the panel."""
    pairs = [(float(e), float(x)) for e in enters for x in leaves if x < e]
    gain = F.lead(spread).over(by()) - F.col(spread)
    rows = panel.select("asset", "t_idx", F.lit(0).alias("_run"), F.lit(True).alias("_own"), gain.alias("_g"), F.col(score).alias("score"))
    each = statemaps.sweep(rows, {"score": pairs}, ["asset"], "_run", "_own", "_g")
    sums = each.groupBy("enter", "leave").agg(*[F.sum(c).alias(c) for c in ("n", "total", "square", "on", "moved")])
    mean = F.col("total") / F.col("n")
    std = F.sqrt(F.greatest((F.col("square") - F.col("total") * mean) / (F.col("n") - 1), F.lit(0.0)))
    return sums.select("enter", "leave", "n", F.when(std > 0, mean / std * periods**0.5).otherwise(0.0).alias("sharpe"), (F.col("on") / F.col("n")).alias("on_share"), F.col("moved").alias("trades"))
