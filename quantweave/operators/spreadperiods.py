"""Spreads by trading period: fits on the years before, a warm-up that overlaps them, and rows of the period alone.

A period owns `test` rows of the calendar from train + k test on. It is fitted on the `train` rows before them
and begins its recursions and windows `warm` rows early. A row goes to the periods that own it or warm up with
it, which follows from its place in the calendar; fits come from sums by block of the calendar, which no row
enters twice.
"""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .recursive import _numbers, fold
from .regression import origin_slope

RUN = ("asset", "period")


def with_halo(panel: DataFrame, train: int, test: int, warm: int) -> DataFrame:
    """Rows with `period` and `own`: each for every period from 0 on that owns it or has it in its warm-up."""
    if not 0 <= warm <= train:
        raise ValueError("a warm-up lies within the training rows")
    first = F.greatest(F.ceil((F.col("t_idx") - train - test + 1) / test), F.lit(0)).cast("int")
    last = F.floor((F.col("t_idx") - train + warm) / test).cast("int")
    rows = panel.withColumn("period", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    return rows.withColumn("own", F.col("t_idx") >= train + F.col("period") * test)


def fits(panel: DataFrame, train: int, test: int, y: str = "y", x: str = "x") -> DataFrame:
    """(asset, period, gamma, slope, level): y on x before each period, through the origin and with a level, from
    the whole rows among the `train` before it; a multiple of `test`. Periods without such rows are not there."""
    if train % test:
        raise ValueError("train is a multiple of test: fits are sums of blocks of that length")
    there = panel.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    a, b = F.col(x), F.col(y)
    sums = {"_n": F.count("*").cast("double"), "_x": F.sum(a), "_y": F.sum(b), "_xx": F.sum(a * a), "_xy": F.sum(a * b)}
    blocks = there.groupBy("asset", F.floor(F.col("t_idx") / test).cast("long").alias("_block")).agg(*[v.alias(k) for k, v in sums.items()])
    # each block is in the fits of as many periods as blocks make up a training span
    many = train // test
    spread = blocks.withColumn("period", F.explode(F.sequence(F.greatest(F.col("_block") + 1 - many, F.lit(0)), F.col("_block")))).where(F.col("_block") >= F.col("period"))
    total = spread.groupBy("asset", F.col("period").cast("int").alias("period")).agg(*[F.sum(k).alias(k) for k in sums])
    slope = F.try_divide(F.col("_n") * F.col("_xy") - F.col("_x") * F.col("_y"), F.col("_n") * F.col("_xx") - F.col("_x") * F.col("_x"))
    out = total.withColumns({"gamma": F.try_divide(F.col("_xy"), F.col("_xx")), "slope": slope})
    return out.select("asset", "period", "gamma", "slope", ((F.col("_y") - F.col("slope") * F.col("_x")) / F.col("_n")).alias("level"))


def filtered(y: np.ndarray, x: np.ndarray, start: np.ndarray, drift: float, noise: float) -> np.ndarray:
    """What is left of y after the state (slope, level) updated by the row itself; the state walks at random."""
    state, spread = np.array(start, float), np.eye(2) * drift
    out = np.full(len(y), np.nan)
    for i in range(len(y)):
        seen = np.array([x[i], 1.0])
        spread = spread + np.eye(2) * drift
        gain = spread @ seen
        size = seen @ gain + noise
        state = state + gain / size * (y[i] - seen @ state)
        spread = spread - np.outer(gain, gain) / size
        out[i] = y[i] - seen @ state
    return out


def spreads(panel: DataFrame, train: int, test: int, warm: int, window: int = 60, drift: float = 1e-4, noise: float = 1e-3) -> DataFrame:
    """(asset, period, t_idx, own, kind, spread) by three hedges of y with x: `constant`, the period's gamma;
    `rolling`, the gamma of the `window` whole rows before within the warm-up and the period; `kalman`, a slope
    and a level that start from the period's fit. Rows that lack y or x are left out, and so are periods without
    a fit and rows of `rolling` without a full window."""
    rows = with_halo(panel.where("y is not null and x is not null").select("asset", "t_idx", "y", "x"), train, test, warm).join(fits(panel, train, test), ["asset", "period"])
    run = W.partitionBy(*RUN).orderBy("t_idx")
    frame = run.rowsBetween(-window, -1)
    rows = rows.withColumn("_rolling", F.when(F.count("*").over(frame) == window, origin_slope("y", "x", frame)))

    def kalman(p):
        return {"kalman": filtered(_numbers(p["y"]), _numbers(p["x"]), np.array([p["slope"].iloc[0], p["level"].iloc[0]], float), drift, noise)}

    rows = fold(rows, kalman, {"kalman": "double"}, RUN)
    kinds = {"constant": F.col("y") - F.col("gamma") * F.col("x"), "rolling": F.col("y") - F.col("_rolling") * F.col("x"), "kalman": F.when(~F.isnan("kalman"), F.col("kalman"))}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("spread")) for k, v in kinds.items()])).alias("k")
    return rows.select(*RUN, "t_idx", "own", each).select(*RUN, "t_idx", "own", "k.kind", "k.spread").where("spread is not null")


def z_score(spread: str, look_back: int, keys: tuple[str, ...]) -> Column:
    """Distance from the mean of the last `look_back` rows in their deviations; null with fewer, or without any."""
    frame = W.partitionBy(*keys).orderBy("t_idx").rowsBetween(1 - look_back, 0)
    return F.when(F.count(spread).over(frame) == look_back, F.try_divide(F.col(spread) - F.avg(spread).over(frame), F.stddev_samp(spread).over(frame)))


def with_ou_scores(rows: DataFrame, spread: str, look_backs: list[int], keys: tuple[str, ...], prefix: str = "s_") -> DataFrame:
    """s_<look_back>: distance from the mean that the changes of the rows before revert to, in equilibrium
    deviations sqrt(residual variance / -2b); null unless -2 < b < 0."""
    run = W.partitionBy(*keys).orderBy("t_idx")
    rows = rows.withColumns({"_d": F.col(spread) - F.lag(spread).over(run), "_l": F.lag(spread).over(run)})
    for n in look_backs:
        f = run.rowsBetween(-n, -1)
        pairs = F.when(F.col("_d").isNotNull() & F.col("_l").isNotNull(), 1)
        rows = rows.withColumns({"_n": F.count(pairs).over(f), "_b": F.regr_slope("_d", "_l").over(f), "_a": F.regr_intercept("_d", "_l").over(f), "_xx": F.regr_sxx("_d", "_l").over(f), "_yy": F.regr_syy("_d", "_l").over(f), "_xy": F.regr_sxy("_d", "_l").over(f)})
        rows = rows.withColumn("_v", (F.col("_yy") - F.col("_b") * F.col("_xy")) / (n - 2))
        good = (F.col("_n") == n) & (F.col("_xx") * n >= 1e-10) & (F.col("_b") < 0) & (F.col("_b") > -2) & (F.col("_v") > 0)
        rows = rows.withColumn(f"{prefix}{n}", F.when(good, (F.col(spread) + F.col("_a") / F.col("_b")) / F.sqrt(F.col("_v") / (-2 * F.col("_b")))))
    return rows.drop("_d", "_l", "_n", "_b", "_a", "_xx", "_yy", "_xy", "_v")


def scored(rows: DataFrame, look_backs: list[int]) -> DataFrame:
    """`spreads`' rows with z_<look_back> and s_<look_back>, and `gain`: what position 1 earns after the row
    within its period's own rows."""
    keys = ("asset", "kind", "period")
    own = W.partitionBy(*keys, "own").orderBy("t_idx")
    rows = rows.withColumns({f"z_{n}": z_score("spread", n, keys) for n in look_backs} | {"gain": F.when(F.col("own"), F.lead("spread").over(own) - F.col("spread"))})
    return with_ou_scores(rows, "spread", look_backs, keys)
