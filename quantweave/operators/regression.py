"""Cross-sectional, rolling and pooled regressions, and inference over time."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quantweave.functions.series import by


def _pair(y: str, x: str) -> Column:
    return F.col(y).isNotNull() & F.col(x).isNotNull()


def decompose_cross_section(panel: DataFrame, y: str = "r", x: str = "q", least: int = 5) -> DataFrame:
    """By period, y on x: slope, the part b x and the rest y - b x (the intercept stays in the rest)."""
    rows = panel.where(_pair(y, x))
    at = W.partitionBy("t")
    rows = rows.withColumns({"n": F.count("*").over(at), "slope": F.regr_slope(y, x).over(at)}).where(F.col("n") >= least)
    return rows.withColumn("fitted", F.col("slope") * F.col(x)).withColumn("residual", F.col(y) - F.col("fitted"))


def decompose_rolling(panel: DataFrame, y: str = "r", x: str = "q", window: int = 52, least: int = 26) -> DataFrame:
    """The same by asset over the last `window` periods."""
    frame = by().rowsBetween(-(window - 1), 0)
    both = F.when(_pair(y, x), 1)
    slope = F.when(F.count(both).over(frame) >= least, F.regr_slope(y, x).over(frame))
    rows = panel.withColumn("slope", slope).where(_pair(y, x) & F.col("slope").isNotNull())
    return rows.withColumn("fitted", F.col("slope") * F.col(x)).withColumn("residual", F.col(y) - F.col("fitted"))


def pooled_slopes(panel: DataFrame, effects: str = "none", y: str = "r", x: str = "q", window: int = 52, least: int = 100) -> DataFrame:
    """(t, t_idx, slope, n): the slope of all cells of the last `window` periods.

    Moments are summed by period (and asset) first, so no cell is repeated per
    window. effects: none (one intercept), time or asset (one for each)."""
    rows = panel.where(_pair(y, x))
    keys = ["t", "t_idx", "asset"] if effects == "asset" else ["t", "t_idx"]
    sums = {"n": F.lit(1), "x": F.col(x), "y": F.col(y), "xx": F.col(x) * F.col(x), "xy": F.col(x) * F.col(y)}
    each = rows.groupBy(*keys).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    periods = panel.select("t", "t_idx").distinct()
    if effects == "time":
        # deviations from the period's means need no window of their own
        each = each.select("t", "t_idx", "n", (F.col("xy") - F.col("x") * F.col("y") / F.col("n")).alias("xy"), (F.col("xx") - F.col("x") * F.col("x") / F.col("n")).alias("xx"))
        over = W.orderBy("t_idx").rowsBetween(-(window - 1), 0)
        grid = periods.join(each, ["t", "t_idx"], "left")
        total = grid.select("t", "t_idx", *[F.sum(c).over(over).alias(c) for c in ("n", "xy", "xx")])
    elif effects == "asset":
        over = W.partitionBy("asset").orderBy("t_idx").rowsBetween(-(window - 1), 0)
        grid = periods.crossJoin(rows.select("asset").distinct()).join(each, ["t", "t_idx", "asset"], "left")
        own = grid.select("t", "t_idx", *[F.sum(c).over(over).alias(c) for c in sums]).where("n > 0")
        total = own.groupBy("t", "t_idx").agg(F.sum("n").alias("n"), F.sum(F.col("xy") - F.col("x") * F.col("y") / F.col("n")).alias("xy"), F.sum(F.col("xx") - F.col("x") * F.col("x") / F.col("n")).alias("xx"))
    else:
        over = W.orderBy("t_idx").rowsBetween(-(window - 1), 0)
        grid = periods.join(each, ["t", "t_idx"], "left")
        total = grid.select("t", "t_idx", *[F.sum(c).over(over).alias(c) for c in sums])
        total = total.select("t", "t_idx", "n", (F.col("xy") - F.col("x") * F.col("y") / F.col("n")).alias("xy"), (F.col("xx") - F.col("x") * F.col("x") / F.col("n")).alias("xx"))
    return total.where(F.col("n") >= least).select("t", "t_idx", F.try_divide("xy", "xx").alias("slope"), "n")


def newey_west(series: DataFrame, value: str, lags: int = 6, order: str = "t", keys: tuple[str, ...] = ()) -> DataFrame:
    """mean, se (Bartlett weights), t_stat and T of each kept series, one row a key."""
    part = W.partitionBy(*(keys or [F.lit(0)]))
    rows = series.where(F.col(value).isNotNull()).withColumn("d", F.col(value) - F.avg(value).over(part))
    run = part.orderBy(order)
    weights = [(h, 1 - h / (lags + 1)) for h in range(1, lags + 1)]
    cross = reduce(lambda a, b: a + b, [F.lit(2 * w) * F.coalesce(F.col("d") * F.lag("d", h).over(run), F.lit(0.0)) for h, w in weights])
    rows = rows.withColumn("s", F.col("d") * F.col("d") + cross)
    out = rows.groupBy(*keys).agg(F.count("*").alias("T"), F.avg(value).alias("mean"), (F.sqrt(F.greatest(F.sum("s") / F.count("*"), F.lit(0.0)) / F.count("*"))).alias("se"))
    return out.withColumn("t_stat", F.try_divide("mean", "se"))


def fama_macbeth(panel: DataFrame, y: str, x: list[str], lags: int = 6) -> DataFrame:
    """(term, mean, se, t_stat, T): period regressions of y on the regressors and an intercept,
    averaged over the periods with max(5, k + 2) rows or more. One and two regressors have
    closed forms; for more the periods' Gram sums are solved."""
    k = len(x)
    rows = panel.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [y, *x]]))
    each = rows.groupBy("t")
    if k == 1:
        coef = each.agg(F.count("*").alias("n"), F.regr_slope(y, x[0]).alias(x[0]), F.regr_intercept(y, x[0]).alias("const"))
    elif k == 2:
        a, b = x
        cov = each.agg(
            F.count("*").alias("n"), F.avg(y).alias("my"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.covar_pop(a, a).alias("saa"), F.covar_pop(b, b).alias("sbb"),
            F.covar_pop(a, b).alias("sab"), F.covar_pop(a, y).alias("say"), F.covar_pop(b, y).alias("sby"),
        )
        det = F.col("saa") * F.col("sbb") - F.col("sab") * F.col("sab")
        cov = cov.withColumns({a: F.try_divide(F.col("say") * F.col("sbb") - F.col("sby") * F.col("sab"), det), b: F.try_divide(F.col("sby") * F.col("saa") - F.col("say") * F.col("sab"), det)})
        coef = cov.withColumn("const", F.col("my") - F.col(a) * F.col("ma") - F.col(b) * F.col("mb"))
    else:
        from .walkforward import ridge

        enough = rows.withColumn("_n", F.count("*").over(W.partitionBy("t"))).where(F.col("_n") >= max(5, k + 2))
        return newey_west(ridge(enough, y, x, penalty=0.0, keys=("t",)), "coef", lags, keys=("term",))
    long = coef.where(F.col("n") >= max(5, k + 2)).unpivot(["t"], ["const", *x], "term", "coef")
    return newey_west(long, "coef", lags, keys=("term",))


def origin_slope(y: str, x: str, frame) -> Column:
    """Slope through the origin over a frame."""
    return F.try_divide(F.sum(F.col(x) * F.col(y)).over(frame), F.sum(F.col(x) * F.col(x)).over(frame))


def s_score(panel: DataFrame, spread: str, window: int = 60, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """`panel` with s_score: the spread's distance from the mean of the AR(1) that the
    `window` changes before it follow, in stationary deviations; null unless it reverts."""
    run = W.partitionBy(*keys).orderBy("t_idx")
    rows = panel.withColumns({"_x": F.lag(spread).over(run)}).withColumn("_d", F.col(spread) - F.col("_x"))
    frame = run.rowsBetween(-window, -1)
    pair = F.when(_pair("_d", "_x"), 1)
    rows = rows.withColumns({"_n": F.count(pair).over(frame), "_b": F.regr_slope("_d", "_x").over(frame), "_a": F.regr_intercept("_d", "_x").over(frame), "_syy": F.regr_syy("_d", "_x").over(frame), "_sxy": F.regr_sxy("_d", "_x").over(frame)})
    rows = rows.withColumn("_v", (F.col("_syy") - F.col("_b") * F.col("_sxy")) / (F.col("_n") - 2))
    good = (F.col("_n") == window) & (F.col("_b") < 0) & (F.col("_b") > -2) & (F.col("_v") > 0)
    centre, phi = -F.col("_a") / F.col("_b"), 1 + F.col("_b")
    score = F.when(good, (F.col(spread) - centre) / F.sqrt(F.col("_v") / (1 - phi * phi)))
    return rows.withColumn("s_score", score).drop("_x", "_d", "_n", "_b", "_a", "_syy", "_sxy", "_v")
