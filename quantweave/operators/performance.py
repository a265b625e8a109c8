"""Performance of return series: rows (strategy, t, r[, turnover]) to one row a strategy.

Conventions differ by field: arithmetic or geometric annual returns, sample or
population deviations. Each is an argument; none is implied. A series is the
rows of one strategy, however many strategies there are.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def growth(r: Column | str, over=None) -> Column:
    """Product of 1 + r, nulls left out; a return of -1 or less is ruin: 0 from then on."""
    r = F.col(r) if isinstance(r, str) else r
    logs, ruined = F.sum(F.when(r > -1, F.log1p(r))), F.bool_or(r <= -1)
    if over is not None:
        logs, ruined = logs.over(over), ruined.over(over)
    return F.when(ruined, 0.0).otherwise(F.exp(logs))


def annual_return(r: str, periods: float, kind: str = "arithmetic") -> Column:
    """Geometric: -1 for a series with a return of -1 or less."""
    if kind == "arithmetic":
        return F.avg(r) * periods
    if kind == "geometric":
        return F.pow(growth(r), periods / F.count(r)) - 1
    return F.exp(F.sum(r) / (F.count(r) / periods)) - 1  # log returns


def volatility(r: str, periods: float, sample: bool = True) -> Column:
    return (F.stddev_samp(r) if sample else F.stddev_pop(r)) * periods**0.5


def sharpe(r: str, periods: float, sample: bool = True, riskless: float = 0.0) -> Column:
    """Null-free: 0 where the deviation vanishes."""
    std = F.stddev_samp(r) if sample else F.stddev_pop(r)
    return F.when(std > 1e-12, (F.avg(r) - riskless / periods) / std * periods**0.5).otherwise(0.0)


def downside(r: str, periods: float) -> Column:
    return F.coalesce(F.stddev_samp(F.when(F.col(r) < 0, F.col(r))), F.lit(0.0)) * periods**0.5


def profit_loss_ratio(r: str) -> Column:
    gain, loss = F.avg(F.when(F.col(r) > 0, F.col(r))), F.abs(F.avg(F.when(F.col(r) < 0, F.col(r))))
    return F.coalesce(gain, F.lit(0.0)) / F.greatest(F.coalesce(loss, F.lit(0.0)), F.lit(1e-10))


def drawdowns(rows: DataFrame, keys: tuple[str, ...] = ("strategy",), r: str = "r", order: str = "t", log: bool = False) -> DataFrame:
    """Equity, its running peak and the drawdown; the peak begins with the first equity."""
    run = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    value = F.coalesce(F.col(r), F.lit(0.0))
    equity = F.sum(value).over(run) if log else growth(value, run)
    out = rows.withColumn("equity", equity).withColumn("peak", F.max("equity").over(run))
    # a peak of 0 is ruin in the first period
    return out.withColumn("drawdown", F.col("equity") - F.col("peak") if log else F.coalesce(F.try_divide("equity", "peak"), F.lit(0.0)) - 1)


def summary(rows: DataFrame, periods: float, keys: tuple[str, ...] = ("strategy",), kind: str = "arithmetic", sample: bool = True, order: str = "t") -> DataFrame:
    """ann_ret, ann_vol, sharpe, down_dev, sortino, max_dd, calmar, hit_rate, profit_loss, t_stat, under_water, n."""
    rows = drawdowns(rows.where("r is not null"), keys, order=order)
    out = rows.groupBy(*keys).agg(
        F.count("r").alias("n"),
        annual_return("r", periods, kind).alias("ann_ret"),
        volatility("r", periods, sample).alias("ann_vol"),
        sharpe("r", periods, sample).alias("sharpe"),
        downside("r", periods).alias("down_dev"),
        F.min("drawdown").alias("max_dd"),
        F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"),
        profit_loss_ratio("r").alias("profit_loss"),
        F.try_divide(F.avg("r"), F.stddev_samp("r") / F.sqrt(F.count("r"))).alias("t_stat"),
        F.avg((F.col("drawdown") < 0).cast("double")).alias("under_water"),
    )
    return out.withColumns({"sortino": F.when(F.col("down_dev") > 1e-12, F.col("ann_ret") / F.col("down_dev")).otherwise(0.0), "calmar": F.when(F.col("max_dd") < -1e-12, F.col("ann_ret") / -F.col("max_dd")).otherwise(0.0)})


def cost_sweep(rows: DataFrame, bps: list[float]) -> DataFrame:
    """The series net of each cost, in one job: a column `bps` more."""
    costs = F.explode(F.array(*[F.lit(float(b)) for b in bps])).alias("bps")
    return rows.select("*", costs).withColumn("r", F.col("r") - F.col("bps") / 1e4 * F.coalesce("turnover", F.lit(0.0)))


def breakeven_cost(rows: DataFrame, periods: float, most: int = 500) -> DataFrame:
    """Smallest whole cost in bps below `most` at which the compounded annual return is not
    positive: it only falls with the cost, so halving finds it over each strategy's series."""
    series = rows.where("r is not null").groupBy("strategy").agg(F.collect_list(F.struct("r", F.coalesce("turnover", F.lit(0.0)).alias("moved"))).alias("x"))

    def lost(cost: Column) -> Column:
        net = F.transform("x", lambda x: x["r"] - cost / 1e4 * x["moved"])
        ruined = F.exists(net, lambda r: r <= -1)
        logs = F.aggregate(net, F.lit(0.0), lambda s, r: s + F.when(r > -1, F.log1p(r)).otherwise(0.0))
        return ruined | (F.pow(F.exp(logs), periods / F.size("x")) - 1 <= 0)

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        out = F.when(s["low"] >= s["high"], s).when(lost(mid), F.struct(s["low"].alias("low"), mid.alias("high")))
        return out.otherwise(F.struct((mid + 1).alias("low"), s["high"].alias("high")))

    ends = F.aggregate(F.sequence(F.lit(1), F.lit(most.bit_length())), F.struct(F.lit(0).alias("low"), F.lit(most).alias("high")), halve)
    return series.select("strategy", F.when(ends["low"] < most, ends["low"]).alias("breakeven_bps"))


def crash_rate(rows: DataFrame, block: int = 12, loss: float = -0.2) -> DataFrame:
    """Share of blocks of `block` periods, for all shifts, whose drawdown is below `loss`; rows need t_idx from 0."""
    shifts = rows.select("strategy", "t_idx", "r", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("shift")).where("t_idx >= shift")
    shifts = shifts.withColumn("block", F.floor((F.col("t_idx") - F.col("shift")) / block))
    down = drawdowns(shifts, ("strategy", "shift", "block"), order="t_idx")
    each = down.groupBy("strategy", "shift", "block").agg(F.count("*").alias("n"), F.min("drawdown").alias("dd")).where(F.col("n") == block)
    return each.groupBy("strategy").agg(F.avg((F.col("dd") < loss).cast("double")).alias("crash_rate"), F.count("*").alias("blocks"))


def skew_by_horizon(rows: DataFrame, horizons: tuple[int, ...], key: str = "asset") -> DataFrame:
    """Population skewness of non-overlapping sums over each horizon; whole groups only, three at least."""
    h = F.explode(F.array(*[F.lit(x) for x in horizons])).alias("h")
    sums = rows.select(key, "t_idx", "r", h).groupBy(key, "h", F.floor(F.col("t_idx") / F.col("h")).alias("g")).agg(F.sum(F.coalesce("r", F.lit(0.0))).alias("x"), F.count("*").alias("n"))
    return sums.where("n = h").groupBy(key, "h").agg(F.count("*").alias("k"), F.skewness("x").alias("skew")).where("k >= 3")


def turnover(weights: DataFrame, keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Sum of absolute weight changes by period; an asset not held has weight 0."""
    last = F.lag("w").over(W.partitionBy(*keys, "asset").orderBy("t_idx"))
    moved = weights.withColumn("d", F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce(last, F.lit(0.0))))
    return moved.groupBy(*keys, "t", "t_idx").agg(F.sum("d").alias("turnover"))


def t_probability(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic with whole degrees of freedom, by its finite series."""
    angle = F.atan(F.abs(t) / F.sqrt(df))
    c2 = F.cos(angle) * F.cos(angle)
    odd = df % 2 == 1
    # terms c^(2i) times (2.4...)/(3.5...) for odd, (1.3...)/(2.4...) for even degrees
    upto = F.floor((df - F.when(odd, 3).otherwise(2)) / 2)
    state = F.aggregate(
        F.when(upto >= 1, F.sequence(F.lit(1).cast("long"), upto.cast("long"))).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, i: F.struct(
            (s["term"] * c2 * F.when(odd, 2 * i / (2 * i + 1)).otherwise((2 * i - 1) / (2 * i))).alias("term"),
            (s["sum"] + s["term"] * c2 * F.when(odd, 2 * i / (2 * i + 1)).otherwise((2 * i - 1) / (2 * i))).alias("sum"),
        ),
    )["sum"]
    pi = 3.141592653589793
    inside = F.when(df == 1, 2 / pi * angle).when(odd, 2 / pi * (angle + F.sin(angle) * F.cos(angle) * state)).otherwise(F.sin(angle) * state)
    return F.when(df >= 1, F.greatest(1 - inside, F.lit(0.0)))


def mean_test(rows: DataFrame, r: str = "r", keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """n, t_stat and two-sided p_value of the mean against 0."""
    out = rows.groupBy(*keys).agg(F.count(r).alias("n"), F.try_divide(F.avg(r), F.stddev_samp(r) / F.sqrt(F.count(r))).alias("t_stat"))
    return out.withColumn("p_value", t_probability(F.col("t_stat"), F.col("n") - 1))


def average_holding(rows: DataFrame, position: str = "position", key: str = "asset", order: str = "t_idx") -> DataFrame:
    """Mean periods that a position is held: twice the gross position over its changes, entry from 0 included."""
    run = W.partitionBy(key).orderBy(order)
    now = F.coalesce(position, F.lit(0.0))
    moved = rows.withColumn("_d", F.abs(now - F.lag(now, 1, 0.0).over(run)))
    return moved.groupBy(key).agg(F.try_divide(2 * F.sum(F.abs(F.coalesce(position, F.lit(0.0)))), F.sum("_d")).alias("bars"))


def frequency_sweep(weights: DataFrame, everies: list[int]) -> DataFrame:
    """(every, t_idx, r): weights (asset, t_idx, w, r) taken at multiples of `every`, held
    until the next and paid the return of the period after; all frequencies in one job."""
    each = weights.select("*", F.explode(F.array(*[F.lit(e) for e in everies])).alias("every"))
    run = W.partitionBy("every", "asset").orderBy("t_idx")
    chosen = F.when(F.col("t_idx") % F.col("every") == 0, F.struct("w"))
    held = each.withColumn("_h", F.last(chosen, ignorenulls=True).over(run.rowsBetween(W.unboundedPreceding, -1))["w"])
    return held.groupBy("every", "t_idx").agg(F.sum(F.col("_h") * F.col("r")).alias("r"), F.count(F.col("_h") * F.col("r")).alias("n")).where("n > 0")


def histogram(rows: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """(bin, low, n) of equal bins from the least to the greatest value, empty ones included; the last is closed."""
    ends = rows.agg(F.min(value).alias("a"), F.max(value).alias("b"))
    at = F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col(value) - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1))).otherwise(0)
    # one row against the values
    count = rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = ends.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(count, "bin", "left").select("bin", (F.col("a") + (F.col("b") - F.col("a")) * F.col("bin") / bins).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))
