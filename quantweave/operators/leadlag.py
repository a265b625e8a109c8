"""Pairwise lead-lag scores as edge lists, selection and hedged weights.

Rows (win, t_idx, asset, v): `win` names the look-back window a row is part of.
An edge (win, i, j, score) is positive when j leads i, unless said otherwise.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quantweave.sources.stored import stored


def windows(panel: DataFrame, ends: DataFrame, lookback: int, value: str = "r", least: int = 1) -> DataFrame:
    """The `lookback` periods up to each t_idx of `ends` (one row a rebalance date); assets with `least` values."""
    ends = ends.select(F.col("t_idx").alias("win"), F.explode(F.sequence(F.col("t_idx") - lookback + 1, F.col("t_idx"))).alias("t_idx"))
    rows = panel.select("t_idx", "asset", F.col(value).alias("v")).join(ends, "t_idx")
    return rows.withColumn("_n", F.count("v").over(W.partitionBy("win", "asset"))).where(F.col("_n") >= least).drop("_n")


def standardise(rows: DataFrame) -> DataFrame:
    """v less its mean over its population deviation in the window; null where that is 0."""
    own = W.partitionBy("win", "asset")
    return rows.withColumn("v", F.try_divide(F.col("v") - F.avg("v").over(own), F.stddev_pop("v").over(own)))


def lagged_correlations(rows: DataFrame, lags: int) -> DataFrame:
    """(win, i, j, lag, c): correlation of i now with j `lag` periods ago, for all ordered pairs; three pairs of values at least."""
    run = W.partitionBy("win", "asset").orderBy("t_idx")
    past = rows.withColumn("p", F.array(*[F.lag("v", k).over(run) for k in range(1, lags + 1)]))
    now = rows.select("win", "t_idx", F.col("asset").alias("i"), F.col("v").alias("x")).where("x is not null")
    past = past.select("win", "t_idx", F.col("asset").alias("j"), "p")
    pairs = now.join(past, ["win", "t_idx"]).where("i <> j")

    def corr(k: int) -> Column:
        y = F.col("p")[k - 1]
        n = F.count(y)
        spread = F.stddev_pop(F.when(y.isNotNull(), F.col("x")))
        return F.when((n >= 3) & (spread > 0) & (F.stddev_pop(y) > 0), F.corr("x", y)).alias(f"c{k}")

    wide = pairs.groupBy("win", "i", "j").agg(*[corr(k) for k in range(1, lags + 1)])
    return wide.select("win", "i", "j", F.posexplode(F.array(*[f"c{k}" for k in range(1, lags + 1)])).alias("k", "c")).select("win", "i", "j", (F.col("k") + 1).alias("lag"), "c").where("c is not null")


def lag_scores(correlations: DataFrame, method: str = "c1", mode: str = "absolute_strength") -> DataFrame:
    """(win, i, j, score, relation) for ordered pairs. c1 takes the strongest lag, c2 the mean
    over lags; signed_correlation compares values instead of their sizes. relation: the
    sign of what j tells about i."""
    first = F.max_by("c", F.struct(F.abs("c"), -F.col("lag")))
    if mode == "signed_correlation":
        size = F.max("c") if method == "c1" else F.avg("c")
    else:
        size = F.abs(first) if method == "c1" else F.avg(F.abs("c"))
    one = correlations.groupBy("win", "i", "j").agg(size.alias("s"), F.signum(first if method == "c1" else F.avg("c")).alias("relation"))
    back = one.select("win", F.col("i").alias("j"), F.col("j").alias("i"), F.col("s").alias("b"))
    both = one.join(back, ["win", "i", "j"], "full")
    return both.select("win", "i", "j", (F.coalesce("s", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("score"), F.coalesce("relation", F.lit(0.0)).alias("relation"))


def _paths(rows: DataFrame) -> DataFrame:
    run = W.partitionBy("win", "i", "j").orderBy("t_idx")
    a = rows.select("win", "t_idx", F.col("asset").alias("i"), F.col("v").alias("x"))
    b = rows.select("win", "t_idx", F.col("asset").alias("j"), F.col("v").alias("y"))
    pairs = a.join(b, ["win", "t_idx"]).where("i < j and x is not null and y is not null")
    sums = run.rowsBetween(W.unboundedPreceding, 0)
    pairs = pairs.withColumns({"X": F.sum("x").over(sums), "Y": F.sum("y").over(sums)})
    return pairs.withColumns({"dX": F.col("X") - F.lag("X").over(run), "dY": F.col("Y") - F.lag("Y").over(run), "X0": F.lag("X").over(run), "Y0": F.lag("Y").over(run)})


def _mirror(upper: DataFrame) -> DataFrame:
    return upper.union(upper.select("win", F.col("j").alias("i"), F.col("i").alias("j"), -F.col("score")))


def levy_end_point(rows: DataFrame) -> DataFrame:
    """Levy area of cumulative paths by end points, over the number of periods; three at least."""
    area = F.sum(F.coalesce(F.col("X") * F.col("dY") - F.col("Y") * F.col("dX"), F.lit(0.0))) / 2
    upper = _paths(rows).groupBy("win", "i", "j").agg(F.when(F.count("*") >= 3, -area / F.count("*")).otherwise(0.0).alias("score"))
    return _mirror(upper)


def levy_midpoint(rows: DataFrame) -> DataFrame:
    """Levy area by midpoints; positive when i leads j."""
    area = F.sum((F.col("X0") + F.col("X")) / 2 * F.col("dY") - (F.col("Y0") + F.col("Y")) / 2 * F.col("dX")) / 2
    return _mirror(_paths(rows).groupBy("win", "i", "j").agg(F.coalesce(area, F.lit(0.0)).alias("score")))


def cross_correlation_lag(rows: DataFrame, share: float = 0.25) -> DataFrame:
    """(win, i, j, lag): the lag of at most a share of the window with the largest mean product
    of deviations; positive when i leads j, ties to the smaller lag by size, then sign."""
    own = W.partitionBy("win", "asset")
    z = rows.withColumn("v", F.col("v") - F.avg("v").over(own)).withColumn("n", F.count("*").over(own)).where("v is not null")
    a = z.select("win", F.col("t_idx").alias("s"), F.col("asset").alias("i"), F.col("v").alias("x"), "n")
    a = a.withColumn("lag", F.explode(F.sequence(-F.floor(F.col("n") * share), F.floor(F.col("n") * share)))).withColumn("t_idx", F.col("s") + F.col("lag"))
    b = z.select("win", "t_idx", F.col("asset").alias("j"), F.col("v").alias("y"))
    sums = a.join(b, ["win", "t_idx"]).where("i < j").groupBy("win", "i", "j", "lag").agg(F.sum(F.col("x") * F.col("y")).alias("c"))
    return sums.groupBy("win", "i", "j").agg(F.max_by("lag", F.struct("c", -F.abs("lag"), "lag")).alias("lag"))


def pick(scores: DataFrame, leaders: float, followers: float) -> DataFrame:
    """(win, asset, side, mean): the assets that lead and follow most, by column means with the diagonal's 0."""
    mean = scores.groupBy("win", F.col("j").alias("asset")).agg(F.sum("score").alias("s"), F.count("*").alias("m"))
    mean = mean.withColumn("mean", F.col("s") / (F.col("m") + 1))
    at = W.partitionBy("win")
    ranked = mean.withColumns({"hi": F.row_number().over(at.orderBy(F.desc("mean"), "asset")), "lo": F.row_number().over(at.orderBy("mean", F.desc("asset"))), "n": F.count("*").over(at)})
    top, low = F.greatest(F.floor(F.col("n") * leaders), F.lit(1)), F.greatest(F.floor(F.col("n") * followers), F.lit(1))
    side = F.when(F.col("hi") <= top, "leader").when(F.col("lo") <= low, "follower")
    return ranked.where(top + low <= F.col("n")).withColumn("side", side).where("side is not null").select("win", "asset", "side", "mean")


def relation_signs(scores: DataFrame, picked: DataFrame) -> DataFrame:
    """(win, asset, sign) of followers: the sign of the mean of what leaders tell about them, +1 if nothing."""
    lead, follow = (picked.where(F.col("side") == s).select("win", F.col("asset").alias(c)) for s, c in (("leader", "j"), ("follower", "i")))
    told = scores.join(lead, ["win", "j"], "left_semi").join(follow, ["win", "i"], "right").groupBy("win", "i").agg(F.avg(F.when(F.col("relation") != 0, F.signum("relation"))).alias("m"))
    return told.select("win", F.col("i").alias("asset"), F.when(F.col("m") < 0, -1.0).otherwise(1.0).alias("sign"))


def hedged_weights(picked: DataFrame, signs: DataFrame, signal: DataFrame) -> DataFrame:
    """(t_idx, win, asset, w): followers at signal times sign over their number, the market against them.

    `signal` has (win, t_idx, signal), +1 or -1."""
    followers = picked.where("side = 'follower'").join(signs, ["win", "asset"]).withColumn("n", F.count("*").over(W.partitionBy("win")))
    held = followers.join(signal, "win").select("t_idx", "win", "asset", (F.col("signal") * F.col("sign") / F.col("n")).alias("w"))
    market = held.select("t_idx", "win").distinct().join(signal, ["win", "t_idx"]).select("t_idx", "win", F.lit("market").alias("asset"), -F.col("signal").alias("w"))
    return held.union(market)


def strategy(panel: DataFrame, market: DataFrame, method: str = "c1", lookback: int = 60, every: int = 5, lags: int = 5, leaders: float = 0.2, followers: float = 0.2, trade_lag: int = 1, least: int = 30, cost_bps: float = 0.0) -> DataFrame:
    """(t_idx, r, turnover): weights formed at t_idx - 1 - trade_lag from the last rebalance, net of cost.

    `panel`: t_idx, asset, r; `market`: t_idx, r. method: c1, c2 or levy. The
    signal is the sign of the leaders' mean return on the rebalance date, a
    missing one counts as negative. Scores, picks and weights are written to the
    shared folder, as later steps read them several times; so they do `panel`,
    best handed in as a stored table."""
    last = panel.agg(F.max("t_idx")).first()[0] - 1 - trade_lag  # one number
    days = panel.select("t_idx").distinct().where((F.col("t_idx") >= lookback - 1) & (F.col("t_idx") <= last))
    ends = days.where((F.col("t_idx") - (lookback - 1)) % every == 0)
    rows = standardise(windows(panel, ends, lookback, least=least))
    if method == "levy":
        scores = levy_end_point(rows).withColumn("relation", F.lit(1.0))
    else:
        scores = lag_scores(lagged_correlations(rows, lags), method)
    scores = stored(scores)  # selection, signs and weights all read it
    picked = stored(pick(scores, leaders, followers))
    signs = relation_signs(scores, picked)
    now = picked.where("side = 'leader'").join(panel.select(F.col("t_idx").alias("win"), "asset", "r"), ["win", "asset"], "left").groupBy("win").agg(F.avg("r").alias("m"))
    signal = now.select("win", F.col("win").alias("t_idx"), F.when(F.col("m") >= 0, 1.0).otherwise(-1.0).alias("signal"))
    formed = stored(hedged_weights(picked, signs, signal).select("win", "asset", "w"))
    held = days.select("t_idx", (F.floor((F.col("t_idx") - (lookback - 1)) / every) * every + lookback - 1).cast("long").alias("win")).join(formed, "win")
    every_asset = panel.select("t_idx", "asset", "r").union(market.select("t_idx", F.lit("market"), "r"))
    pnl = held.withColumn("t_idx", F.col("t_idx") + 1 + trade_lag).join(every_asset, ["t_idx", "asset"], "left").groupBy("t_idx").agg(F.sum(F.col("w") * F.coalesce("r", F.lit(0.0))).alias("gross"))
    # weights change on rebalance dates only
    before = formed.select((F.col("win") + every).alias("win"), "asset", F.col("w").alias("p"))
    moved = formed.join(before, ["win", "asset"], "full").join(ends.select(F.col("t_idx").alias("win")), "win", "left_semi")
    moved = moved.groupBy("win").agg(F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("p", F.lit(0.0)))).alias("turnover"))
    out = pnl.join(moved.select((F.col("win") + 1 + trade_lag).alias("t_idx"), "turnover"), "t_idx", "left").withColumn("turnover", F.coalesce("turnover", F.lit(0.0)))
    return out.select("t_idx", (F.col("gross") - cost_bps * 1e-4 * F.col("turnover")).alias("r"), "turnover")


def characteristic_ranks(panel: DataFrame, value: str, share: float = 0.2) -> DataFrame:
    """(t_idx, asset, side): by date the assets with the greatest and the least of a
    characteristic, floor of the share of those that have it, one at least."""
    at = W.partitionBy("t_idx")
    rows = panel.where(F.col(value).isNotNull()).withColumns({"_hi": F.row_number().over(at.orderBy(F.desc(value), "asset")), "_lo": F.row_number().over(at.orderBy(value, "asset")), "_n": F.count("*").over(at)})
    many = F.greatest(F.floor(F.col("_n") * share), F.lit(1))
    side = F.when(F.col("_hi") <= many, "high").when(F.col("_lo") <= many, "low")
    return rows.withColumn("side", side).where("side is not null").select("t_idx", "asset", "side")


def betas(panel: DataFrame, market: DataFrame, least: int = 12) -> DataFrame:
    """(asset, beta, correlation, n) of returns against the market's (t_idx, r)."""
    both = panel.where("r is not null").join(F.broadcast(market.where("r is not null").select("t_idx", F.col("r").alias("m"))), "t_idx")
    return both.groupBy("asset").agg(F.regr_slope("r", "m").alias("beta"), F.corr("r", "m").alias("correlation"), F.count("*").alias("n")).where(F.col("n") >= least)
