"""Network momentum: a tensor of features, graphs refitted on a schedule, features spread over them, and
strategies that are fitted on the past and traded on what follows.

A date's features are one array of fixed size. A graph is learnt at the dates of its schedule only and stands
in a table of versions (fit_idx, valid_from, valid_to); daily features find their version by that interval, so
no graph is stored or learnt a second time for the days between.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quantweave.functions import series as S
from quantweave.sources.stored import stored

from . import graphs, trend


def names(horizons: tuple[int, ...], speeds: list[tuple[int, int]]) -> list[str]:
    return [f"vsr_{k}" for k in horizons] + [f"macd_{a}" for a, _ in speeds]


def tensor(panel: DataFrame, horizons: tuple[int, ...], speeds: list[tuple[int, int]], price_window: int, own_window: int, deviation: tuple[int, int], halflife: float, k: float = 5.0, least: int | None = None) -> DataFrame:
    """t_idx, asset, r, sd, y, one column a feature, and `u`, their array (null unless all are there).

    From (t_idx, asset, price): prices are carried forward, r is the log return, sd its deviation over
    `deviation` (rows, least values), y the next return over its own sd. Features are returns over the horizons,
    scaled by sd, and MACDs by speed, each clipped to k exponentially weighted deviations. Rows before an asset's
    first price are left out.
    """
    rows = panel.select("t_idx", "asset", S.fill_forward("price").alias("price")).where("price is not null")
    rows = rows.withColumn("r", S.log_return())
    rows = rows.withColumn("sd", S.rolling(F.stddev_samp, "r", *deviation))
    rows = rows.withColumns({f"vsr_{h}": S.log_return(k=h) / (F.col("sd") * h**0.5 + 1e-10) for h in horizons})
    rows = rows.withColumn("y", F.lead(F.col("r") / (F.col("sd") + 1e-10)).over(S.by()))
    all_names = names(horizons, speeds)
    rows = trend.winsorise(trend.macd_features(rows, speeds, price_window, own_window), all_names, halflife, k, least)
    clean = rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in all_names})
    whole = F.lit(True)
    for c in all_names:
        whole &= F.col(c).isNotNull()
    return clean.select("t_idx", "asset", "r", "sd", "y", *all_names, F.when(whole, F.array(*all_names)).alias("u"))


def members(features: DataFrame, window: int, least: int = 5) -> DataFrame:
    """(t_idx, asset): assets whose `window` rows before t all have a vector, for dates with `least` of them."""
    there = F.count("u").over(S.by().rowsBetween(-window, -1)) == window
    rows = features.select("t_idx", "asset", there.alias("ok")).where("ok").drop("ok")
    return rows.withColumn("_n", F.count("*").over(W.partitionBy("t_idx"))).where(F.col("_n") >= least).drop("_n")


def schedule(there: DataFrame, every: int) -> DataFrame:
    """(t_idx, fit_idx): the graph in force at each date of `members`. One is learnt at multiples of `every` and
    when a set of assets is met for the first time; a set that comes back has its last graph again."""
    sets = there.groupBy("t_idx").agg(F.xxhash64(F.sort_array(F.collect_set("asset"))).alias("_set"))
    run = W.partitionBy("_set").orderBy("t_idx")
    new = (F.col("t_idx") % every == 0) | (F.row_number().over(run) == 1)
    return sets.withColumn("_f", F.when(new, F.col("t_idx"))).select("t_idx", F.last("_f", ignorenulls=True).over(run).alias("fit_idx"))


def versions(plan: DataFrame) -> DataFrame:
    """(fit_idx, valid_from, valid_to), both ends included: runs of dates with one graph."""
    run = W.orderBy("t_idx")  # one row a date
    new = (F.col("t_idx") != F.lag("t_idx").over(run) + 1) | (F.col("fit_idx") != F.lag("fit_idx").over(run)) | F.lag("t_idx").over(run).isNull()
    runs = plan.withColumn("_n", F.sum(new.cast("int")).over(run))
    return runs.groupBy("_n", "fit_idx").agg(F.min("t_idx").alias("valid_from"), F.max("t_idx").alias("valid_to")).drop("_n")


def stacks(features: DataFrame, fits: DataFrame, window: int) -> DataFrame:
    """(t, asset, v): the `window` vectors before each fit_idx of `fits` in a row, of assets that have them all.
    A row of features goes to the fits whose window holds it, and to no others."""
    # one short row a fit
    near = features.where("u is not null").join(F.broadcast(fits.select(F.col("fit_idx").alias("t")).distinct()), (F.col("t_idx") < F.col("t")) & (F.col("t_idx") >= F.col("t") - window))
    one = near.groupBy("t", "asset").agg(F.array_sort(F.collect_list(F.struct("t_idx", "u"))).alias("rows")).where(F.size("rows") == window)
    return one.select("t", "asset", F.flatten(F.transform("rows", lambda x: x["u"])).alias("v"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def stacked_edges(rows: DataFrame) -> DataFrame:
    """(t, i, j, s), i <> j: cosines of the stacks of one date, each pair multiplied once."""
    unit = rows.withColumn("_n", F.sqrt(_dot(F.col("v"), F.col("v"))) + 1e-10).select("t", "asset", F.transform("v", lambda x: x / F.col("_n")).alias("v"))
    a, b = (unit.select("t", F.col("asset").alias(n), F.col("v").alias(v)) for n, v in (("i", "a"), ("j", "b")))
    half = a.join(b, "t").where("i < j").select("t", "i", "j", F.round(_dot(F.col("a"), F.col("b")), 12).alias("s"))
    both = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("way")
    return half.select("t", both, "s").select("t", "way.i", "way.j", "s")


def learnt(features: DataFrame, there: DataFrame, plan: DataFrame, windows: list[int], beta: float, least: int = 5) -> DataFrame:
    """(fit_idx, i, j, w): the mean over the windows of the cosine graphs of each fit's assets, normalised.
    Cosines and means are stored, as several steps read them."""
    fits = plan.select("fit_idx").distinct()
    own = there.withColumnRenamed("t_idx", "t")
    made = None
    for w in windows:
        rows = stacks(features, fits, w).join(own, ["t", "asset"], "left_semi")
        rows = rows.withColumn("_n", F.count("*").over(W.partitionBy("t"))).where(F.col("_n") >= least).drop("_n")
        one = graphs.thinned(stored(stacked_edges(rows)), beta).withColumn("win", F.lit(w))
        made = one if made is None else made.union(one)
    return graphs.normalise(stored(graphs.ensemble(stored(made)))).withColumnRenamed("t", "fit_idx")


def spread_over(features: DataFrame, there: DataFrame, held: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """(t_idx, asset, x): the neighbours' vectors by edge weight, in one aggregation, for `there`'s rows.

    `held` has the versions of `edges`. An asset without an edge has zeros; one with a neighbour that has no
    vector that day has null.
    """
    # one short row a version
    daily = features.select("t_idx", F.col("asset").alias("j"), "u").join(F.broadcast(held), (F.col("t_idx") >= F.col("valid_from")) & (F.col("t_idx") <= F.col("valid_to")))
    sums = F.array(*[F.sum(F.col("w") * F.col("u")[k]) for k in range(size)])
    net = daily.join(edges, ["fit_idx", "j"]).groupBy("t_idx", F.col("i").alias("asset")).agg(F.when(F.count("u") == F.count("*"), sums).alias("x"), F.count("*").alias("_n"))
    zeros = F.array(*[F.lit(0.0)] * size)
    return there.join(net, ["t_idx", "asset"], "left").select("t_idx", "asset", F.when(F.col("_n").isNull(), zeros).otherwise(F.col("x")).alias("x"))


def block_ridge(rows: DataFrame, size: int, first: int, test: int, penalty: float = 1e-4, least: int = 3) -> DataFrame:
    """(period, coefs): y on the vector x and an intercept that is not penalised (the last coefficient), for
    each period from the rows before its test.

    Cross products are summed once by block between the tests' starts; a period's sums are those of all blocks
    before it, so no row is in more than one of them. Only the sums, a row a block, are solved in Python.
    """
    x = [F.col("x")[k] for k in range(size)] + [F.lit(1.0)]
    cells = [(i, j) for i in range(size + 1) for j in range(i, size + 1)]
    sums = {f"g{i}_{j}": F.sum(x[i] * x[j]) for i, j in cells} | {f"b{i}": F.sum(c * F.col("y")) for i, c in enumerate(x)} | {"n": F.count("*").cast("double")}
    block = F.when(F.col("t_idx") < first, 0).otherwise(F.floor((F.col("t_idx") - first) / test) + 1).cast("int")
    by_block = rows.where("x is not null and y is not null").groupBy(block.alias("period")).agg(*[v.alias(k) for k, v in sums.items()])
    before = W.orderBy("period").rowsBetween(W.unboundedPreceding, 0)  # one row a block
    running = by_block.select("period", *[F.sum(k).over(before).alias(k) for k in sums]).where(F.col("n") >= least)

    def solve(batches):
        for df in batches:
            out = []
            for r in df.to_dict("records"):
                a = np.zeros((size + 1, size + 1))
                for i, j in cells:
                    a[i, j] = a[j, i] = r[f"g{i}_{j}"]
                a[np.arange(size), np.arange(size)] += penalty
                out.append((r["period"], np.linalg.lstsq(a, [r[f"b{i}"] for i in range(size + 1)], rcond=None)[0].tolist()))
            yield pd.DataFrame(out, columns=["period", "coefs"])

    return running.mapInPandas(solve, "period int, coefs array<double>")


def predicted(rows: DataFrame, coefs: DataFrame, spans: DataFrame) -> DataFrame:
    """(period, t_idx, asset, p) of test rows: null where x is; a period without a fit has no rows."""
    # a row a period in both
    fits = spans.select("period", "test_from", "test_to").join(coefs, "period")
    test = rows.join(F.broadcast(fits), (F.col("t_idx") >= F.col("test_from")) & (F.col("t_idx") < F.col("test_to")))
    size = F.size("coefs") - 1
    return test.select("period", "t_idx", "asset", F.when(F.col("x").isNotNull(), _dot(F.col("x"), F.slice("coefs", F.lit(1), size)) + F.element_at("coefs", -1)).alias("p"))


def strategies(features: DataFrame, network: DataFrame, spans: DataFrame, first: int, test: int, speeds: list[tuple[int, int]], size: int) -> DataFrame:
    """(period, t_idx, asset, strategy, x): positions on all test rows: the sign of the fit on the neighbours'
    features (`network`, of `spread_over`), of that on the asset's own, the mean response to the MACDs, and 1.
    An asset without a prediction has position 0, one without a MACD takes it as 0."""
    y = features.select("t_idx", "asset", "y")
    own = features.select("t_idx", "asset", F.col("u").alias("x"))
    fitted = {}
    for name, rows in (("network", network), ("own", own)):
        coefs = block_ridge(rows.join(y, ["t_idx", "asset"]), size, first, test)
        fitted[name] = predicted(rows, coefs, spans).select("t_idx", "asset", F.signum("p").alias(f"p_{name}"))
    macd = sum((S.response(F.coalesce(F.col(f"macd_{a}"), F.lit(0.0))) for a, _ in speeds), F.lit(0.0)) / len(speeds)
    # a row a period
    days = features.join(F.broadcast(spans.select("period", "test_from", "test_to")), (F.col("t_idx") >= F.col("test_from")) & (F.col("t_idx") < F.col("test_to")))
    days = days.join(fitted["network"], ["t_idx", "asset"], "left").join(fitted["own"], ["t_idx", "asset"], "left")
    kinds = {"network": F.coalesce("p_network", F.lit(0.0)), "own": F.coalesce("p_own", F.lit(0.0)), "macd": macd, "long": F.lit(1.0)}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), c.alias("x")) for n, c in kinds.items()])).alias("s")
    return days.select("period", "t_idx", "asset", each).select("period", "t_idx", "asset", "s.strategy", "s.x")


def portfolio(positions: DataFrame, features: DataFrame, target: float = 0.1, periods_a_year: float = 252, delay: int = 2) -> DataFrame:
    """(t_idx, strategy, r, turnover, n): the mean over assets of the position, scaled to the volatility target by
    the sd of t + delay, times that period's return; and of the change of positions, scaled by the sd of t.
    Periods whose return is not there yet have no row; n counts the assets of the mean."""
    run = S.by()
    year = periods_a_year**0.5
    ahead = features.select("t_idx", "asset", "sd", F.lead("sd", delay).over(run).alias("_sd"), F.lead("r", delay).over(run).alias("_r"))
    rows = positions.join(ahead, ["t_idx", "asset"])
    last = F.coalesce(F.lag("x").over(W.partitionBy("strategy", "asset").orderBy("t_idx")), F.lit(0.0))
    rows = rows.withColumns({"_paid": F.col("x") * target / (F.col("_sd") * year + 1e-10) * F.col("_r"), "_moved": F.abs(F.col("x") - last) * target / (F.col("sd") * year + 1e-10)})
    out = rows.groupBy("t_idx", "strategy").agg(F.avg("_paid").alias("r"), F.avg("_moved").alias("turnover"), F.count("_paid").alias("n"))
    return out.where("n > 0")


