"""Queries of models that SQL cannot say; each is tested against brute force."""

from pyspark.sql import functions as F

from quantweave.operators import barrier, boosting, classes, graphs, labels, statespace, timewarp, walkforward
from quantweave.operators import intraday as I
from quantweave.operators import performance as P
from quantweave.operators import regression as G
from quantweave.sources import panels
from quantweave.sources.stored import stored

from .intraday import _bars
from .network import _features, _labelled, _yearly
from .registry import query
from .series import rounded


def _monthly(spark, sf):
    return panels.monthly_returns(spark, sf).select("t_idx", "asset", F.col("r").alias("v"))


for _method in ("dtw", "ddtw", "sdtw", "sddtw"):

    @query(f"warp_lags_{_method}")
    def warp_lags(spark, sf, method=_method):
        """Lags of all pairs of brands over the last 24 months."""
        rows = _monthly(spark, sf)
        end = rows.agg(F.max("t_idx")).first()[0] + 1  # one number
        return timewarp.lag_matrix(timewarp.windows_of(rows, [24], end), method)


@query("warp_lag_ensemble")
def warp_lag_ensemble(spark, sf):
    rows = _monthly(spark, sf)
    end = rows.agg(F.max("t_idx")).first()[0] + 1  # one number
    return rounded(timewarp.ensemble_lags(rows, [6, 12, 18, 24], end), "i", "j", lag="lag")


@query("warp_graph")
def warp_graph(spark, sf):
    """The sparse graph of mean lags, normalised with self loops."""
    lags = warp_lag_ensemble(spark, sf).select(F.lit(0).alias("t"), "i", "j", F.col("lag").alias("v"))
    nodes = lags.select("t", F.col("i").alias("asset")).distinct()
    return rounded(graphs.normalise(graphs.sparse_graph(lags, 0.1, 0.5), nodes), "i", "j", w="w")


@query("barrier_graph")
def barrier_graph(spark, sf):
    """Each year's graph with a log barrier."""
    return rounded(barrier.barrier_graphs(_yearly(spark, sf), 0.5, 0.5), "t", "i", "j", w="w")


@query("graph_search")
def graph_search(spark, sf):
    """Each year's best of a grid of graphs by the Sharpe ratio of neighbours' past returns."""
    rows = _yearly(spark, sf)
    made = barrier.grid_graphs(rows, [0.1, 1.0], [0.1, 1.0])
    signal = made.join(rows.select("t", F.col("asset").alias("j"), (F.col("k") + 1).alias("k"), "v"), ["t", "j"]).groupBy("t", "alpha", "beta", "k", F.col("i").alias("asset")).agg(F.sum(F.col("w") * F.col("v")).alias("s"))
    paid = signal.join(rows.withColumnRenamed("v", "r"), ["t", "k", "asset"]).groupBy("t", "alpha", "beta", "k").agg(F.avg(F.signum("s") * F.col("r")).alias("r"))
    scores = paid.groupBy("t", "alpha", "beta").agg(P.sharpe("r", 12).alias("sharpe"), F.count("r").alias("n"))
    return rounded(walkforward.best_of_grid(scores, ["t"], "sharpe"), "t", "alpha", "beta", "n", sharpe="sharpe")


@query("class_walk_forward")
def class_walk_forward(spark, sf):
    """Forests refitted after 48 and 60 months, their scores by class statistics of the months before."""
    # a row an asset and month: the forests' many passes do not go back to the sales
    rows = stored(labels.return_class(_features(spark, sf)).select("t", "t_idx", "asset", "cls", "ret_fwd", "z1", "z3", "z6", "z9", "z12"))
    p = classes.walk_forward(rows, ["z1", "z3", "z6", "z9", "z12"], [48, 60], 12, models=2, trees=5, depth=3)
    stats = labels.class_statistics(rows.where("t_idx < 47"))
    return labels.scores(p, stats).select("t", "asset", "dpr", "ret", "srp")


@query("boosted_class_strategies")
def boosted_class_strategies(spark, sf):
    """Momentum, the likeliest class, dpr, ret and srp by the probabilities of boosted trees refitted after 48 and 60 months,
    out of sample: the tenth at either end, month by month."""
    names = ["z1", "z3", "z6", "z9", "z12"]
    rows = stored(_labelled(spark, sf).select("year", "t", "t_idx", "asset", "cls", "ret_fwd", *names))
    model = boosting.fit(rows, names, starts=[48, 60], runs=2, rounds=6, depth=3, bins=32, rate=0.3, patience=3)
    traded = rows.where("t_idx >= 48").drop("cls")
    p = traded.join(boosting.probabilities(model, traded), ["t", "asset"]).select("year", "t", "asset", "cls", "p")
    made = labels.strategy_scores(traded, p, labels.yearly_class_statistics(rows, 3), "z12")
    return rounded(labels.extreme_portfolio(made, "score", keys=("t", "strategy")), "t", "strategy", ls="ls")


@query("volatility_chain")
def volatility_chain(spark, sf):
    panel = I.volume_deviation(I.bar_panel(_bars(spark, sf)))
    end = panel.agg(F.expr("percentile_disc(0.6) WITHIN GROUP (ORDER BY unix_date(trade_date))")).first()[0]  # one date
    return statespace.volatility_chain(panel, F.date_from_unix_date(F.lit(int(end or 0))), draws=30, burn=10).select("ticker", "ts", "fixed", "x_t", "h_pred")


@query("fama_macbeth_three")
def fama_macbeth_three(spark, sf):
    df = panels.weekly_returns(spark, sf).withColumn("level", F.log("price"))
    return rounded(G.fama_macbeth(df, "r", ["q", "flow", "level"]), "term", "T", mean="mean", se="se", t_stat="t_stat")
