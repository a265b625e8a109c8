"""All pairs of parameters of the sparse graph at once.

The graph's weight of a pair of assets is max(m - alpha / 2, 0) / (1 + beta), m the mean score of both
directions: linear in alpha between the scores, and beta only scales it. So one sort of the edges by m, with
running counts and sums, gives every node's degree for all alphas; betas are elements of arrays. Nothing is
built a pair of parameters at a time.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quantweave.functions import series as S


def breakpoints(scores: DataFrame) -> DataFrame:
    """(win, i, j, m), m > 0: half the scores' positive parts in both directions; of scores (win, i, j, score)."""
    one = scores.select("win", "i", "j", F.greatest("score", F.lit(0.0)).alias("a"))
    back = one.select("win", F.col("j").alias("i"), F.col("i").alias("j"), F.col("a").alias("b"))
    both = one.join(back, ["win", "i", "j"], "full").where("i <> j")
    return both.select("win", "i", "j", ((F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))) / 2).alias("m")).where("m > 0")


def degrees(edges: DataFrame, nodes: DataFrame, windows: int, alphas: list[float]) -> DataFrame:
    """(i, alpha, d): the sum of (m - alpha / 2) over a node's edges above alpha / 2, by `windows`; 0 without any.

    `nodes` (i). Each alpha is a mark among the node's edges in the order of m; what runs up to it are sums."""
    at = F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha")
    marks = nodes.select("i", at).select("i", "alpha", (F.col("alpha") / 2).alias("m"))
    rows = edges.select("i", F.lit(None).cast("double").alias("alpha"), "m").union(marks)
    # edges of m = alpha / 2 weigh nothing, so their place does not matter
    run = W.partitionBy("i").orderBy(F.desc("m")).rowsBetween(W.unboundedPreceding, 0)
    edge = F.col("alpha").isNull()
    sums = rows.withColumns({"_s": F.sum(F.when(edge, F.col("m")).otherwise(0.0)).over(run), "_n": F.sum(edge.cast("long")).over(run)})
    return sums.where("alpha is not null").select("i", "alpha", ((F.col("_s") - F.col("alpha") / 2 * F.col("_n")) / windows).alias("d"))


def search(scores: DataFrame, rows: DataFrame, alphas: list[float], betas: list[float], values: list[str], target: float = 0.1, periods: float = 252, delay: int = 2, least: int = 20) -> DataFrame:
    """(alpha, beta, n, sharpe, best) of trading `values` as the neighbours have them.

    `scores` (win, i, j, score) give the mean graph over the windows, each with a self loop of weight 1, normalised
    by both degrees. `rows` (t_idx, asset, values, sd, r): the response to each spread value, scaled to the
    volatility target, averaged, and over the number of assets, earns the return `delay` periods on. Assets outside
    the scores take no part. A pair with fewer than `least` periods has no sharpe; of equal ones the first is best.
    """
    edges = breakpoints(scores)
    nodes = scores.select("i").union(scores.select("j")).distinct()
    windows = scores.agg(F.count_distinct("win")).first()[0] or 1  # one number
    roots = F.array(*[F.sqrt(1 + F.col("d") / (1 + b)) for b in betas])
    degree = degrees(edges, nodes, windows, alphas).select("i", "alpha", roots.alias("root"))
    # a pair of assets is one row, its weights by alpha an array until they meet the values
    weights = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), (F.sum(F.greatest(F.col("m") - a / 2, F.lit(0.0))) / windows).alias("w")) for a in alphas])
    pairs = edges.groupBy("i", "j").agg(weights.alias("k")).select("i", "j", F.explode("k").alias("k")).select("i", "j", "k.alpha", "k.w").where("w > 0")
    daily = rows.select("t_idx", F.col("asset").alias("j"), *values)
    theirs = degree.withColumnRenamed("i", "j").withColumnRenamed("root", "other")
    near = pairs.join(theirs, ["j", "alpha"]).join(daily, "j")
    each = [(b, v) for b in range(len(betas)) for v in values]
    net = near.groupBy("t_idx", "alpha", "i").agg(F.array(*[F.sum(F.col("w") / F.col("other")[b] * F.col(v)) for b, v in each]).alias("net"))
    run = S.by()
    own = rows.select("t_idx", F.col("asset").alias("i"), *values, (target / (F.col("sd") * periods**0.5 + 1e-10)).alias("_scale"), F.lead("r", delay).over(run).alias("_r"), F.lead(F.lit(True), delay).over(run).alias("_there"))
    every = own.join(degree, "i").join(net, ["t_idx", "alpha", "i"], "left")
    many = nodes.count()  # one number

    def position(b: int) -> Column:
        total = F.lit(0.0)
        for v in values:
            x = F.col(v) / (F.col("root")[b] * F.col("root")[b]) + F.coalesce(F.get("net", F.lit(each.index((b, v)))), F.lit(0.0)) / (1 + betas[b]) / F.col("root")[b]
            total = total + S.response(x)
        return total / len(values) * F.col("_scale") / max(many, 1)

    paid = every.where("_there").groupBy("t_idx", "alpha").agg(*[F.sum(position(b) * F.col("_r")).alias(f"p{b}") for b in range(len(betas))])
    long = paid.select("alpha", F.explode(F.array(*[F.struct(F.lit(float(x)).alias("beta"), F.col(f"p{b}").alias("p")) for b, x in enumerate(betas)])).alias("k")).select("alpha", "k.beta", "k.p")
    out = long.groupBy("alpha", "beta").agg(F.count("p").alias("n"), (F.avg("p") / (F.stddev_samp("p") + 1e-12) * periods**0.5).alias("sharpe")).withColumn("sharpe", F.when(F.col("n") >= least, F.col("sharpe")))
    # a row a pair of parameters
    best = F.row_number().over(W.orderBy(F.desc_nulls_last(F.round("sharpe", 8)), "alpha", "beta")) == 1
    return out.withColumn("best", best & F.col("sharpe").isNotNull())
