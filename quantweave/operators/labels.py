"""Cross-sectional features, return classes and class-probability scores by month."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quantweave.functions.series import average_rank, by, quantile_bucket, rolling

WINDOWS = (1, 3, 6, 9, 12)


def momentum(months: int) -> Column:
    """The last return, or the compounded returns of the months before it, all of them there or 0."""
    if months == 1:
        return F.col("r")
    value = F.log1p(F.coalesce("r", F.lit(0.0)))
    return F.exp(rolling(F.sum, value, months - 1, end=-1)) - 1


def size_proxy(start: float = 100.0) -> Column:
    """Compounded value of an asset, a missing return as 0."""
    return start * F.exp(F.sum(F.log1p(F.coalesce("r", F.lit(0.0)))).over(by().rowsBetween(W.unboundedPreceding, 0)))


def features(panel: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """t, asset, z*, m*, s* for each window, size (decile), ret_fwd.

    A month needs 5 values in every window; size needs 10 assets."""
    at = W.partitionBy("t")
    rows = panel.withColumns({f"x{m}": momentum(m) for m in windows} | {"cap_proxy": size_proxy(), "ret_fwd": F.lead("r").over(by())})
    for m in windows:
        rows = rows.withColumns({f"m{m}": F.avg(f"x{m}").over(at), f"s{m}": F.stddev_samp(f"x{m}").over(at), f"n{m}": F.count(f"x{m}").over(at)})
    rank = average_rank("cap_proxy", "t")
    rows = rows.withColumn("size", F.when(F.count("cap_proxy").over(at) >= 10, F.least(F.greatest(F.ceil(10 * rank / F.count("cap_proxy").over(at)), F.lit(1)), F.lit(10)).cast("int")))
    whole = F.lit(True)
    for m in windows:
        whole &= (F.col(f"n{m}") >= 5) & F.col(f"x{m}").isNotNull()
    z = {f"z{m}": F.when(F.col(f"s{m}") > 1e-8, (F.col(f"x{m}") - F.col(f"m{m}")) / F.col(f"s{m}")).otherwise(F.col(f"x{m}") * 0.0) for m in windows}
    rows = rows.where(whole & F.col("size").isNotNull()).withColumns(z)
    return rows.select("t", "t_idx", "asset", *[f"{k}{m}" for k in "zms" for m in windows], "size", "ret_fwd")


def return_class(panel: DataFrame, value: str = "ret_fwd", classes: int = 10) -> DataFrame:
    return panel.where(F.col(value).isNotNull()).withColumn("cls", quantile_bucket(value, classes, "t").cast("int"))


def class_statistics(labelled: DataFrame, classes: int = 10) -> DataFrame:
    """cls, mu, sigma of the return in each class; (0, 1) for classes with 5 values or fewer."""
    every = labelled.sparkSession.range(classes).select(F.col("id").cast("int").alias("cls"))
    stats = labelled.groupBy("cls").agg(F.count("ret_fwd").alias("n"), F.avg("ret_fwd").alias("mu"), F.stddev_samp("ret_fwd").alias("sigma")).where("n > 5")
    return every.join(stats, "cls", "left").select("cls", F.coalesce("mu", F.lit(0.0)).alias("mu"), F.coalesce("sigma", F.lit(1.0)).alias("sigma"))


def yearly_class_statistics(labelled: DataFrame, years: int = 10, classes: int = 10, least: int = 6) -> DataFrame:
    """(year, cls, mu, sigma) from the `years` years before each year that occurs; (0, 1) for a class with fewer
    than `least` values in them.

    Counts, sums and squares are taken once by year and class and added up over a range of years, so no row is
    in more than one sum. `year` is a column of `labelled`; null returns count nothing.
    """
    x = F.col("ret_fwd")
    sums = {"_n": F.count(x), "_s": F.sum(x), "_q": F.sum(x * x)}
    own = labelled.groupBy("year", "cls").agg(*[v.alias(k) for k, v in sums.items()])
    # years and classes are dimensions
    every = labelled.select("year").distinct().withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    before = W.partitionBy("cls").orderBy("year").rangeBetween(-years, -1)
    rows = every.join(own, ["year", "cls"], "left").select("year", "cls", *[F.sum(k).over(before).alias(k) for k in sums])
    enough, mean = F.col("_n") >= least, F.col("_s") / F.col("_n")
    variance = (F.col("_q") - F.col("_s") * mean) / (F.col("_n") - 1)
    return rows.select("year", "cls", F.when(enough, mean).otherwise(0.0).alias("mu"), F.when(enough, F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(1.0).alias("sigma"))


def past_frequencies(labelled: DataFrame, bucket: str, classes: int = 10) -> DataFrame:
    """(year, bucket, cls, p): how often each class came up in all years before, in rows of the same bucket, with
    one row of each class added; for every year and bucket that occur."""
    own = labelled.groupBy("year", bucket, "cls").agg(F.count("*").alias("_n"))
    # years, buckets and classes are dimensions
    every = labelled.select("year").distinct().crossJoin(labelled.select(bucket).distinct()).withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    before = W.partitionBy(bucket, "cls").orderBy("year").rowsBetween(W.unboundedPreceding, -1)
    rows = every.join(own, ["year", bucket, "cls"], "left").withColumn("_n", F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1)
    return rows.withColumn("p", F.col("_n") / F.sum("_n").over(W.partitionBy("year", bucket))).drop("_n")


def strategy_scores(rows: DataFrame, probabilities: DataFrame, stats: DataFrame, momentum: str, classes: int = 10, digits: int = 10) -> DataFrame:
    """(t, asset, ret_fwd, strategy, score) of five strategies: `momentum`, the likeliest class (`class`, the
    lowest of equals), and dpr, ret and srp by the year's statistics. `rows`: year, t, asset, ret_fwd, momentum;
    `probabilities`: year, t, asset, cls, p. Scores are rounded, so that equal ones tie whatever their sum's order."""
    each = scores(probabilities, stats, classes, on=("year", "cls"))
    likeliest = probabilities.groupBy("t", "asset").agg(F.max_by("cls", F.struct("p", -F.col("cls"))).cast("double").alias("class"))
    wide = rows.select("t", "asset", "ret_fwd", F.col(momentum).alias("momentum")).join(each, ["t", "asset"]).join(likeliest, ["t", "asset"])
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), F.round(F.col(k), digits).alias("score")) for k in ("momentum", "class", "dpr", "ret", "srp")])).alias("k")
    return wide.select("t", "asset", "ret_fwd", kinds).select("t", "asset", "ret_fwd", "k.strategy", "k.score")


def scores(probabilities: DataFrame, stats: DataFrame, classes: int = 10, legacy_sign: bool = False, on: tuple[str, ...] = ("cls",)) -> DataFrame:
    """dpr, ret and srp of (t, asset, cls, p): weighted probability differences, expected return, and that over its
    deviation. `on`: the columns that tell the class's statistics."""
    half = classes // 2
    k = F.least(F.col("cls"), classes - 1 - F.col("cls")) + 1
    weight = (classes + 1 - k) / 2 * F.when(F.col("cls") < half, -1.0).otherwise(1.0)
    if legacy_sign:
        weight = -weight
    rows = probabilities.join(stats, list(on))
    mu = F.sum(F.col("p") * F.col("mu"))
    var = F.greatest(F.sum(F.col("p") * (F.col("sigma") * F.col("sigma") + F.col("mu") * F.col("mu"))) - mu * mu, F.lit(1e-12))
    return rows.groupBy("t", "asset").agg(F.sum(F.col("p") * weight).alias("dpr"), mu.alias("ret"), (mu / F.sqrt(var)).alias("srp"))


def bimodality(rows: DataFrame, classes: int = 10) -> DataFrame:
    """By date, how often predicted winners and others among the extreme classes turn out the other way."""
    top, low = F.col("true_cls") == classes - 1, F.col("true_cls") == 0
    picked = F.col("pred_cls") == classes - 1
    c = rows.groupBy("t").agg(F.count_if(picked & top).alias("tp"), F.count_if(picked & low).alias("fp"), F.count_if(~picked & low).alias("tn"), F.count_if(~picked & top).alias("fn"))

    def share(a: str, b: str) -> Column:
        return F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)) - 0.1).otherwise(0.0)

    return c.select("t", (-((share("tp", "fp") - share("fp", "tp")) + (share("tn", "fn") - share("fn", "tn"))) / 2).alias("bm"))


def extreme_portfolio(rows: DataFrame, score: str, share: float = 0.1, future: str = "ret_fwd", keys: tuple[str, ...] = ("t",)) -> DataFrame:
    """(keys, ls): mean future return of the highest less the lowest ceil(n share) assets, one at least; null legs leave a null."""
    at = W.partitionBy(*keys)
    rows = rows.where(F.col(score).isNotNull())
    k = F.greatest(F.ceil(F.count("*").over(at) * share), F.lit(1))
    rows = rows.withColumns({"hi": F.row_number().over(at.orderBy(F.desc(score), "asset")), "lo": F.row_number().over(at.orderBy(score, "asset")), "k": k})
    return rows.groupBy(*keys).agg((F.avg(F.when(F.col("hi") <= F.col("k"), F.col(future))) - F.avg(F.when(F.col("lo") <= F.col("k"), F.col(future)))).alias("ls"))
