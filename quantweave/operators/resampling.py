"""Block bootstrap of panels and tests of paired results."""

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def draw(low_below: Column, *parts: Column) -> Column:
    """A whole number from 0 to below `low_below`, by a hash of the parts: the same on every run and machine."""
    text = F.concat_ws("-", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % low_below


def block_index(periods: DataFrame, block: int, samples: int, seed: int = 42) -> DataFrame:
    """(sample, pos, t_idx): circular blocks of `block` periods from drawn starts, laid out to the
    length of the calendar (t_idx from 0). A row a sample and period: no values are copied."""
    n = periods.agg(F.count_distinct("t_idx").alias("n")).where("n > 0")
    rows = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")).select("n", "sample", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("pos"))
    start = draw(F.col("n"), F.lit(seed), F.col("sample"), F.floor(F.col("pos") / block))
    return rows.select("sample", "pos", ((start + F.col("pos") % block) % F.col("n")).alias("t_idx"))


def resample(panel: DataFrame, index: DataFrame) -> DataFrame:
    """The panel's rows at each sample's periods; `t_idx` is the sample's own calendar."""
    return index.join(panel, "t_idx").drop("t_idx").withColumnRenamed("pos", "t_idx")


def rebuild_prices(panel: DataFrame, start: float = 100.0, r: str = "r", keys: tuple[str, ...] = ("sample", "asset")) -> DataFrame:
    """price: start times exp of the log returns so far, nulls as 0."""
    run = W.partitionBy(*keys).orderBy("t_idx").rowsBetween(W.unboundedPreceding, 0)
    return panel.withColumn("price", start * F.exp(F.sum(F.coalesce(r, F.lit(0.0))).over(run)))


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def wilcoxon_tail(w: float, n: int, ties: float) -> float:
    """P(W+ >= w) for n differences: exactly up to 50 without ties, else by the normal law; `ties` is the sum of t^3 - t."""
    if n == 0:
        return math.nan
    if n <= 50 and ties == 0:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for k in range(1, n + 1):
            ways[k:] += ways[:-k].copy()
        return float(ways[int(math.ceil(w)) :].sum() / 2.0**n)
    return _normal_tail((w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48))


def ks_tail(d: float, n: int, m: int) -> float:
    """P(D+ >= d) of two samples: exactly for equal sizes (paths that reach a line), else by the law's limit."""
    if not n or not m or d <= 0:
        return 1.0
    if n == m:
        h = round(d * n)
        return math.exp(2 * math.lgamma(n + 1) - math.lgamma(n - h + 1) - math.lgamma(n + h + 1))
    return min(1.0, math.exp(-2 * d * d * n * m / (n + m)))


def _with_tails(rows: DataFrame, out: str, f, *columns: str) -> DataFrame:
    """A column of f over columns, for a table of one row a strategy."""

    def task(batches):
        for df in batches:
            yield df.assign(**{out: [float(f(*(r[c] for c in columns))) for r in df.to_dict("records")]})

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(task, f"{fields}, {out} double")


def wilcoxon(pairs: DataFrame, a: str, b: str, key: str = "strategy") -> DataFrame:
    """(key, w_stat, w_n, w_p): whether a exceeds b over the pairs; differences of 0 are left out."""
    d = pairs.select(key, (F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("s", F.abs("d"))
    same = W.partitionBy(key, "s")
    ranked = d.withColumn("k", F.count("*").over(same)).withColumn("rank", F.rank().over(W.partitionBy(key).orderBy("s")) + (F.col("k") - 1) / 2)
    sums = ranked.groupBy(key).agg(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_stat"), F.count("*").alias("w_n"), F.sum((F.col("k") * F.col("k") - 1).cast("double")).alias("ties"))
    return _with_tails(sums, "w_p", lambda w, n, ties: wilcoxon_tail(w, int(n), ties), "w_stat", "w_n", "ties").drop("ties")


def ks(pairs: DataFrame, a: str, b: str, key: str = "strategy") -> DataFrame:
    """(key, ks_stat, ks_p): how far the distribution of b runs above that of a."""
    both = pairs.select(key, F.explode(F.array(F.struct(F.col(a).alias("v"), F.lit(1).alias("own")), F.struct(F.col(b).alias("v"), F.lit(0).alias("own")))).alias("x")).select(key, "x.*").where("v is not null")
    at = both.groupBy(key, "v").agg(F.sum("own").alias("a"), F.sum(1 - F.col("own")).alias("b"))
    run, whole = W.partitionBy(key).orderBy("v"), W.partitionBy(key)
    gap = at.withColumn("gap", F.sum("b").over(run) / F.sum("b").over(whole) - F.sum("a").over(run) / F.sum("a").over(whole))
    sums = gap.groupBy(key).agg(F.greatest(F.max("gap"), F.lit(0.0)).alias("ks_stat"), F.sum("a").alias("n"), F.sum("b").alias("m"))
    return _with_tails(sums, "ks_p", lambda d, n, m: ks_tail(d, int(n), int(m)), "ks_stat", "n", "m").drop("n", "m")


def significance(results: DataFrame, baseline: str, value: str = "sharpe") -> DataFrame:
    """One row a strategy beside the baseline, from (sample, strategy, value): means and both tests."""
    base = results.where(F.col("strategy") == baseline).select("sample", F.col(value).alias("base"))
    pairs = results.where(F.col("strategy") != baseline).join(base, "sample")
    means = pairs.groupBy("strategy").agg(F.avg(value).alias("mean"), F.avg("base").alias("base_mean"))
    out = means.join(wilcoxon(pairs, value, "base"), "strategy").join(ks(pairs, value, "base"), "strategy")
    return out.withColumn("significant", (F.col("w_p") < 0.05) & (F.col("ks_p") < 0.05))


def compare(samples: DataFrame, r: str = "r", periods: float = 12) -> DataFrame:
    """(sample, strategy, sharpe) of many samples' strategy returns in one job."""
    from .performance import sharpe

    return samples.groupBy("sample", "strategy").agg(sharpe(r, periods).alias("sharpe"))
