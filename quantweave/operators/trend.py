"""Trend features: volatility-scaled momentum, MACD by speeds, oscillators, look-back stacks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quantweave.functions import series as S

from .recursive import _numbers, ewma, fold


def with_ewmas(df: DataFrame, value: str, alphas: dict[str, float], keys=("asset",)) -> DataFrame:
    """One column for each name and alpha, all in one pass over each series."""
    return fold(df, lambda rows: {n: ewma(_numbers(rows[value]), a) for n, a in alphas.items()}, {n: "double" for n in alphas}, keys)


def macd_features(panel: DataFrame, speeds: list[tuple[int, int]], price_window: int, own_window: int, price: str = "price") -> DataFrame:
    """macd_<short> for each (short, long): EWMAs with alpha 1/span apart, over the price's
    deviation, over its own deviation. Rows without a price are left out; half windows do."""
    spans = sorted({x for pair in speeds for x in pair})
    df = with_ewmas(panel.where(F.col(price).isNotNull()), price, {f"_e{x}": 1 / x for x in spans})
    deviation = S.rolling(F.stddev_samp, price, price_window, price_window // 2) + 1e-10
    df = df.withColumns({f"_q{a}": (F.col(f"_e{a}") - F.col(f"_e{b}")) / deviation for a, b in speeds})
    df = df.withColumns({f"macd_{a}": F.col(f"_q{a}") / (S.rolling(F.stddev_samp, f"_q{a}", own_window, own_window // 2) + 1e-10) for a, _ in speeds})
    return df.drop(*[f"_e{x}" for x in spans], *[f"_q{a}" for a, _ in speeds])


def winsorise(df: DataFrame, columns: list[str], halflife: float = 252, k: float = 5.0, least: int | None = None) -> DataFrame:
    """Clips each column to k exponentially weighted deviations around its exponentially weighted mean; as they
    are before `least` values (half the half-life, if not given) and where there is no deviation yet."""
    from .recursive import ew_moments

    alpha, first = 1 - 0.5 ** (1 / halflife), int(halflife // 2) if least is None else least

    def f(rows):
        out = {}
        for c in columns:
            out[f"_m_{c}"], out[f"_s_{c}"] = ew_moments(_numbers(rows[c]), alpha, False, first)
        return out

    df = fold(df, f, {f"{p}_{c}": "double" for c in columns for p in ("_m", "_s")})
    there = lambda c: F.col(f"_s_{c}").isNotNull() & ~F.isnan(f"_s_{c}")
    df = df.withColumns({c: F.when(there(c), S.clip(c, F.col(f"_m_{c}") - k * F.col(f"_s_{c}"), F.col(f"_m_{c}") + k * F.col(f"_s_{c}"))).otherwise(F.col(c)) for c in columns})
    return df.drop(*[f"{p}_{c}" for c in columns for p in ("_m", "_s")])


def oscillators(panel: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 4, 5), value: str = "x") -> DataFrame:
    """osc_<k>: EWMA with alpha 1/2^k less that with 1/(4 2^k), null before 4 2^k values."""
    df = with_ewmas(panel, value, {f"_f{k}": 0.5**k for k in ks} | {f"_s{k}": 0.5**k / 4 for k in ks})
    seen = F.count(value).over(S.by().rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumns({f"osc_{k}": F.when(seen >= 4 * 2**k, F.col(f"_f{k}") - F.col(f"_s{k}")) for k in ks})
    return df.drop(*[f"_{p}{k}" for k in ks for p in "fs"])


def look_back_stack(features: DataFrame, names: list[str], windows: list[int], least: int = 5) -> DataFrame:
    """(win, t_idx, asset): assets whose `windows` rows before t are all there and without a
    null, for dates that have `least` of them; the stack itself is those rows' features."""
    whole = F.when(sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0)) == len(names), 1)
    each = features.select("t_idx", "asset", *[(F.count(whole).over(S.by().rowsBetween(-w, -1)) == w).alias(f"_{w}") for w in windows])
    kinds = F.explode(F.array(*[F.struct(F.lit(w).alias("win"), F.col(f"_{w}").alias("ok")) for w in windows])).alias("k")
    rows = each.select("t_idx", "asset", kinds).where("k.ok").select("k.win", "t_idx", "asset")
    return rows.withColumn("_n", F.count("*").over(W.partitionBy("win", "t_idx"))).where(F.col("_n") >= least).drop("_n")


def stacked(features: DataFrame, names: list[str], stack: DataFrame) -> DataFrame:
    """(win, t, asset, k, v): the stack's features as long vectors, component k of the window and feature."""
    long = features.select("t_idx", "asset", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(n).alias("v")) for i, n in enumerate(names)])).alias("x")).select(F.col("t_idx").alias("s"), "asset", "x.f", "x.v")
    days = stack.select("win", F.col("t_idx").alias("t"), "asset", F.explode(F.sequence(F.lit(1), F.col("win"))).alias("lag")).withColumn("s", F.col("t") - F.col("lag"))
    return days.join(long, ["asset", "s"]).select("win", "t", "asset", (F.col("lag") * len(names) + F.col("f")).alias("k"), "v")


def with_derivative(df: DataFrame, value: str, out: str, keys=("asset",)) -> DataFrame:
    """Mean of the step before and half the step over both neighbours; the ends have their one step."""
    run = S.by(*keys)
    before, after = F.lag(value).over(run), F.lead(value).over(run)
    step = F.col(value) - before
    return df.withColumn(out, F.when(before.isNull(), after - F.col(value)).when(after.isNull(), step).otherwise((step + (after - before) / 2) / 2))


def with_shape(df: DataFrame, value: str, out: str, window: int = 5, keys=("asset",)) -> DataFrame:
    """The `window` values around each, the ends repeated beyond the series, standardised within the window."""
    half = window // 2
    run = S.by(*keys)
    whole = W.partitionBy(*keys).orderBy("t_idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = {-1: F.first(value).over(whole), 1: F.last(value).over(whole)}
    df = df.withColumn("_a", F.array(*[F.coalesce(F.lag(value, -j).over(run) if j < 0 else F.lead(value, j).over(run), ends[1 if j > 0 else -1]) for j in range(-half, half + 1)]))
    mean = F.aggregate("_a", F.lit(0.0), lambda s, x: s + x) / window
    df = df.withColumn("_m", mean)
    df = df.withColumn("_s", F.sqrt(F.aggregate("_a", F.lit(0.0), lambda s, x: s + (x - F.col("_m")) * (x - F.col("_m"))) / window))
    return df.withColumn(out, F.transform("_a", lambda x: (x - F.col("_m")) / (F.col("_s") + 1e-10))).drop("_a", "_m", "_s")
