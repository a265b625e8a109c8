"""Walk-forward studies: periods, their rows, refits by period, and the trading they feed.

Period tables are tiny (a row a period) and joined to panels by their bounds.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quantweave.functions.series import by


def periods(panel: DataFrame, train: int, test: int, look_back: int | None = None) -> DataFrame:
    """(period, train_from, test_from, test_to): tests of `test` periods from t_idx `train` on,
    each trained on all before it or on the last `look_back` periods; bounds as [from, to)."""
    last = panel.agg(F.max("t_idx").alias("last"))
    rows = last.where(F.col("last") >= train).select("last", F.explode(F.sequence(F.lit(0), F.floor((F.col("last") - train) / test).cast("int"))).alias("period"))
    start = F.col("period") * test + train
    return rows.select("period", F.greatest(start - look_back, F.lit(0)).alias("train_from") if look_back else F.lit(0).alias("train_from"), start.cast("long").alias("test_from"), F.least(start + test, F.col("last") + 1).cast("long").alias("test_to"))


def rows_of(panel: DataFrame, spans: DataFrame, part: str) -> DataFrame:
    """The panel's rows in each period's `part`: train or test. A row may be in the training of many periods."""
    low, high = ("train_from", "test_from") if part == "train" else ("test_from", "test_to")
    # one short row a period
    return panel.join(F.broadcast(spans), (F.col("t_idx") >= F.col(low)) & (F.col("t_idx") < F.col(high)))


def ridge(rows: DataFrame, y: str, x: list[str], penalty: float = 1e-4, keys: tuple[str, ...] = ("period",), least: int = 3) -> DataFrame:
    """(keys, term, coef): y on x and an intercept that is not penalised, by key, from rows without nulls.

    The Gram matrix is one aggregation; only its sums, a row a key, are solved in Python."""
    terms = ["const", *x]
    col = lambda c: F.lit(1.0) if c == "const" else F.col(c)
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    sums = [F.sum(col(terms[i]) * col(terms[j])).alias(f"g{i}_{j}") for i, j in pairs] + [F.sum(col(c) * F.col(y)).alias(f"b{i}") for i, c in enumerate(terms)]
    gram = rows.dropna(subset=[y, *x]).groupBy(*keys).agg(F.count("*").alias("n"), *sums).where(F.col("n") >= least)

    def solve(batches):
        for df in batches:
            out = []
            for r in df.to_dict("records"):
                a = np.zeros((len(terms), len(terms)))
                for i, j in pairs:
                    a[i, j] = a[j, i] = r[f"g{i}_{j}"]
                a[np.arange(1, len(terms)), np.arange(1, len(terms))] += penalty
                coef = np.linalg.lstsq(a, [r[f"b{i}"] for i in range(len(terms))], rcond=None)[0]
                out += [{**{k: r[k] for k in keys}, "term": t, "coef": float(c)} for t, c in zip(terms, coef, strict=True)]
            yield pd.DataFrame(out, columns=[*keys, "term", "coef"])

    fields = ", ".join(f"{k} {gram.schema[k].dataType.simpleString()}" for k in keys)
    return gram.mapInPandas(solve, f"{fields}, term string, coef double")


def predict(rows: DataFrame, coefs: DataFrame, x: list[str], keys: tuple[str, ...] = ("period",)) -> DataFrame:
    """`rows` with `signal`, the coefficients' sum over the row; null where a regressor is."""
    wide = coefs.groupBy(*keys).pivot("term", ["const", *x]).agg(F.first("coef"))
    wide = wide.select(*keys, *[F.col(c).alias(f"_{c}") for c in ["const", *x]])
    total = F.col("_const")
    for c in x:
        total = total + F.col(f"_{c}") * F.col(c)
    return rows.join(F.broadcast(wide), list(keys)).withColumn("signal", total).drop(*[f"_{c}" for c in ["const", *x]])


def fitted_signal(panel: DataFrame, spans: DataFrame, y: str, x: list[str], penalty: float = 1e-4) -> DataFrame:
    """Test rows of all periods with the signal of the ridge fit on the period's training rows."""
    coefs = ridge(rows_of(panel, spans, "train"), y, x, penalty)
    return predict(rows_of(panel, spans, "test"), coefs, x)


def positions_pnl(rows: DataFrame, signal: str, sigma: str = "sd", target: float = 0.1, periods_a_year: float = 52, delay: int = 2) -> DataFrame:
    """(t, t_idx, pnl, n): mean over assets of the signal, scaled to the volatility target by the
    sigma of t + delay, times the return of t + delay, stamped t."""
    scale = target / (F.lead(sigma, delay).over(by()) * periods_a_year**0.5 + 1e-10)
    x = F.col(signal) * scale * F.lead("r", delay).over(by())
    return rows.withColumn("_x", x).groupBy("t", "t_idx").agg(F.avg("_x").alias("pnl"), F.count("_x").alias("n")).where("n > 0")


def refit_schedule(panel: DataFrame, every: int) -> DataFrame:
    """(t_idx, fit_idx, assets): the period whose fit is in force: the last multiple of
    `every`, or the last period at which the set of assets with a value changed."""
    there = panel.where("r is not null").groupBy("t_idx").agg(F.xxhash64(F.sort_array(F.collect_set("asset"))).alias("set"), F.count_distinct("asset").alias("assets"))
    run = W.orderBy("t_idx")
    # one row a period
    new = (F.col("t_idx") % every == 0) | (F.col("set") != F.lag("set", 1).over(run)) | F.lag("set", 1).over(run).isNull()
    return there.withColumn("_f", F.when(new, F.col("t_idx"))).select("t_idx", F.last("_f", ignorenulls=True).over(run).alias("fit_idx"), "assets")


def best_of_grid(scores: DataFrame, by_keys: list[str], score: str, least: int = 10, n: str = "n") -> DataFrame:
    """The row of the highest score by key among those with `least` observations; ties to the least parameters."""
    order = W.partitionBy(*by_keys).orderBy(F.desc(score), *[c for c in scores.columns if c not in {*by_keys, score, n}])
    return scores.where(F.col(score).isNotNull() & (F.col(n) >= least)).withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
