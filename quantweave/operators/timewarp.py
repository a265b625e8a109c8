"""Lags by dynamic time warping: many pairs of series at a time.

A pair is a row with both series as arrays, so pairs are dealt over all tasks
like any rows; a task warps its pairs of equal lengths together, one
anti-diagonal of all their cost tables after the other.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trend import with_derivative, with_shape

#: Cells of cost tables that a task holds.
CELLS = 1 << 21


def warp_lags(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Commonest j - i on the cheapest warping path of each pair, the smallest of ties.

    x is (pairs, n, size), y (pairs, m, size); the cost is the squared distance.
    Of equally cheap ways back the one that moves i alone comes first, then j alone."""
    pairs, n, m = len(x), x.shape[1], y.shape[1]
    cost = ((x[:, :, None, :] - y[:, None, :, :]) ** 2).sum(3)
    total = np.full((pairs, n + 1, m + 1), np.inf)
    total[:, 0, 0] = 0.0
    for diagonal in range(2, n + m + 1):
        i = np.arange(max(1, diagonal - m), min(n, diagonal - 1) + 1)
        j = diagonal - i
        way = np.minimum(np.minimum(total[:, i - 1, j], total[:, i, j - 1]), total[:, i - 1, j - 1])
        total[:, i, j] = cost[:, i - 1, j - 1] + way
    counts = np.zeros((pairs, n + m + 1), np.int64)
    row, i, j = np.arange(pairs), np.full(pairs, n), np.full(pairs, m)
    while True:
        on = (i > 0) & (j > 0)
        if not on.any():
            break
        counts[row[on], (j - i + n)[on]] += 1
        up, left, both = total[row, i - 1, j], total[row, i, j - 1], total[row, i - 1, j - 1]
        alone_i = (up <= left) & (up <= both)
        alone_j = ~alone_i & (left <= both)
        i, j = np.where(on & ~alone_j, i - 1, i), np.where(on & ~alone_i, j - 1, j)
    return counts.argmax(1) - n


def pair_lags(series: DataFrame, keys: tuple[str, ...] = ("win",)) -> DataFrame:
    """(keys, i, j, lag) of all pairs i < j of `series` (keys, asset, x array of arrays); a positive lag: i leads."""
    one = lambda n, v: series.select(*keys, F.col("asset").alias(n), F.col("x").alias(v))
    pairs = one("i", "x").join(one("j", "y"), list(keys)).where("i < j")

    def task(batches):
        for df in batches:
            lags = np.zeros(len(df), np.int64)
            size = [(len(a), len(b)) for a, b in zip(df["x"], df["y"], strict=True)]
            for n, m in set(size):
                at = np.array([k for k, s in enumerate(size) if s == (n, m)])
                step = max(1, CELLS // max(n * m, 1))
                for a in range(0, len(at), step):
                    own = at[a : a + step]
                    x, y = (np.array([[list(p) for p in df[c].iloc[k]] for k in own], float) for c in ("x", "y"))
                    lags[own] = warp_lags(x, y) if n and m else 0
            yield df[[*keys, "i", "j"]].assign(lag=lags)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*keys, "i", "j").schema.fields)
    return pairs.mapInPandas(task, f"{fields}, lag long")


def lag_matrix(rows: DataFrame, method: str = "dtw", shape: int = 5, keys: tuple[str, ...] = ("win",), least: int = 5) -> DataFrame:
    """(keys, i, j, lag) in both directions from (keys, t_idx, asset, v): values over their
    window's deviation, warped as they are (dtw), by derivative (ddtw), shape (sdtw) or the
    shape of derivatives (sddtw). Series with fewer than `least` values have no rows."""
    series = (*keys, "asset")
    df = rows.where("v is not null")
    stats = df.groupBy(*series).agg(F.stddev_samp("v").alias("_sd"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    df = df.join(stats, list(series)).withColumn("v", F.col("v") / (F.col("_sd") + 1e-10))
    if method in ("ddtw", "sddtw"):
        df = with_derivative(df, "v", "v", series)
    df = with_shape(df, "v", "p", shape, series) if method in ("sdtw", "sddtw") else df.withColumn("p", F.array("v"))
    if method not in ("dtw", "ddtw", "sdtw", "sddtw"):
        raise ValueError(f"no such method: {method}")
    arrays = df.groupBy(*series).agg(F.array_sort(F.collect_list(F.struct("t_idx", "p"))).alias("x")).withColumn("x", F.col("x.p"))
    one = pair_lags(arrays, keys)
    ways = F.explode(F.array(F.struct("i", "j", "lag"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("lag")).alias("lag")))).alias("w")
    return one.select(*keys, ways).select(*keys, "w.i", "w.j", "w.lag")


def windows_of(rows: DataFrame, lengths: list[int], end: int) -> DataFrame:
    """`rows` (t_idx, asset, v) once for each length: the periods before `end`, as window `win`."""
    win = F.explode(F.array(*[F.lit(n) for n in lengths])).alias("win")
    return rows.where(F.col("t_idx") < end).select("*", win).where(F.col("t_idx") >= end - F.col("win"))


def ensemble_lags(rows: DataFrame, lengths: list[int], end: int, method: str = "dtw") -> DataFrame:
    """(i, j, lag): mean over windows of several lengths; a window without the pair counts 0."""
    each = lag_matrix(windows_of(rows, lengths, end), method)
    return each.groupBy("i", "j").agg((F.sum("lag") / len(lengths)).alias("lag"))
