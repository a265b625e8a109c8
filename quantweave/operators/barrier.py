"""Graphs learnt from smooth signals with a log barrier on degrees, one small graph a group."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def barrier_graph(distances: np.ndarray, alpha: float, beta: float, steps: int = 5000, close: float = 1e-7) -> np.ndarray:
    """Symmetric A >= 0 with an empty diagonal that minimises sum A D / 2 - alpha sum log degrees + beta |A|^2.

    Over the weights of pairs: projected gradient steps with a spectral step length,
    halved until the objective falls; the barrier keeps all degrees above 0."""
    n = len(distances)
    a, b = np.triu_indices(n, 1)
    d = distances[a, b]

    def degrees(w):
        return np.bincount(a, w, n) + np.bincount(b, w, n)

    def value(w):
        deg = degrees(w)
        return d @ w - alpha * np.log(deg).sum() + 2 * beta * (w @ w) if (deg > 0).all() else np.inf

    def slope(w):
        inverse = 1 / degrees(w)
        return d - alpha * (inverse[a] + inverse[b]) + 4 * beta * w

    w = np.full(len(d), alpha / (max(d.mean(), 1e-6) * max(n - 1, 1)) + 1e-6)
    now, g, length = value(w), slope(w), 1e-3
    for _ in range(steps):
        while True:
            new = np.maximum(w - length * g, 0)
            move = new - w
            then = value(new)
            if then <= now + 1e-4 * (g @ move) or length < 1e-14:
                break
            length /= 2
        g2 = slope(new) if np.isfinite(then) else g
        bend = float(move @ (g2 - g))
        length = float(move @ move) / bend if bend > 1e-18 else length * 2
        done = np.abs(move).max() < close * min(1.0, length)
        if np.isfinite(then):
            w, now, g = new, then, g2
        if done:
            break
    out = np.zeros((n, n))
    out[a, b] = out[b, a] = w
    return out


def barrier_graphs(vectors: DataFrame, alpha: float, beta: float, keys: tuple[str, ...] = ("t",)) -> DataFrame:
    """(keys, i, j, w) from long vectors (keys, asset, k, v): squared distances by joins, one solve a key.

    A group holds the distances of one date's assets, their number squared."""
    one = lambda n: vectors.select(*keys, "k", F.col("asset").alias(n), F.col("v").alias(f"v{n}"))
    gap = F.col("vi") - F.col("vj")
    far = one("i").join(one("j"), [*keys, "k"]).where("i < j").groupBy(*keys, "i", "j").agg(F.sum(gap * gap).alias("d"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in far.select(*keys, "i", "j").schema.fields)

    def task(key, df: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*df["i"], *df["j"]})
        place = {n: k for k, n in enumerate(names)}
        d = np.zeros((len(names), len(names)))
        d[df["i"].map(place), df["j"].map(place)] = df["d"]
        w = barrier_graph(d + d.T, alpha, beta)
        i, j = np.nonzero(w > 1e-9)
        return pd.DataFrame([[*key, names[x], names[y], w[x, y]] for x, y in zip(i, j, strict=True)], columns=[*keys, "i", "j", "w"])

    return far.groupBy(*keys).applyInPandas(task, f"{fields}, w double")


def grid_graphs(vectors: DataFrame, alphas: list[float], betas: list[float], keys: tuple[str, ...] = ("t",)) -> DataFrame:
    """The graphs of all pairs of parameters, (keys, alpha, beta, i, j, w), as rows of one job."""
    made = None
    for a in alphas:
        for b in betas:
            one = barrier_graphs(vectors, a, b, keys).select(*keys, F.lit(float(a)).alias("alpha"), F.lit(float(b)).alias("beta"), "i", "j", "w")
            made = one if made is None else made.union(one)
    return made
