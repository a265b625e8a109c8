"""First-order recursions over a series: one pass in the order of `t_idx`.

Spark has no scan expression, so each series is folded in a grouped map. A group
is one asset's (or one asset's and parameter's) series: its length is that of the
calendar and does not grow with the number of assets.
"""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Fold = Callable[[pd.DataFrame], dict[str, np.ndarray]]


def fold(df: DataFrame, f: Fold, new: dict[str, str], keys: tuple[str, ...] = ("asset",), order: str = "t_idx") -> DataFrame:
    """`df` with the columns of `new` (name: type), f's arrays over each sorted group."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in new.items())])

    def task(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        return rows.assign(**f(rows))

    return df.groupBy(*keys).applyInPandas(task, schema)


def _numbers(x) -> np.ndarray:
    return pd.to_numeric(x, errors="coerce").to_numpy(float)


def ewma(x: np.ndarray, alpha: float) -> np.ndarray:
    """y = (1 - alpha) y + alpha x from the first value on; nulls carry y."""
    out, y = np.full(len(x), np.nan), np.nan
    for i, v in enumerate(x):
        if not np.isnan(v):
            y = v if np.isnan(y) else (1 - alpha) * y + alpha * v
        out[i] = y
    return out


def ew_moments(x: np.ndarray, alpha: float, adjusted: bool, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Exponentially weighted mean and unbiased standard deviation, from sums of w, w^2, w x and w x^2.

    Every row, a gap too, ages all weights. A new value weighs 1 if `adjusted`, else alpha against all before
    it, whose weights come to 1. Null below `least` values, the deviation below two."""
    there = ~np.isnan(x)
    mean_out, std_out = np.full(len(x), np.nan), np.full(len(x), np.nan)
    base = x[there][0] if there.any() else 0.0  # sums of distances from it lose fewer digits
    sums, ageing = np.zeros(4), (1 - alpha) ** np.array([1, 2, 1, 1])
    seen = 0
    for i, v in enumerate(x):
        sums *= ageing
        if there[i]:
            fresh, d = 1.0 if adjusted or not seen else alpha, v - base
            sums += (fresh, fresh * fresh, fresh * d, fresh * d * d)
            if not adjusted:
                sums /= sums[0] ** np.array([1, 2, 1, 1])
            seen += 1
        if seen and seen >= least:
            w, w2, wx, wxx = sums
            mean_out[i] = base + wx / w
            if seen > 1 and w * w > w2:
                std_out[i] = np.sqrt(max(wxx / w - (wx / w) ** 2, 0.0) * w * w / (w * w - w2))
    return mean_out, std_out


def threshold_state(z: np.ndarray, enter: float, leave: float) -> np.ndarray:
    """-1 at z > enter, +1 at z < -enter, from flat only; a long ends at z > -leave,
    a short at z < leave. A null gives 0 and changes no state."""
    out, state = np.zeros(len(z), np.int64), 0
    for i, v in enumerate(z):
        if np.isnan(v):
            continue
        if state == 0:
            state = -1 if v > enter else 1 if v < -enter else 0
        elif state == 1 and v > -leave or state == -1 and v < leave:
            state = 0
        out[i] = state
    return out


def hold(target: np.ndarray, bars: int) -> np.ndarray:
    """Follows the target, but changes only `bars` bars after the last change; a null gives 0."""
    out, now, age = np.zeros(len(target)), 0.0, bars
    for i, v in enumerate(target):
        if np.isnan(v):
            age += 1
            continue
        if v != now and age >= bars:
            now, age = v, 0
        age += 1
        out[i] = now
    return out


def garch(r: np.ndarray, omega: float, a: float, b: float, start: float | None = None, first: int = 21) -> np.ndarray:
    """h_t = omega + a r_{t-1}^2 + b h_{t-1}; h_0 is the variance of the first returns."""
    r = np.nan_to_num(r)
    h = np.empty(len(r))
    for i in range(len(r)):
        h[i] = (start if start is not None else r[:first].var() if len(r) > first else 1e-4) if i == 0 else omega + a * r[i - 1] ** 2 + b * h[i - 1]
    return h


def kalman(y: np.ndarray, x: np.ndarray, q: float, r: float, beta: float = 0.0, p: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Random-walk slope of y on x: the slope after each row and the residual by it."""
    slopes, rest = np.full(len(y), np.nan), np.full(len(y), np.nan)
    for i in range(len(y)):
        p += q
        if not (np.isnan(y[i]) or np.isnan(x[i])):
            gain = p * x[i] / (x[i] * p * x[i] + r)
            beta += gain * (y[i] - x[i] * beta)
            p *= 1 - gain * x[i]
            rest[i] = y[i] - x[i] * beta
        slopes[i] = beta
    return slopes, rest


def with_ewma(df: DataFrame, value: str, out: str, alpha: float, keys=("asset",)) -> DataFrame:
    return fold(df, lambda rows: {out: ewma(_numbers(rows[value]), alpha)}, {out: "double"}, keys)


def with_ew_moments(df: DataFrame, value: str, mean: str, std: str, alpha: float, adjusted: bool, least: int, keys=("asset",)) -> DataFrame:
    def f(rows):
        m, s = ew_moments(_numbers(rows[value]), alpha, adjusted, least)
        return {mean: m, std: s}

    return fold(df, f, {mean: "double", std: "double"}, keys)


def with_state(df: DataFrame, z: str, out: str, enter: float, leave: float, keys=("asset",)) -> DataFrame:
    return fold(df, lambda rows: {out: threshold_state(_numbers(rows[z]), enter, leave)}, {out: "long"}, keys)


def with_hold(df: DataFrame, target: str, out: str, bars: int, keys=("asset",)) -> DataFrame:
    return fold(df, lambda rows: {out: hold(_numbers(rows[target]), bars)}, {out: "double"}, keys)


def with_garch(df: DataFrame, r: str, out: str, omega: float, a: float, b: float, keys=("asset",)) -> DataFrame:
    return fold(df, lambda rows: {out: garch(_numbers(rows[r]), omega, a, b)}, {out: "double"}, keys)


def with_kalman(df: DataFrame, y: str, x: str, q: float, r: float, keys=("asset",)) -> DataFrame:
    def f(rows):
        slope, rest = kalman(_numbers(rows[y]), _numbers(rows[x]), q, r)
        return {"kalman_beta": slope, "kalman_spread": rest}

    return fold(df, f, {"kalman_beta": "double", "kalman_spread": "double"}, keys)
