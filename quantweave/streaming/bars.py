"""Streams of ticks: bars by event time, and first-order recursions with kept state.

Both take streaming DataFrames; on batch ones `bars` gives the same rows.
"""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: (state, value) to (state, result); the state is a tuple of doubles, None at the start.
Step = Callable[[tuple | None, float], tuple[tuple, float]]


def bars(ticks: DataFrame, width: str = "5 minutes", late: str = "10 minutes", ticker: str = "ticker", ts: str = "ts", value: str = "value") -> DataFrame:
    """ticker, ts_bar, open, high, low, close, volume (number of ticks). A bar is final, and is
    emitted, once the stream is `late` past its end; later ticks of it are dropped."""
    order = F.col(ts)
    made = ticks.withWatermark(ts, late).groupBy(F.window(ts, width), F.col(ticker).alias("ticker")).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return made.select("ticker", F.col("window.start").alias("ts_bar"), "open", "high", "low", "close", "volume")


def ewma(alpha: float) -> tuple[Step, int]:
    return (lambda s, v: ((y := v if s is None else (1 - alpha) * s[0] + alpha * v,), y)), 1


def garch(omega: float, a: float, b: float, start: float = 1e-4) -> tuple[Step, int]:
    """The variance before each return."""

    def step(s, r):
        h = start if s is None else omega + a * s[0] ** 2 + b * s[1]
        return (r, h), h

    return step, 2


def thresholds(enter: float, leave: float) -> tuple[Step, int]:
    """-1 above `enter`, +1 below -`enter`, from flat only, until the score is back within `leave`."""

    def step(s, z):
        now = 0.0 if s is None else s[0]
        if now == 0:
            now = -1.0 if z > enter else 1.0 if z < -enter else 0.0
        elif now * z > -leave:
            now = 0.0
        return (now,), now

    return step, 1


def recursion(rows: DataFrame, step: tuple[Step, int], key: str = "ticker", ts: str = "ts", value: str = "value") -> DataFrame:
    """key, ts, value, result of a stream, in the order of time within each micro-batch; nulls
    are left out. What is kept of a key is the state, whatever the stream's length."""
    f, size = step
    names = [f"s{i}" for i in range(size)]

    def task(k, frames, state: GroupState):
        df = pd.concat(list(frames)).sort_values(ts, kind="stable")
        now = tuple(state.get) if state.exists else None
        out = []
        for v in df[value]:
            now, result = f(now, float(v))
            out.append(result)
        if now is not None:
            state.update(tuple(float(x) for x in now))
        yield pd.DataFrame({key: df[key], ts: df[ts], value: df[value].astype(float), "result": out})

    kind = rows.schema
    fields = f"{key} {kind[key].dataType.simpleString()}, {ts} {kind[ts].dataType.simpleString()}, {value} double, result double"
    return rows.where(F.col(value).isNotNull()).select(key, ts, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandasWithState(task, fields, ", ".join(f"{n} double" for n in names), "append", GroupStateTimeout.NoTimeout)
