"""First-order recursions over streams in the order of event time, however late rows come.

Rows wait, by key, until the watermark has passed them; then they are folded in the order of time. So a row
that comes a micro-batch late, but within the watermark's delay, changes nothing: the results are those of one
fold over the sorted series, whatever batches the rows come in. What is kept of a key are the rows that still
wait and the recursion's state.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: (state, values) to (state, result); the state is a tuple of `size` doubles, None at the start.
Step = Callable[[tuple | None, tuple], tuple[tuple, float]]


def single(step: tuple[Callable, int]) -> tuple[Step, int]:
    """A step of `streaming.bars`, which takes one value, as one over a tuple of values."""
    f, size = step
    return (lambda state, values: f(state, values[0])), size


def kalman(drift: float, noise: float, slope: float = 0.0, spread: float = 1.0) -> tuple[Step, int]:
    """The slope of y on x (values: y, x) as a random walk; the result is what is left of y by the new slope."""

    def step(state, values):
        y, x = values
        beta, p = (slope, spread) if state is None else state
        p += drift
        gain = p * x / (x * p * x + noise)
        beta += gain * (y - x * beta)
        return (beta, p * (1 - gain * x)), y - x * beta

    return step, 2


#: The time in microseconds; a name that the processor's frames keep (one that starts with _ is lost).
MICROS = "event_micros"


class _Fold(StatefulProcessor):
    def __init__(self, step: tuple[Step, int], key: str, values: list[str], idle_ms: int):
        self.step, self.size, self.key, self.values, self.idle = *step, key, values, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, " + ", ".join(f"v{i} double" for i in range(len(self.values))))
        self.now = handle.getValueState("now", "last bigint, " + ", ".join(f"s{i} double" for i in range(self.size)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for df in rows if len(df) for r in df[[MICROS, *self.values]].itertuples(index=False, name=None)]
        if not new:
            return iter(())
        self.waiting.appendList([(int(us), *map(float, v)) for us, *v in new])
        # due as soon as the watermark has passed it; the same time again is the same timer
        self.handle.registerTimer(min(us for us, *_ in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(map(tuple, self.waiting.get()))
        due, rest = [r for r in held if r[0] <= passed], [r for r in held if r[0] > passed]
        state = tuple(self.now.get()) if self.now.exists() else None
        last, state = (None, None) if state is None else (state[0], state[1:])
        out = []
        for us, *values in due:
            state, result = self.step(state, tuple(values))
            last = us
            out.append((us, *values, result))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if last is not None and self.idle:
            if not rest and passed >= last + self.idle * 1000:
                self.now.clear()  # nothing has come for so long
                last = None
            else:
                self.handle.registerTimer((last // 1000) + self.idle + 1)
        if due and last is not None:
            self.now.update((last, *map(float, state)))
        if out:
            df = pd.DataFrame(out, columns=[MICROS, *self.values, "result"])
            df.insert(0, self.key, key[0])
            yield df

    def close(self) -> None:
        pass


def recursion(rows: DataFrame, step: tuple[Step, int], late: str, key: str = "ticker", ts: str = "ts", values: tuple[str, ...] = ("value",), idle_ms: int = 0) -> DataFrame:
    """key, ts, values, result of a stream: the recursion over each key's rows in the order of ts, ties in the order
    of the values. A row comes out once the stream is `late` past it; rows that come later than that are dropped.

    Rows that lack the key, the time or a value are left out. With `idle_ms`, a key that has no rows for so long
    in event time starts anew. The session's state store must be RocksDB's.
    """
    whole = F.col(ts).isNotNull() & F.col(key).isNotNull()
    for v in values:
        whole &= F.col(v).isNotNull()
    kind = rows.schema[key].dataType.simpleString()
    fields = f"{key} {kind}, {MICROS} bigint, " + ", ".join(f"{v} double" for v in values) + ", result double"
    timed = rows.where(whole).withWatermark(ts, late).select(key, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias(MICROS), *[F.col(v).cast("double").alias(v) for v in values])
    made = timed.groupBy(key).transformWithStateInPandas(_Fold(step, key, list(values), idle_ms), fields, "append", "EventTime")
    return made.select(key, F.timestamp_micros(MICROS).alias(ts), *values, "result")
