"""Streams whose rows come shuffled over micro-batches fold as the sorted series does."""

import datetime as dt
import random

import numpy as np
import pytest

from quantweave.operators import recursive as R
from quantweave.streaming import bars, ordered

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(STORE)


def _streamed(spark, tmp_path, batches, fold):
    """The fold's rows after the batches, and a last one that takes the watermark past all rows."""
    schema = "ticker string, ts timestamp, value double, x double"
    end = START + dt.timedelta(days=9)
    for i, rows in enumerate([*batches, [("end", end, 0.0, 0.0)], [("end", end + dt.timedelta(days=9), 0.0, 0.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i:03d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    name = f"t{random.getrandbits(40):x}"
    query = fold(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    try:
        query.processAllAvailable()
        return spark.table(name).where("ticker <> 'end'").collect()
    finally:
        query.stop()


def _ticks(seed):
    rng = random.Random(seed)
    rows = [(k, START + dt.timedelta(seconds=60 * i + rng.random()), rng.gauss(0, 1), rng.gauss(1, 1)) for k in "ab" for i in range(40)]
    # each comes up to five minutes late, over batches of one minute and a half
    order = sorted(rows, key=lambda r: (r[1] + dt.timedelta(seconds=rng.uniform(0, 300))))
    return rows, [order[i : i + 8] for i in range(0, len(order), 8)]


@pytest.mark.parametrize("name", ["ewma", "thresholds", "kalman"])
def test_shuffled_batches_fold_as_the_sorted_series(rocks, tmp_path, name):
    rows, batches = _ticks(name)
    step = {"ewma": ordered.single(bars.ewma(0.3)), "thresholds": ordered.single(bars.thresholds(1.0, 0.2)), "kalman": ordered.kalman(1e-3, 0.1)}[name]
    values = ("value", "x") if name == "kalman" else ("value",)
    got = _streamed(rocks, tmp_path, batches, lambda s: ordered.recursion(s, step, "6 minutes", values=values))
    assert len(got) == len(rows)
    for k in "ab":
        series = sorted(r for r in rows if r[0] == k)
        v, x = (np.array([r[i] for r in series]) for i in (2, 3))
        want = {"ewma": lambda: R.ewma(v, 0.3), "thresholds": lambda: R.threshold_state(v, 1.0, 0.2), "kalman": lambda: R.kalman(v, x, 1e-3, 0.1)[1]}[name]()
        mine = sorted((r.ts, r.result) for r in got if r.ticker == k)
        assert np.allclose([r for _, r in mine], want)


def test_an_idle_key_starts_anew_and_odd_rows_are_left_out(rocks, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    batches = [
        [("a", at(0), 1.0, 0.0), ("a", at(1), 3.0, 0.0), (None, at(1), 5.0, 0.0), ("a", None, 5.0, 0.0), ("a", at(1), None, 0.0)],
        [("b", at(100), 1.0, 0.0)],
        [("b", at(101), 1.0, 0.0)],
        [("a", at(200), 7.0, 0.0), ("a", at(20), 9.0, 0.0)],  # the second is too late
    ]
    got = _streamed(rocks, tmp_path, batches, lambda s: ordered.recursion(s, ordered.single(bars.ewma(0.5)), "5 minutes", idle_ms=30 * 60_000))
    assert sorted((r.value, r.result) for r in got if r.ticker == "a") == [(1.0, 1.0), (3.0, 2.0), (7.0, 7.0)]
