"""Bars of a time of day that the training never saw."""

import datetime as dt
import math

from quantweave.operators import intraday


def test_unseen_bars_stay_and_change_nothing_else(spark):
    rows = []
    for day in range(1, 9):
        for interval in (1, 2, 3):
            ts = dt.datetime(2024, 1, day, 9 + interval)
            rows.append(("a", interval, ts, ts.date(), math.sin(day * 3 + interval), math.cos(day + 2 * interval)))
    names = "ticker string, interval int, ts timestamp, trade_date date, log_vol double, log_r2 double"
    odd = dt.datetime(2024, 1, 7, 13)
    extra = [("a", 9, odd, odd.date(), 1.0, 2.0), ("b", 1, odd, odd.date(), 1.0, 2.0), ("a", None, odd, odd.date(), None, None)]
    end = dt.date(2024, 1, 5)
    plain = intraday.fit_and_predict(spark.createDataFrame(rows, names), end).orderBy("ticker", "ts").collect()
    got = intraday.fit_and_predict(spark.createDataFrame(rows + extra, names), end).orderBy("ticker", "ts").collect()
    assert len(plain) == 9
    assert [r for r in got if r["h_pred"] is not None] == plain
    assert sorted((r["ticker"], r["interval"] or 0) for r in got if r["h_pred"] is None) == [("a", 0), ("a", 9), ("b", 1)]
    assert all(r[c] is None for r in got if r["h_pred"] is None for c in ("tod", "tod_v", "x_t"))
