"""Queries over hourly and five-minute bars of the events."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quantweave.operators import intraday as I
from quantweave.sources import panels

from .registry import query
from .series import r6, rounded

_BARS = """SELECT event_type AS ticker, date_trunc('hour', ts) - INTERVAL (0) HOUR AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM {src} GROUP BY 1, 2"""
_H = f"b AS ({_BARS.format(src='events')})"
_A, _B = (f"{n} AS ({_BARS.format(src=f'(SELECT * FROM events WHERE user_id % 2 = {k})')})" for n, k in (("a", 0), ("bb", 1)))
_TD = "CAST(ts + INTERVAL 6 HOUR AS DATE)"


def _bars(spark, sf, where=None):
    ticks = panels.read(spark, sf, "events")
    return panels.bars(ticks if where is None else ticks.where(where), 3600).withColumnRenamed("ts_bar", "ts")


def _two(spark, sf):
    return _bars(spark, sf, "user_id % 2 = 0"), _bars(spark, sf, "user_id % 2 = 1")


@query("hourly_bars", f"WITH {_H} SELECT ticker, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM b")
def hourly_bars(spark, sf):
    return rounded(_bars(spark, sf), "ticker", "ts", "volume", open="open", high="high", low="low", close="close")


@query(
    "longer_bars",
    f"""WITH {_H}, e AS (SELECT *, to_timestamp(ceil(epoch(ts) / 10800.0) * 10800)::TIMESTAMP AS ts_end FROM b)
    SELECT ticker, ts_end, round(arg_min(open, ts), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(arg_max(close, ts), 6) AS close, sum(volume) AS volume FROM e GROUP BY 1, 2""",
)
def longer_bars(spark, sf):
    return rounded(I.resample(_bars(spark, sf), 180), "ticker", "ts_end", "volume", open="open", high="high", low="low", close="close")


@query(
    "as_of_bars",
    f"""WITH {_H}, e AS (SELECT ticker, to_timestamp(ceil(epoch(ts) / 10800.0) * 10800)::TIMESTAMP AS ts_end, arg_max(close, ts) AS slow FROM b GROUP BY 1, 2)
    SELECT b.ticker, b.ts, round(b.close, 6) AS close, round(e.slow, 6) AS slow FROM b ASOF LEFT JOIN e ON e.ticker = b.ticker AND b.ts >= e.ts_end""",
)
def as_of_bars(spark, sf):
    b = _bars(spark, sf)
    slow = I.resample(b, 180).select("ticker", "ts_end", F.col("close").alias("slow"))
    return rounded(I.as_of(b.select("ticker", "ts", "close"), slow, ["ticker"], "ts", "ts_end", ["slow"]), "ticker", "ts", close="close", slow="slow")


@query(
    "session_bars",
    f"""WITH f AS ({_BARS.format(src='events').replace("date_trunc('hour', ts) - INTERVAL (0) HOUR", "to_timestamp(floor(epoch(ts) / 300) * 300)::TIMESTAMP")}), k AS (SELECT *, {_TD} AS td FROM f WHERE hour(ts) < 17 OR hour(ts) >= 18),
    g AS (SELECT ticker, td, td::TIMESTAMP - INTERVAL 6 HOUR + INTERVAL (5 * n) MINUTE AS ts FROM (SELECT DISTINCT ticker, td FROM k) CROSS JOIN (SELECT unnest(range(276)) AS n)),
    j AS (SELECT g.ticker, g.td, g.ts, k.open, k.volume, last_value(k.close IGNORE NULLS) OVER (PARTITION BY g.ticker, g.td ORDER BY g.ts) AS close FROM g LEFT JOIN k ON k.ticker = g.ticker AND k.td = g.td AND k.ts = g.ts)
    SELECT ticker, td AS trade_date, count(*) AS bars, sum(coalesce(volume, 0)) AS volume, round(avg(close), 6) AS mean_close, round(avg(coalesce(open, close)), 6) AS mean_open FROM j WHERE close IS NOT NULL GROUP BY 1, 2""",
)
def session_bars(spark, sf):
    """Five-minute sessions with gaps filled, summed up by session."""
    five = panels.bars(panels.read(spark, sf, "events"), 300).withColumnRenamed("ts_bar", "ts")
    s = I.standardise_session(five)
    return s.groupBy("ticker", "trade_date").agg(F.count("*").alias("bars"), F.sum("volume").alias("volume"), r6(F.avg("close"), "mean_close"), r6(F.avg("open"), "mean_open"))


_PANEL = f"""{_H}, p AS (SELECT ticker, ts, {_TD} AS trade_date, (hour(ts) * 100 + minute(ts))::INT AS interval, (row_number() OVER (PARTITION BY ticker, {_TD} ORDER BY ts) - 1)::INT AS bar_idx, ln(greatest(((close - open) / open) ** 2, exp(-20))) AS log_r2, ln(greatest(volume, 1)) AS log_vol, (close - open) / open AS bar_ret FROM b),
    vd AS (SELECT *, (log_vol - avg(log_vol) OVER (PARTITION BY ticker, interval)) / coalesce(nullif(stddev_samp(log_vol) OVER (PARTITION BY ticker, interval), 0), 1) AS vol_dev FROM p)"""


@query("bar_panel", f"WITH {_PANEL} SELECT ticker, ts, trade_date, interval, bar_idx, round(log_r2, 6) AS log_r2, round(log_vol, 6) AS log_vol, round(bar_ret, 6) AS bar_ret, round(vol_dev, 6) AS vol_dev FROM vd")
def bar_panel(spark, sf):
    df = I.volume_deviation(I.bar_panel(_bars(spark, sf)))
    return rounded(df, "ticker", "ts", "trade_date", "interval", "bar_idx", log_r2="log_r2", log_vol="log_vol", bar_ret="bar_ret", vol_dev="vol_dev")


@query(
    "train_only_normalisation",
    f"""WITH {_PANEL}, d AS (SELECT ticker, trade_date, row_number() OVER (PARTITION BY ticker ORDER BY trade_date) <= floor(0.7 * count(*) OVER (PARTITION BY ticker)) AS train FROM (SELECT DISTINCT ticker, trade_date FROM p)),
    s AS (SELECT ticker, interval, avg(log_vol) AS mu, greatest(coalesce(stddev_samp(log_vol), 1), 1e-8) AS sd FROM p JOIN d USING (ticker, trade_date) WHERE train GROUP BY 1, 2)
    SELECT p.ticker, p.ts, d.train, round((log_vol - mu) / sd, 6) AS vol_dev FROM p JOIN d USING (ticker, trade_date) LEFT JOIN s USING (ticker, interval)""",
)
def train_only_normalisation(spark, sf):
    return rounded(I.train_volume_deviation(I.bar_panel(_bars(spark, sf))), "ticker", "ts", "train", vol_dev="vol_dev")


@query("daily_bar_returns", f"WITH {_H} SELECT ticker, {_TD} AS trade_date, round((arg_max(close, ts) - arg_min(open, ts)) / arg_min(open, ts), 6) AS daily_ret FROM b GROUP BY 1, 2 HAVING arg_min(open, ts) > 0")
def daily_bar_returns(spark, sf):
    return rounded(I.daily_returns(_bars(spark, sf)), "ticker", "trade_date", daily_ret="daily_ret")


@query(
    "bar_coverage",
    f"""WITH {_H}, d AS (SELECT ticker, ts::DATE AS d, count(*) AS n, min(ts) AS a, max(ts) AS z FROM b GROUP BY 1, 2) SELECT ticker, sum(n)::BIGINT AS bars, count(*) AS dates, min(a) AS first_ts, max(z) AS last_ts, min(n) AS min_bars, quantile_cont(n, 0.5)::DOUBLE AS median_bars, max(n) AS max_bars, 0.0::DOUBLE AS zero_volume FROM d GROUP BY 1""",
)
def bar_coverage(spark, sf):
    return I.coverage(_bars(spark, sf))


_ALIGN = f"""{_A}, {_B}, al AS (SELECT a.ticker, a.ts, a.open AS open_a, a.close AS close_a, bb.open AS open_b, bb.close AS close_b, abs(a.close - bb.close) AS ad, abs(a.close - bb.close) / nullif(abs(bb.close), 0) * 10000 AS bps, sign(a.close - a.open) = sign(bb.close - bb.open) AS same_sign, a.volume / nullif(bb.volume, 0) AS volume_ratio FROM a JOIN bb ON a.ticker = bb.ticker AND a.ts = bb.ts)"""


@query("source_alignment", f"WITH {_ALIGN} SELECT ticker, ts, round(ad, 6) AS abs_diff, round(bps, 4) AS bps, round(volume_ratio, 6) AS volume_ratio, same_sign FROM al")
def source_alignment(spark, sf):
    a = I.align(*_two(spark, sf))
    return a.select("ticker", "ts", r6("abs_diff", "abs_diff"), F.round("bps", 4).alias("bps"), r6("volume_ratio", "volume_ratio"), "same_sign")


@query(
    "source_reconciliation",
    f"""WITH {_ALIGN}, m AS (SELECT ticker, count(*) AS matched, quantile_cont(bps, 0.5) AS q5, quantile_cont(bps, 0.95) AS q95, max(bps) AS mx, avg(CASE WHEN same_sign THEN 1.0 ELSE 0.0 END) AS ss FROM al GROUP BY 1), na AS (SELECT ticker, count(*) AS n_a FROM a GROUP BY 1), nb AS (SELECT ticker, count(*) AS n_b FROM bb GROUP BY 1)
    SELECT ticker, n_a, n_b, matched, n_a - matched AS only_a, n_b - matched AS only_b, round(q5, 4) AS median_bps, round(q95, 4) AS p95_bps, round(mx, 4) AS max_bps, round(ss, 6) AS sign_share FROM na JOIN nb USING (ticker) JOIN m USING (ticker)""",
)
def source_reconciliation(spark, sf):
    r = I.reconciliation(*_two(spark, sf))
    return r.select("ticker", "n_a", "n_b", "matched", "only_a", "only_b", *[F.round(c, 4).alias(c) for c in ("median_bps", "p95_bps", "max_bps")], r6("sign_share", "sign_share"))


@query(
    "daily_bar_counts",
    f"""WITH {_A}, {_B}, x AS (SELECT ticker, ts::DATE AS d, count(*) AS n_a FROM a GROUP BY 1, 2), y AS (SELECT ticker, ts::DATE AS d, count(*) AS n_b FROM bb GROUP BY 1, 2), z AS (SELECT ticker, ts::DATE AS d, count(*) AS n_both FROM a JOIN bb USING (ticker, ts) GROUP BY 1, 2)
    SELECT ticker, d, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, coalesce(n_both, 0) AS n_both FROM x FULL JOIN y USING (ticker, d) FULL JOIN z USING (ticker, d)""",
)
def daily_bar_counts(spark, sf):
    return I.daily_counts(*_two(spark, sf))


@query("weekday_profile", f"WITH {_H} SELECT ticker, (dayofweek(ts) + 1)::INT AS weekday, count(*) AS n, round(avg(close / nullif(open, 0) - 1), 6) AS mean_ret, round(avg(volume), 6) AS mean_volume FROM b GROUP BY 1, 2")
def weekday_profile(spark, sf):
    return rounded(I.profile(_bars(spark, sf), F.dayofweek("ts"), "weekday"), "ticker", "weekday", "n", mean_ret="mean_ret", mean_volume="mean_volume")


@query(
    "time_of_day_profile",
    f"WITH {_H} SELECT ticker, (hour(ts) * 100 + minute(ts))::INT AS hhmm, count(*) AS n, round(avg(close / nullif(open, 0) - 1), 6) AS mean_ret, round(avg(volume), 6) AS mean_volume FROM b WHERE hour(ts) * 100 + minute(ts) BETWEEN 930 AND 1600 GROUP BY 1, 2",
)
def time_of_day_profile(spark, sf):
    return rounded(I.profile(I.keep_session(_bars(spark, sf)), I.hhmm(), "hhmm"), "ticker", "hhmm", "n", mean_ret="mean_ret", mean_volume="mean_volume")


_F3 = "OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


@query(
    "body_ratio_factors",
    f"""WITH {_H}, k AS (SELECT *, (close - open) / nullif(high - low, 0) AS raw, CASE WHEN count(*) {_F3} = 3 THEN sum(close - open) {_F3} / nullif(sum(high - low) {_F3}, 0) END AS sum3, lead(close, 2) OVER (PARTITION BY ticker ORDER BY ts) / close - 1 AS fwd FROM b)
    SELECT ticker, ts, round(raw, 6) AS raw, round(sum3, 6) AS sum3, round(fwd, 6) AS fwd, CASE WHEN coalesce(sign(raw), 0) + coalesce(sign(sum3), 0) >= 2 THEN 1 WHEN coalesce(sign(raw), 0) + coalesce(sign(sum3), 0) <= -2 THEN -1 ELSE 0 END::INT AS vote FROM k""",
)
def body_ratio_factors(spark, sf):
    b = _bars(spark, sf).withColumns({"raw": I.body_ratio(), "sum3": I.body_ratio(3), "fwd": F.lead("close", 2).over(W.partitionBy("ticker").orderBy("ts")) / F.col("close") - 1})
    return b.select("ticker", "ts", r6("raw", "raw"), r6("sum3", "sum3"), r6("fwd", "fwd"), I.vote([F.col("raw"), F.col("sum3")], 2).cast("int").alias("vote"))


@query(
    "volatility_model",
    f"""WITH {_PANEL}, l AS (SELECT *, coalesce(lag(vol_dev) OVER (PARTITION BY ticker ORDER BY ts), 0) AS v1, avg(log_r2) OVER (PARTITION BY ticker, interval) AS tod FROM vd),
    m AS (SELECT *, coalesce(sum(v1 * (log_r2 - tod)) OVER (PARTITION BY ticker, interval) / nullif(sum(v1 * v1) OVER (PARTITION BY ticker, interval), 0), 0) AS beta FROM l)
    SELECT ticker, ts, round(tod + beta * v1, 6) AS fitted, round(log_r2 - tod - beta * v1, 6) AS residual FROM m""",
)
def volatility_model(spark, sf):
    fit = I.volatility_fit(I.volume_deviation(I.bar_panel(_bars(spark, sf))))
    return rounded(fit, "ticker", "ts", fitted="fitted", residual="residual")


@query(
    "mincer_zarnowitz",
    f"""WITH {_PANEL}, l AS (SELECT *, coalesce(lag(vol_dev) OVER (PARTITION BY ticker ORDER BY ts), 0) AS v1, avg(log_r2) OVER (PARTITION BY ticker, interval) AS tod FROM vd),
    m AS (SELECT *, coalesce(sum(v1 * (log_r2 - tod)) OVER (PARTITION BY ticker, interval) / nullif(sum(v1 * v1) OVER (PARTITION BY ticker, interval), 0), 0) AS beta FROM l),
    d AS (SELECT ticker, trade_date, sqrt(sum(exp(least(greatest(tod + beta * v1, -20), 0)))) AS forecast, sqrt(sum(bar_ret * bar_ret)) AS realised FROM m GROUP BY 1, 2)
    SELECT ticker, count(*) AS n, round(regr_r2(realised, forecast), 5) AS r2 FROM d GROUP BY 1 HAVING count(*) >= 10""",
)
def mincer_zarnowitz(spark, sf):
    """How much of daily realised volatility the fitted one explains."""
    fit = I.volatility_fit(I.volume_deviation(I.bar_panel(_bars(spark, sf))))
    day = fit.groupBy("ticker", "trade_date").agg(F.sqrt(F.sum(F.exp(F.least(F.greatest("fitted", F.lit(-20.0)), F.lit(0.0))))).alias("forecast"), F.sqrt(F.sum(F.col("bar_ret") * F.col("bar_ret"))).alias("realised"))
    return day.groupBy("ticker").agg(F.count("*").alias("n"), F.round(F.regr_r2("realised", "forecast"), 5).alias("r2")).where("n >= 10")


@query(
    "vol_managed_returns",
    f"""WITH {_H}, r AS (SELECT ticker, ts, close / lag(close) OVER (PARTITION BY ticker ORDER BY ts) - 1 AS r FROM b), v AS (SELECT *, CASE WHEN count(r) OVER f >= 5 THEN sqrt(avg(r * r) OVER f) END AS sg FROM r WINDOW f AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
    p AS (SELECT *, lag(CASE WHEN sg IS NOT NULL THEN least(greatest(0.1 / least(greatest(sg * sqrt(252 * 24), 0.01), 5), 0), 3) END, 2) OVER (PARTITION BY ticker ORDER BY ts) AS pos FROM v)
    SELECT ticker, ts::DATE AS d, round(sum(pos * r), 6) AS managed, count(pos * r) AS n FROM p GROUP BY 1, 2 HAVING count(pos * r) > 0""",
)
def vol_managed_returns(spark, sf):
    """Positions scaled to a volatility target, traded two bars late."""
    run = W.partitionBy("ticker").orderBy("ts")
    df = _bars(spark, sf).withColumn("r", F.col("close") / F.lag("close").over(run) - 1)
    f = run.rowsBetween(-20, 0)
    df = df.withColumn("sg", F.when(F.count("r").over(f) >= 5, F.sqrt(F.avg(F.col("r") * F.col("r")).over(f))))
    df = df.withColumn("pos", F.lag(F.when(F.col("sg").isNotNull(), I.vol_target(F.col("sg"), 0.1, 24)), 2).over(run)).withColumn("x", F.col("pos") * F.col("r"))
    return df.groupBy("ticker", F.to_date("ts").alias("d")).agg(r6(F.sum("x"), "managed"), F.count("x").alias("n")).where("n > 0")
