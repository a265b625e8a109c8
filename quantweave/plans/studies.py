"""Queries of walk-forward studies, trend features, resampling and screening."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quantweave.functions import series as S
from quantweave.operators import intraday as I
from quantweave.operators import leadlag, resampling, screening, spreads, trend, walkforward
from quantweave.operators import performance as P
from quantweave.operators import recursive as R
from quantweave.sources import panels

from .factors import _SPREAD, _spread_panel, _STRAT, _strategies
from .intraday import _A, _ALIGN, _B, _H, _PANEL, _bars, _two
from .network import _CLS, _FEAT, _features
from .registry import query
from .series import _F, _Z, r6, rounded, _z

# --- panels -------------------------------------------------------------------------------------


@query(
    "long_history",
    """WITH f AS (SELECT asset, t, t_idx, last_value(price IGNORE NULLS) OVER (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS price FROM weekly), n AS (SELECT *, count(price) OVER (PARTITION BY asset) AS n FROM f), k AS (SELECT *, count(price) OVER (PARTITION BY t_idx) AS m FROM n WHERE n >= 100)
    SELECT t, asset, round(price, 6) AS price FROM k WHERE m > 0""",
    ("weekly",),
)
def long_history(spark, sf):
    return rounded(panels.long_history(panels.weekly(spark, sf), 100), "t", "asset", price="price")


@query(
    "complete_dates",
    """WITH m AS (SELECT *, avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY asset) AS m FROM monthly), f AS (SELECT asset, t, t_idx, last_value(price IGNORE NULLS) OVER (PARTITION BY asset ORDER BY t_idx ROWS UNBOUNDED PRECEDING) AS price FROM m WHERE m <= 0.05),
    c AS (SELECT *, count(price) OVER (PARTITION BY t_idx) AS n, count(*) OVER (PARTITION BY t_idx) AS a FROM f) SELECT t, asset, round(price, 6) AS price FROM c WHERE n = a""",
    ("monthly",),
)
def complete_dates(spark, sf):
    return rounded(panels.complete_dates(panels.monthly(spark, sf)), "t", "asset", price="price")


@query("complete_assets", "WITH s AS (SELECT *, count(r) OVER (PARTITION BY asset) AS n FROM ret WHERE t_idx BETWEEN 40 AND 60) SELECT t, asset, round(r, 6) AS r FROM s WHERE n = 21", ("ret",))
def complete_assets(spark, sf):
    return rounded(panels.complete_assets(panels.weekly_returns(spark, sf), 40, 60), "t", "asset", r="r")


# --- bars ----------------------------------------------------------------------------------------

_FIELDS = ", ".join(f"('{f}', a.{f}, bb.{f})" for f in ("open", "high", "low", "close", "volume"))
_MATCH = f"{_A}, {_B}, mt AS (SELECT a.ticker, (hour(a.ts) * 100 + minute(a.ts))::INT AS hhmm, f.field, f.x, f.y FROM a JOIN bb ON bb.ticker = a.ticker AND bb.ts = a.ts, LATERAL (VALUES {_FIELDS}) AS f(field, x, y))"


@query("matched_averages", f"WITH {_MATCH} SELECT ticker, field, count(*) AS n, round(avg(x), 6) AS mean_a, round(avg(y), 6) AS mean_b FROM mt GROUP BY 1, 2")
def matched_averages(spark, sf):
    return rounded(I.matched_averages(*_two(spark, sf), ["ticker"]), "ticker", "field", "n", mean_a="mean_a", mean_b="mean_b")


@query("matched_by_time", f"WITH {_MATCH} SELECT ticker, hhmm, field, count(*) AS n, round(avg(x), 6) AS mean_a, round(avg(y), 6) AS mean_b FROM mt GROUP BY 1, 2, 3")
def matched_by_time(spark, sf):
    return rounded(I.matched_averages(*_two(spark, sf), ["ticker", "hhmm"]), "ticker", "hhmm", "field", "n", mean_a="mean_a", mean_b="mean_b")


@query(
    "rolling_difference",
    f"""WITH {_ALIGN}, n AS (SELECT ticker, least(78, greatest(5, floor(count(*) / 10.0)))::INT AS w FROM al GROUP BY 1), x AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS k FROM al)
    SELECT x.ticker, x.ts, round(avg(y.ad), 5) AS smooth FROM x JOIN n USING (ticker) JOIN x y ON y.ticker = x.ticker AND y.k BETWEEN x.k - w + 1 AND x.k GROUP BY 1, 2""",
)
def rolling_difference(spark, sf):
    return I.rolling_difference(I.align(*_two(spark, sf))).select("ticker", "ts", F.round("smooth", 5).alias("smooth"))


@query("largest_differences", f"WITH {_ALIGN} SELECT ticker, ts, round(ad, 6) AS abs_diff FROM al ORDER BY ad DESC, ticker, ts LIMIT 15")
def largest_differences(spark, sf):
    return rounded(I.largest(I.align(*_two(spark, sf)), "abs_diff"), "ticker", "ts", abs_diff="abs_diff")


@query(
    "sample_dates",
    f"""WITH {_H}, d AS (SELECT DISTINCT ticker, CAST(ts + INTERVAL 6 HOUR AS DATE) AS trade_date FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trade_date) - 1 AS k, count(*) OVER (PARTITION BY ticker) AS n FROM d)
    SELECT ticker, 'first' AS place, trade_date FROM k WHERE k = 0 UNION ALL SELECT ticker, 'middle', trade_date FROM k WHERE k = n // 2 UNION ALL SELECT ticker, 'last', trade_date FROM k WHERE k = n - 1""",
)
def sample_dates(spark, sf):
    return I.sample_dates(_bars(spark, sf))


@query(
    "volatility_forecast",
    f"""WITH RECURSIVE {_PANEL}, cut AS (SELECT quantile_disc(trade_date, 0.6) AS d FROM (SELECT DISTINCT trade_date FROM p)), st AS (SELECT ticker, interval, avg(log_vol) AS m, greatest(coalesce(stddev_samp(log_vol), 0), 1e-8) AS s, avg(log_r2) AS tod FROM p, cut WHERE trade_date <= d GROUP BY 1, 2),
    r0 AS (SELECT p.*, trade_date <= d AS early, (log_vol - m) / s AS dev, tod FROM p JOIN st USING (ticker, interval), cut), r1 AS (SELECT *, coalesce(lag(dev) OVER (PARTITION BY ticker, early ORDER BY ts), 0) AS v1 FROM r0),
    be AS (SELECT ticker, interval, coalesce(sum(v1 * (log_r2 - tod)) / nullif(sum(v1 * v1), 0), 0) AS beta FROM r1 WHERE early GROUP BY 1, 2),
    l AS (SELECT ticker, ts, tod, beta * v1 AS tod_v, log_r2 - tod - beta * v1 AS rest, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS k FROM r1 JOIN be USING (ticker, interval) WHERE NOT early),
    x AS (SELECT ticker, k, 0.0::DOUBLE AS x FROM l WHERE k = 1 UNION ALL SELECT x.ticker, x.k + 1, 0.94 * x.x + 0.06 * (l.rest - x.x) FROM x JOIN l ON l.ticker = x.ticker AND l.k = x.k JOIN l n ON n.ticker = x.ticker AND n.k = x.k + 1)
    SELECT l.ticker, l.ts, round(tod, 6) AS tod, round(tod_v, 6) AS tod_v, round(x, 5) AS x_t, round(tod + tod_v + x, 5) AS h_pred FROM l JOIN x ON x.ticker = l.ticker AND x.k = l.k
    UNION ALL SELECT ticker, ts, NULL, NULL, NULL, NULL FROM p, cut WHERE trade_date > d AND NOT EXISTS (SELECT 1 FROM st WHERE st.ticker = p.ticker AND st.interval = p.interval)""",
)
def volatility_forecast(spark, sf):
    """Fitted on the first six tenths of the trade dates, predicted on the rest."""
    panel = I.bar_panel(_bars(spark, sf))
    end = panel.select("trade_date").distinct().agg(F.expr("percentile_disc(0.6) WITHIN GROUP (ORDER BY unix_date(trade_date))").alias("d")).first()[0]  # one date
    out = I.fit_and_predict(panel, F.date_from_unix_date(F.lit(int(end or 0))))
    return out.select("ticker", "ts", r6("tod", "tod"), r6("tod_v", "tod_v"), F.round("x_t", 5).alias("x_t"), F.round("h_pred", 5).alias("h_pred"))


_FACTOR = f"{_H}, k AS (SELECT *, (close - open) / nullif(high - low, 0) AS raw, lead(close, 2) OVER (PARTITION BY ticker ORDER BY ts) / lead(close) OVER (PARTITION BY ticker ORDER BY ts) - 1 AS fwd FROM b)"


def _factor_rows(spark, sf):
    run = W.partitionBy("ticker").orderBy("ts")
    return _bars(spark, sf).withColumns({"raw": I.body_ratio(), "fwd": F.lead("close", 2).over(run) / F.lead("close").over(run) - 1})


@query(
    "factor_statistics",
    f"""WITH {_FACTOR}, g AS (SELECT *, raw * fwd AS g, abs(raw - coalesce(lag(raw) OVER (PARTITION BY ticker ORDER BY ts), 0)) AS d FROM k WHERE raw IS NOT NULL AND fwd IS NOT NULL),
    a AS (SELECT ticker, count(*) AS n, corr(raw, fwd) AS ic, avg(g) / stddev_samp(g) AS q, avg(d) AS turnover, avg(g - 0.0001 * d) / stddev_samp(g - 0.0001 * d) AS up, avg(-g - 0.0001 * d) / stddev_samp(-g - 0.0001 * d) AS down FROM g GROUP BY 1)
    SELECT ticker, n, round(ic, 6) AS ic, CASE WHEN q >= 0 THEN 1 ELSE -1 END AS direction, round(abs(q) * sqrt(252 * 24), 6) AS gross, round(CASE WHEN q >= 0 THEN up ELSE down END * sqrt(252 * 24), 6) AS net, round(turnover, 6) AS turnover FROM a""",
)
def factor_statistics(spark, sf):
    return rounded(I.factor_statistics(_factor_rows(spark, sf), "raw", "fwd"), "ticker", "n", "direction", ic="ic", gross="gross", net="net", turnover="turnover")


@query(
    "body_factor_variants",
    f"""WITH {_FACTOR}, m AS (SELECT *, CASE WHEN count(raw) OVER f = 3 THEN avg(raw) OVER f END AS ma3 FROM k WINDOW f AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
    h AS (SELECT *, CASE WHEN raw >= 0.5 THEN 1 WHEN raw <= -0.5 THEN -1 WHEN abs(raw) < 0.1 THEN 0 END AS ev FROM m)
    SELECT ticker, ts, round(ma3, 6) AS ma3, CASE WHEN raw IS NULL THEN 0 ELSE coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) END::INT AS band, round((coalesce(raw, 0) + coalesce(ma3, 0) + coalesce(lag(raw) OVER (PARTITION BY ticker ORDER BY ts), 0)) / 3, 6) AS mean3 FROM h""",
)
def body_factor_variants(spark, sf):
    df = _factor_rows(spark, sf).withColumn("t_idx", F.col("ts"))
    ma3 = S.rolling(F.avg, "raw", 3, keys=("ticker",))
    df = df.withColumns({"ma3": ma3, "band": S.hysteresis("raw", 0.5, 0.1, ("ticker",)).cast("int"), "p": F.lag("raw").over(S.by("ticker"))})
    mean = (F.coalesce("raw", F.lit(0.0)) + F.coalesce("ma3", F.lit(0.0)) + F.coalesce("p", F.lit(0.0))) / 3
    return rounded(df, "ticker", "ts", "band", ma3="ma3", mean3=mean)


@query(
    "managed_strategies",
    f"""WITH {_H}, r AS (SELECT ticker, ts, close / lag(close) OVER (PARTITION BY ticker ORDER BY ts) - 1 AS r FROM b), s AS (SELECT *, CASE WHEN count(r) OVER al >= 5 THEN sqrt(avg(r * r) OVER al) END AS s1, CASE WHEN count(r) OVER ro >= 5 THEN sqrt(avg(r * r) OVER ro) END AS s2, CASE WHEN count(r) OVER dy >= 5 THEN sqrt(avg(r * r) OVER dy) END AS s3 FROM r
      WINDOW al AS (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING), ro AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), dy AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
    u AS (SELECT ticker, ts, r, f.strategy, f.p FROM s, LATERAL (VALUES ('hold', 1.0::DOUBLE), ('constant', CASE WHEN s1 IS NOT NULL THEN least(greatest(0.1 / least(greatest(s1 * sqrt(252 * 24), 0.01), 5), 0), 3) END), ('rolling', CASE WHEN s2 IS NOT NULL THEN least(greatest(0.1 / least(greatest(s2 * sqrt(252 * 24), 0.01), 5), 0), 3) END), ('daily', CASE WHEN s3 IS NOT NULL THEN least(greatest(0.1 / least(greatest(s3 * sqrt(252 * 24), 0.01), 5), 0), 3) END)) AS f(strategy, p)),
    q AS (SELECT *, lag(p, 2) OVER (PARTITION BY ticker, strategy ORDER BY ts) AS pos FROM u), n AS (SELECT *, pos * r - 0.0001 * abs(pos - coalesce(lag(pos) OVER (PARTITION BY ticker, strategy ORDER BY ts), 0)) AS net FROM q)
    SELECT ticker, strategy, count(net) AS n, round(avg(net) / stddev_samp(net) * sqrt(252 * 24), 6) AS sharpe FROM n WHERE net IS NOT NULL GROUP BY 1, 2""",
)
def managed_strategies(spark, sf):
    rows = I.managed_strategies(_bars(spark, sf), 21, 24)
    return rows.groupBy("ticker", "strategy").agg(F.count("r").alias("n"), r6(P.sharpe("r", 252 * 24), "sharpe"))


# --- metrics -------------------------------------------------------------------------------------


@query("mean_test", f"WITH {_STRAT} SELECT strategy, count(r) AS n, round(avg(r) / (stddev_samp(r) / sqrt(count(r))), 6) AS t_stat FROM st GROUP BY 1", ("mret",))
def mean_test(spark, sf):
    return rounded(P.mean_test(_strategies(spark, sf)), "strategy", "n", t_stat="t_stat")


@query("top_strategies", f"WITH {_STRAT} SELECT strategy, round(avg(r) / stddev_samp(r) * sqrt(12), 6) AS sharpe FROM st GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", ("mret",))
def top_strategies(spark, sf):
    """A report of the ten best."""
    each = _strategies(spark, sf).groupBy("strategy").agg(r6(P.sharpe("r", 12), "sharpe"))
    return each.orderBy(F.desc("sharpe"), "strategy").limit(10)


@query(
    "sharpe_histogram",
    f"""WITH {_STRAT}, s AS (SELECT strategy, avg(r) / stddev_samp(r) * sqrt(12) AS v FROM st GROUP BY 1), e AS (SELECT min(v) AS a, max(v) AS b FROM s), g AS (SELECT unnest(range(20))::INT AS bin), c AS (SELECT least(floor((v - a) / (b - a) * 20), 19)::INT AS bin, count(*) AS n FROM s, e GROUP BY 1)
    SELECT bin, round(a + (b - a) * bin / 20, 6) AS low, coalesce(n, 0) AS n FROM g CROSS JOIN e LEFT JOIN c USING (bin)""",
    ("mret",),
)
def sharpe_histogram(spark, sf):
    each = _strategies(spark, sf).groupBy("strategy").agg(P.sharpe("r", 12).alias("v"))
    return rounded(P.histogram(each, "v"), "bin", "n", low="low")


@query(
    "average_holding",
    """WITH p AS (SELECT asset, t_idx, coalesce(sign(r), 0) AS p FROM mret), d AS (SELECT *, abs(p - coalesce(lag(p) OVER (PARTITION BY asset ORDER BY t_idx), 0)) AS d FROM p) SELECT asset, round(2 * sum(abs(p)) / nullif(sum(d), 0), 6) AS bars FROM d GROUP BY 1""",
    ("mret",),
)
def average_holding(spark, sf):
    p = panels.monthly_returns(spark, sf).withColumn("position", F.signum("r"))
    return rounded(P.average_holding(p), "asset", bars="bars")


@query(
    "frequency_sweep",
    """WITH w AS (SELECT asset, t_idx, r, r - avg(r) OVER (PARTITION BY t_idx) AS w FROM mret), e AS (SELECT unnest([1, 2, 3, 6])::INT AS every), x AS (SELECT e.every, a.t_idx, a.asset, b.w * a.r AS v FROM e CROSS JOIN w a JOIN w b ON b.asset = a.asset AND b.t_idx = (a.t_idx - 1) - (a.t_idx - 1) % e.every WHERE a.t_idx > 0)
    SELECT every, t_idx, round(sum(v), 8) AS r, count(v) AS n FROM x GROUP BY 1, 2 HAVING count(v) > 0""",
    ("mret",),
)
def frequency_sweep(spark, sf):
    m = panels.monthly_returns(spark, sf).select("asset", "t_idx", "r").withColumn("w", F.col("r") - F.avg("r").over(W.partitionBy("t_idx")))
    return P.frequency_sweep(m, [1, 2, 3, 6]).select("every", "t_idx", F.round("r", 8).alias("r"), "n")


@query(
    "smoothed_bimodality",
    f"""WITH {_FEAT}, {_CLS}, c AS (SELECT t, count(*) FILTER (size = 10 AND cls = 9) tp, count(*) FILTER (size = 10 AND cls = 0) fp, count(*) FILTER (size <> 10 AND cls = 0) tn, count(*) FILTER (size <> 10 AND cls = 9) fn FROM cl GROUP BY t),
    b AS (SELECT t, -(CASE WHEN tp + fp > 0 THEN (tp - fp) / (tp + fp)::DOUBLE ELSE 0 END + CASE WHEN tn + fn > 0 THEN (tn - fn) / (tn + fn)::DOUBLE ELSE 0 END) / 2 AS bm FROM c)
    SELECT t, round(CASE WHEN count(bm) OVER f = 6 THEN avg(bm) OVER f END, 6) + 0.0 AS smooth FROM b WINDOW f AS (ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""",
    ("mret",),
)
def smoothed_bimodality(spark, sf):
    from quantweave.operators import labels

    rows = labels.return_class(_features(spark, sf)).select("t", F.col("cls").alias("true_cls"), (F.col("size") - 1).alias("pred_cls"))
    bm = labels.bimodality(rows).withColumn("one", F.lit(1))
    return bm.select("t", (F.round(S.rolling(F.avg, "bm", 6, keys=("one",), order="t"), 6) + F.lit(0.0)).alias("smooth"))


@query(
    "characteristic_ranks",
    "WITH k AS (SELECT t_idx, asset, row_number() OVER (PARTITION BY t_idx ORDER BY vol DESC, asset) AS hi, row_number() OVER (PARTITION BY t_idx ORDER BY vol, asset) AS lo, greatest(floor(count(*) OVER (PARTITION BY t_idx) * 0.2), 1) AS m FROM weekly WHERE vol IS NOT NULL) SELECT t_idx, asset, CASE WHEN hi <= m THEN 'high' ELSE 'low' END AS side FROM k WHERE hi <= m OR lo <= m",
    ("weekly",),
)
def characteristic_ranks(spark, sf):
    return leadlag.characteristic_ranks(panels.weekly(spark, sf), "vol")


@query(
    "market_betas",
    "WITH m AS (SELECT t_idx, avg(r) AS m FROM mret GROUP BY 1) SELECT asset, round(regr_slope(r, m), 6) AS beta, round(corr(r, m), 6) AS correlation, count(*) AS n FROM mret JOIN m USING (t_idx) WHERE r IS NOT NULL AND m IS NOT NULL GROUP BY 1 HAVING count(*) >= 12",
    ("mret",),
)
def market_betas(spark, sf):
    m = panels.monthly_returns(spark, sf)
    return rounded(leadlag.betas(m, m.groupBy("t_idx").agg(F.avg("r").alias("r"))), "asset", "n", beta="beta", correlation="correlation")


# --- walk-forward --------------------------------------------------------------------------------

_SPANS = "sp0 AS (SELECT max(t_idx) AS last FROM ret), spans AS (SELECT k AS period, 0 AS train_from, 156 + 52 * k AS test_from, least(208 + 52 * k, last + 1) AS test_to FROM sp0, LATERAL (SELECT unnest(range(0, (last - 156) // 52 + 1)) AS k) WHERE last >= 156)"
_XY = "xy AS (SELECT asset, t, t_idx, r, q, flow, lead(r) OVER (PARTITION BY asset ORDER BY t_idx) AS y FROM ret)"
_NORMAL = """g AS (SELECT period, count(*)::DOUBLE AS n, sum(q) AS sq, sum(flow) AS sf, sum(y) AS sy, sum(q * q) AS qq, sum(q * flow) AS qf, sum(flow * flow) AS ff, sum(q * y) AS qy, sum(flow * y) AS fy FROM xy JOIN spans ON t_idx >= train_from AND t_idx < test_from WHERE q IS NOT NULL AND flow IS NOT NULL AND y IS NOT NULL GROUP BY 1),
    c AS (SELECT period, sy / n AS my, sq / n AS mq, sf / n AS mf, qq - sq * sq / n + 0.0001 AS a, qf - sq * sf / n AS b, ff - sf * sf / n + 0.0001 AS d, qy - sq * sy / n AS u, fy - sf * sy / n AS v FROM g),
    co AS (SELECT period, (u * d - v * b) / (a * d - b * b) AS cq, (v * a - u * b) / (a * d - b * b) AS cf, my, mq, mf FROM c), cf AS (SELECT period, cq, cf, my - cq * mq - cf * mf AS c0 FROM co)"""


def _xy(spark, sf):
    return panels.weekly_returns(spark, sf).withColumn("y", F.lead("r").over(S.by()))


@query("walk_forward_periods", f"WITH {_SPANS} SELECT period, train_from, test_from, test_to, count(*) AS cells FROM spans JOIN ret ON t_idx >= test_from AND t_idx < test_to GROUP BY 1, 2, 3, 4", ("ret",))
def walk_forward_periods(spark, sf):
    df = panels.weekly_returns(spark, sf)
    spans = walkforward.periods(df, 156, 52)
    return walkforward.rows_of(df, spans, "test").groupBy("period", "train_from", "test_from", "test_to").agg(F.count("*").alias("cells"))


@query("ridge_coefficients", f"WITH {_SPANS}, {_XY}, {_NORMAL} SELECT period, term, round(coef, 5) AS coef FROM (SELECT period, 'const' AS term, c0 AS coef FROM cf UNION ALL SELECT period, 'q', cq FROM cf UNION ALL SELECT period, 'flow', cf FROM cf)", ("ret",))
def ridge_coefficients(spark, sf):
    df = _xy(spark, sf)
    fit = walkforward.ridge(walkforward.rows_of(df, walkforward.periods(df, 156, 52), "train"), "y", ["q", "flow"])
    return fit.select("period", "term", F.round("coef", 5).alias("coef"))


@query(
    "walk_forward_pnl",
    f"""WITH {_SPANS}, {_XY}, {_NORMAL}, v AS (SELECT asset, t_idx, CASE WHEN count(r) OVER f >= 12 THEN stddev_samp(r) OVER f END AS sd FROM ret WINDOW f AS (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)),
    s AS (SELECT xy.t_idx, xy.asset, c0 + cq * q + cf.cf * flow AS signal, lead(r, 2) OVER (PARTITION BY xy.asset ORDER BY xy.t_idx) AS r2, lead(sd, 2) OVER (PARTITION BY xy.asset ORDER BY xy.t_idx) AS s2 FROM xy JOIN spans ON xy.t_idx >= test_from AND xy.t_idx < test_to JOIN cf USING (period) JOIN v ON v.asset = xy.asset AND v.t_idx = xy.t_idx)
    SELECT t_idx, round(avg(signal * 0.1 / (s2 * sqrt(52) + 1e-10) * r2), 6) AS pnl, count(signal * s2 * r2) AS n FROM s GROUP BY 1 HAVING count(signal * s2 * r2) > 0""",
    ("ret",),
)
def walk_forward_pnl(spark, sf):
    """Ridge signals, refitted each year, traded two weeks late at a volatility target."""
    df = _xy(spark, sf).withColumn("sd", S.rolling(F.stddev_samp, "r", 26, 12))
    made = walkforward.fitted_signal(df, walkforward.periods(df, 156, 52), "y", ["q", "flow"])
    return rounded(walkforward.positions_pnl(made, "signal"), "t_idx", "n", pnl="pnl")


@query(
    "network_strategies",
    """WITH v AS (SELECT *, CASE WHEN count(r) OVER f >= 12 THEN stddev_samp(r) OVER f END AS sd FROM ret WINDOW f AS (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)),
    y AS (SELECT t, t_idx, asset, r, sd, ln(price / lag(price, 13) OVER w) / (sd * sqrt(13) + 1e-10) AS m FROM v WINDOW w AS (PARTITION BY asset ORDER BY t_idx)), z AS (SELECT *, avg(m) OVER (PARTITION BY t_idx) AS nm, lead(r, 2) OVER (PARTITION BY asset ORDER BY t_idx) AS r2, lead(sd, 2) OVER (PARTITION BY asset ORDER BY t_idx) AS s2 FROM y),
    u AS (SELECT t_idx, f.strategy, f.s * 0.1 / (s2 * sqrt(52) + 1e-10) * r2 AS x FROM z, LATERAL (VALUES ('long', 1.0::DOUBLE), ('trend', m * exp(-m * m / 4) / 0.89), ('own', sign(m)::DOUBLE), ('network', sign(nm)::DOUBLE)) AS f(strategy, s))
    SELECT strategy, count(x) AS n, round(avg(x), 8) AS mean FROM u GROUP BY 1""",
    ("ret",),
)
def network_strategies(spark, sf):
    """Long only, the trend response, the sign of the own trend and of the neighbours' (here all assets')."""
    df = panels.weekly_returns(spark, sf).withColumn("sd", S.rolling(F.stddev_samp, "r", 26, 12))
    df = df.withColumn("m", S.log_return(k=13) / (F.col("sd") * 13**0.5 + 1e-10))
    df = df.withColumns({"nm": F.avg("m").over(W.partitionBy("t_idx")), "r2": F.lead("r", 2).over(S.by()), "s2": F.lead("sd", 2).over(S.by())})
    kinds = {"long": F.lit(1.0), "trend": S.response("m"), "own": F.signum("m"), "network": F.signum("nm")}
    long = df.select("t_idx", "r2", "s2", F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), c.alias("s")) for n, c in kinds.items()])).alias("k"))
    x = F.col("k.s") * 0.1 / (F.col("s2") * 52**0.5 + 1e-10) * F.col("r2")
    return long.groupBy("k.strategy").agg(F.count(x).alias("n"), F.round(F.avg(x), 8).alias("mean"))


@query(
    "refit_schedule",
    """WITH s AS (SELECT t_idx, string_agg(asset, ',' ORDER BY asset) AS s, count(*) AS assets FROM mret WHERE r IS NOT NULL GROUP BY 1), n AS (SELECT *, CASE WHEN t_idx % 6 = 0 OR s <> lag(s) OVER (ORDER BY t_idx) OR lag(s) OVER (ORDER BY t_idx) IS NULL THEN t_idx END AS f FROM s)
    SELECT t_idx, last_value(f IGNORE NULLS) OVER (ORDER BY t_idx ROWS UNBOUNDED PRECEDING) AS fit_idx, assets FROM n""",
    ("mret",),
)
def refit_schedule(spark, sf):
    return walkforward.refit_schedule(panels.monthly_returns(spark, sf), 6)


# --- trend features ------------------------------------------------------------------------------

_ALPHAS = {"e2": "1.0/2", "e4": "1.0/4", "e8": "1.0/8", "e6": "1.0/6", "e12": "1.0/12", "e24": "1.0/24"}
_EWMAS = "en AS (SELECT asset, t, t_idx, k, price, {first} FROM x WHERE k = 1 UNION ALL SELECT x.asset, x.t, x.t_idx, x.k, x.price, {next} FROM en JOIN x ON x.asset = en.asset AND x.k = en.k + 1)"


@query(
    "macd_speeds",
    "WITH RECURSIVE x AS (SELECT asset, t, t_idx, price, row_number() OVER (PARTITION BY asset ORDER BY t_idx) AS k FROM monthly WHERE price IS NOT NULL), "
    + _EWMAS.format(first=", ".join(f"price AS {n}" for n in _ALPHAS), next=", ".join(f"(1 - {a}) * en.{n} + {a} * x.price" for n, a in _ALPHAS.items()))
    + """, d AS (SELECT *, CASE WHEN count(*) OVER p >= 6 THEN stddev_samp(price) OVER p END + 1e-10 AS sd FROM en WINDOW p AS (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)), q AS (SELECT asset, t, t_idx, (e2 - e6) / sd AS a, (e4 - e12) / sd AS b, (e8 - e24) / sd AS c FROM d)
    SELECT t, asset, round(a / (CASE WHEN count(a) OVER v >= 12 THEN stddev_samp(a) OVER v END + 1e-10), 4) AS macd_2, round(b / (CASE WHEN count(b) OVER v >= 12 THEN stddev_samp(b) OVER v END + 1e-10), 4) AS macd_4, round(c / (CASE WHEN count(c) OVER v >= 12 THEN stddev_samp(c) OVER v END + 1e-10), 4) AS macd_8 FROM q WINDOW v AS (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""",
    ("monthly",),
)
def macd_speeds(spark, sf):
    df = trend.macd_features(panels.monthly(spark, sf), [(2, 6), (4, 12), (8, 24)], 12, 24)
    return df.select("t", "asset", *[F.round(f"macd_{k}", 4).alias(f"macd_{k}") for k in (2, 4, 8)])


@query(
    "oscillators",
    "WITH RECURSIVE pa AS (SELECT asset, t_idx, sum(coalesce(r, 0)) OVER (PARTITION BY asset ORDER BY t_idx) AS price, t FROM mret), x AS (SELECT *, t_idx + 1 AS k FROM pa), "
    + _EWMAS.format(first=", ".join(f"price AS {p}{k}" for k in (1, 2, 3) for p in "fs"), next=", ".join(f"(1 - {a}) * en.{p}{k} + {a} * x.price" for k in (1, 2, 3) for p, a in (("f", 0.5**k), ("s", 0.5**k / 4))))
    + " SELECT t, asset, " + ", ".join(f"CASE WHEN k >= {4 * 2**k} THEN round(f{k} - s{k}, 6) END AS osc_{k}" for k in (1, 2, 3)) + " FROM en",
    ("mret",),
)
def oscillators(spark, sf):
    df = panels.monthly_returns(spark, sf).withColumn("x", S.cumulative(F.coalesce("r", F.lit(0.0))))
    return rounded(trend.oscillators(df, (1, 2, 3)), "t", "asset", **{f"osc_{k}": f"osc_{k}" for k in (1, 2, 3)})


@query(
    "look_back_stack",
    """WITH f AS (SELECT asset, t_idx, r, q, CASE WHEN r IS NOT NULL AND q IS NOT NULL THEN 1 END AS ok FROM ret), w AS (SELECT unnest([4, 13])::INT AS win), c AS (SELECT win, a.t_idx, a.asset, count(b.ok) AS n, sum(b.r) AS sr FROM w CROSS JOIN f a JOIN f b ON b.asset = a.asset AND b.t_idx BETWEEN a.t_idx - win AND a.t_idx - 1 GROUP BY 1, 2, 3),
    g AS (SELECT *, count(*) OVER (PARTITION BY win, t_idx) AS m FROM c WHERE n = win) SELECT win, t_idx, count(*) AS assets, round(sum(sr), 6) AS total FROM g WHERE m >= 5 GROUP BY 1, 2""",
    ("ret",),
)
def look_back_stack(spark, sf):
    """How many assets have a whole stack, and the sum of the stack's first feature."""
    df = panels.weekly_returns(spark, sf)
    stack = trend.look_back_stack(df, ["r", "q"], [4, 13])
    long = trend.stacked(df, ["r", "q"], stack).where("k % 2 = 0")
    return long.groupBy("win", F.col("t").alias("t_idx")).agg(F.count_distinct("asset").alias("assets"), r6(F.sum("v"), "total"))


@query(
    "derivative_and_shape",
    """WITH o AS (SELECT asset, t_idx, r AS v, lag(r) OVER w AS b, lead(r) OVER w AS a, first_value(r) OVER w AS f, last_value(r) OVER (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, lag(r, 2) OVER w AS b2, lead(r, 2) OVER w AS a2 FROM mret WHERE r IS NOT NULL WINDOW w AS (PARTITION BY asset ORDER BY t_idx)),
    s AS (SELECT *, [coalesce(b2, f), coalesce(b, f), v, coalesce(a, l), coalesce(a2, l)] AS p FROM o)
    SELECT asset, t_idx, round(CASE WHEN b IS NULL THEN a - v WHEN a IS NULL THEN v - b ELSE ((v - b) + (a - b) / 2) / 2 END, 6) AS derivative, round((p[1] - list_avg(p)) / (list_stddev_pop(p) + 1e-10), 5) AS s0, round((p[5] - list_avg(p)) / (list_stddev_pop(p) + 1e-10), 5) AS s4 FROM s""",
    ("mret",),
)
def derivative_and_shape(spark, sf):
    df = panels.monthly_returns(spark, sf).where("r is not null")
    df = trend.with_shape(trend.with_derivative(df, "r", "derivative"), "r", "shape")
    return df.select("asset", "t_idx", r6("derivative", "derivative"), F.round(F.col("shape")[0], 5).alias("s0"), F.round(F.col("shape")[4], 5).alias("s4"))


# --- resampling ----------------------------------------------------------------------------------

_BOOT = """n AS (SELECT count(*) AS n FROM mcal), ix AS (SELECT s AS sample, p AS pos, ((('0x' || substr(md5('42-' || s || '-' || (p // 6)), 1, 12))::BIGINT % n) + p % 6) % n AS t_idx FROM n, LATERAL (SELECT unnest(range(20)) AS s), LATERAL (SELECT unnest(range(n)) AS p)),
    bs AS (SELECT sample, asset, avg(r) / stddev_samp(r) * sqrt(12) AS sharpe FROM ix JOIN mret USING (t_idx) GROUP BY 1, 2)"""


def _boot(spark, sf):
    m = panels.monthly_returns(spark, sf).select("t_idx", F.col("asset").alias("strategy"), "r")
    return resampling.compare(resampling.resample(m, resampling.block_index(m, 6, 20)))


@query("bootstrap_sharpe", f"WITH {_BOOT} SELECT sample, asset AS strategy, round(sharpe, 6) AS sharpe FROM bs", ("mret",))
def bootstrap_sharpe(spark, sf):
    return rounded(_boot(spark, sf), "sample", "strategy", sharpe="sharpe")


@query(
    "significance_table",
    f"""WITH {_BOOT}, p AS (SELECT a.sample, a.asset AS strategy, a.sharpe, b.sharpe AS base FROM bs a JOIN bs b ON b.sample = a.sample AND b.asset = 'Brand#11' WHERE a.asset <> 'Brand#11'),
    d AS (SELECT strategy, sharpe - base AS d FROM p WHERE sharpe <> base), rk AS (SELECT *, rank() OVER (PARTITION BY strategy ORDER BY abs(d)) + (count(*) OVER (PARTITION BY strategy, abs(d)) - 1) / 2.0 AS k FROM d), w AS (SELECT strategy, sum(CASE WHEN d > 0 THEN k ELSE 0 END) AS w_stat FROM rk GROUP BY 1),
    v AS (SELECT strategy, sharpe AS v, 1 AS own FROM p UNION ALL SELECT strategy, base, 0 FROM p), c AS (SELECT strategy, v, sum(own) AS a, sum(1 - own) AS b FROM v GROUP BY 1, 2), e AS (SELECT strategy, sum(b) OVER r / sum(b) OVER (PARTITION BY strategy) - sum(a) OVER r / sum(a) OVER (PARTITION BY strategy) AS gap FROM c WINDOW r AS (PARTITION BY strategy ORDER BY v)),
    k AS (SELECT strategy, greatest(max(gap), 0) AS ks_stat FROM e GROUP BY 1), m AS (SELECT strategy, avg(sharpe) AS mean, avg(base) AS base_mean FROM p GROUP BY 1)
    SELECT strategy, round(mean, 6) AS mean, round(base_mean, 6) AS base_mean, round(w_stat, 6) AS w_stat, round(ks_stat, 6) AS ks_stat FROM m JOIN w USING (strategy) JOIN k USING (strategy)""",
    ("mret",),
)
def significance_table(spark, sf):
    """The probabilities have no SQL and are tested against enumeration."""
    return rounded(resampling.significance(_boot(spark, sf), "Brand#11"), "strategy", mean="mean", base_mean="base_mean", w_stat="w_stat", ks_stat="ks_stat")


@query(
    "rebuilt_prices",
    f"WITH {_BOOT} SELECT sample, asset, pos AS t_idx, round(100 * exp(sum(coalesce(r, 0)) OVER (PARTITION BY sample, asset ORDER BY pos)), 5) AS price FROM ix JOIN mret USING (t_idx) WHERE sample < 2",
    ("mret",),
)
def rebuilt_prices(spark, sf):
    m = panels.monthly_returns(spark, sf).select("t_idx", "asset", "r")
    rows = resampling.rebuild_prices(resampling.resample(m, resampling.block_index(m, 6, 2)))
    return rows.select("sample", "asset", "t_idx", F.round("price", 5).alias("price"))


# --- spreads -------------------------------------------------------------------------------------

_NEXT = "CASE WHEN z.z IS NULL THEN s.st WHEN s.st = 0 THEN CASE WHEN z.z > {e} THEN -1 WHEN z.z < -{e} THEN 1 ELSE 0 END WHEN s.st = 1 AND z.z > -{x} THEN 0 WHEN s.st = -1 AND z.z < {x} THEN 0 ELSE s.st END"
_TRADED = f"""z AS (SELECT asset, t, t_idx, r, {_Z} AS z FROM ret {_F})"""


@query(
    "spread_trades",
    f"""WITH RECURSIVE {_TRADED}, s AS (SELECT asset, t_idx, CASE WHEN z > 1 THEN -1 WHEN z < -1 THEN 1 ELSE 0 END AS st, z IS NULL AS gap FROM z WHERE t_idx = 0 UNION ALL SELECT z.asset, z.t_idx, {_NEXT.format(e=1, x=0.25)}, z.z IS NULL FROM s JOIN z ON z.asset = s.asset AND z.t_idx = s.t_idx + 1),
    p AS (SELECT s.asset, s.t_idx, CASE WHEN gap THEN 0 ELSE st END AS pos, z.r FROM s JOIN z ON z.asset = s.asset AND z.t_idx = s.t_idx) SELECT asset, t_idx, pos::BIGINT AS position, round(coalesce(lag(pos, 2) OVER w * (r - lag(r) OVER w), 0), 6) AS pnl FROM p WINDOW w AS (PARTITION BY asset ORDER BY t_idx)""",
    ("ret",),
)
def spread_trades(spark, sf):
    """The two-threshold rule on returns' scores, traded a period late."""
    return rounded(spreads.trade(_z(spark, sf), "r", "z", 1.0, 0.25, lag=1), "asset", "t_idx", "position", pnl="pnl")


@query(
    "threshold_grid",
    f"""WITH RECURSIVE {_TRADED}, g AS (SELECT e, x FROM (SELECT unnest([0.75, 1.0, 1.5, 2.0])::DOUBLE AS e), (SELECT unnest([0.0, 0.25, 0.75])::DOUBLE AS x) WHERE x < e),
    s AS (SELECT asset, t_idx, e, x, CASE WHEN z > e THEN -1 WHEN z < -e THEN 1 ELSE 0 END AS st, z IS NULL AS gap FROM z, g WHERE t_idx = 0 UNION ALL SELECT z.asset, z.t_idx, s.e, s.x, {_NEXT.format(e='s.e', x='s.x')}, z.z IS NULL FROM s JOIN z ON z.asset = s.asset AND z.t_idx = s.t_idx + 1),
    p AS (SELECT s.*, CASE WHEN gap THEN 0 ELSE st END AS pos, z.r FROM s JOIN z ON z.asset = s.asset AND z.t_idx = s.t_idx), d AS (SELECT e, x, pos, coalesce(lag(pos) OVER w * (r - lag(r) OVER w), 0) AS pnl, CASE WHEN pos <> coalesce(lag(pos) OVER w, 0) THEN 1 ELSE 0 END AS moved FROM p WINDOW w AS (PARTITION BY asset, e, x ORDER BY t_idx))
    SELECT e AS enter, x AS leave, count(*) AS n, round(CASE WHEN stddev_samp(pnl) > 0 THEN avg(pnl) / stddev_samp(pnl) * sqrt(252) ELSE 0 END, 5) AS sharpe, round(avg(CASE WHEN pos <> 0 THEN 1.0 ELSE 0.0 END), 6) AS on_share, sum(moved)::BIGINT AS trades FROM d GROUP BY 1, 2""",
    ("ret",),
)
def threshold_grid(spark, sf):
    out = spreads.grid(_z(spark, sf), "r", "z", [0.75, 1.0, 1.5, 2.0], [0.0, 0.25, 0.75])
    return out.select("enter", "leave", "n", F.round("sharpe", 5).alias("sharpe"), r6("on_share", "on_share"), "trades")


@query(
    "unit_root_statistics",
    f"""WITH {_SPREAD}, o AS (SELECT asset, t_idx, y - x AS s FROM sp WHERE y IS NOT NULL), d AS (SELECT asset, lag(s) OVER w AS x, s - lag(s) OVER w AS y FROM o WINDOW w AS (PARTITION BY asset ORDER BY t_idx)),
    m AS (SELECT asset, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) AS v FROM d WHERE x IS NOT NULL GROUP BY 1 HAVING count(*) > 4) SELECT asset, round(b / sqrt(v / sxx), 5) AS stat FROM m""",
    ("ret",),
)
def unit_root_statistics(spark, sf):
    """Without lagged steps, which SQL can say; chosen lags are tested apart."""
    rows = _spread_panel(spark, sf).where("y is not null").select("asset", "t_idx", (F.col("y") - F.col("x")).alias("s"))
    return screening.unit_root_by(rows, "s", lags=0).select("asset", F.round("stat", 5).alias("stat"))


@query("hedge_screen")
def hedge_screen(spark, sf):
    """Each brand as a hedge of the mean of all, by an augmented unit-root test."""
    p = _spread_panel(spark, sf).select("asset", "t_idx", F.col("y").alias("x"), F.col("x").alias("y"))
    return rounded(screening.screen(p), "asset", "kept", gamma="gamma", p_value="p_value")


@query("hedge_basket")
def hedge_basket(spark, sf):
    p = _spread_panel(spark, sf).select("asset", "t_idx", F.col("y").alias("x"), F.col("x").alias("y"))
    return rounded(screening.basket(p, screening.screen(p, 0.5), 0.5), "t_idx", "assets", gamma="gamma", spread="spread", p_value="p_value")


@query("kalman_basket")
def kalman_basket(spark, sf):
    p = _spread_panel(spark, sf).select("asset", "t_idx", F.col("y").alias("x"), F.col("x").alias("y"))
    out = screening.kalman_hedge(p, ["Brand#11", "Brand#12", "Brand#13"], 100)
    return rounded(out, "t_idx", spread="spread", mu="mu")
