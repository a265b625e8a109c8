"""Queries of decompositions, sorts, regimes and performance."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quantweave.functions import series as S
from quantweave.operators import performance as P
from quantweave.operators import regression as G
from quantweave.operators import sorts as Q
from quantweave.sources import panels

from .registry import query
from .series import r6, rounded, unsigned_zeros


@query(
    "decompose_cross_section",
    """WITH b AS (SELECT t, regr_slope(r, q) AS b FROM ret WHERE r IS NOT NULL AND q IS NOT NULL GROUP BY t HAVING count(*) >= 5)
    SELECT t, asset, round(b, 6) + 0.0 AS slope, round(b * q, 6) + 0.0 AS fitted, round(r - b * q, 6) + 0.0 AS residual FROM ret JOIN b USING (t) WHERE r IS NOT NULL AND q IS NOT NULL""",
    ("ret",),
)
def decompose_cross_section(spark, sf):
    return unsigned_zeros(rounded(G.decompose_cross_section(panels.weekly_returns(spark, sf)), "t", "asset", slope="slope", fitted="fitted", residual="residual"), "slope", "fitted", "residual")


@query(
    "decompose_rolling",
    """WITH b AS (SELECT *, CASE WHEN count(CASE WHEN r IS NOT NULL AND q IS NOT NULL THEN 1 END) OVER f >= 26 THEN regr_slope(r, q) OVER f END AS b FROM ret WINDOW f AS (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN 51 PRECEDING AND CURRENT ROW))
    SELECT t, asset, round(b, 6) + 0.0 AS slope, round(b * q, 6) + 0.0 AS fitted, round(r - b * q, 6) + 0.0 AS residual FROM b WHERE r IS NOT NULL AND q IS NOT NULL AND b IS NOT NULL""",
    ("ret",),
)
def decompose_rolling(spark, sf):
    return unsigned_zeros(rounded(G.decompose_rolling(panels.weekly_returns(spark, sf)), "t", "asset", slope="slope", fitted="fitted", residual="residual"), "slope", "fitted", "residual")


_PAIRS = "p AS (SELECT t, t_idx, asset, r, q FROM ret WHERE r IS NOT NULL AND q IS NOT NULL), win AS (SELECT c.t AS wt, p.* FROM cal c JOIN p ON p.t_idx BETWEEN c.t_idx - 51 AND c.t_idx)"


@query("pooled_slope", f"WITH {_PAIRS} SELECT wt AS t, round(regr_slope(r, q), 6) AS slope, count(*) AS n FROM win GROUP BY wt HAVING count(*) >= 100", ("ret",))
def pooled_slope(spark, sf):
    return rounded(G.pooled_slopes(panels.weekly_returns(spark, sf)), "t", slope="slope").join(_n(spark, sf, "none"), "t")


def _n(spark, sf, effects):
    return G.pooled_slopes(panels.weekly_returns(spark, sf), effects).select("t", F.col("n").cast("long").alias("n"))


for _effect in ("time", "asset"):
    _key = "wt, t" if _effect == "time" else "wt, asset"

    @query(
        f"pooled_slope_{_effect}_effects",
        f"""WITH {_PAIRS}, d AS (SELECT wt, r - avg(r) OVER (PARTITION BY {_key}) AS y, q - avg(q) OVER (PARTITION BY {_key}) AS x FROM win)
        SELECT wt AS t, round(sum(x * y) / nullif(sum(x * x), 0), 6) AS slope FROM d GROUP BY wt HAVING count(*) >= 100""",
        ("ret",),
    )
    def pooled_effects(spark, sf, effect=_effect):
        return rounded(G.pooled_slopes(panels.weekly_returns(spark, sf), effect), "t", slope="slope")


def _nw(source: str, keys: str) -> str:
    lag = " + ".join(f"2 * (1 - {h} / 7.0) * coalesce(d * lag(d, {h}) OVER (PARTITION BY {keys} ORDER BY t), 0)" for h in range(1, 7))
    return f"""d AS (SELECT *, coef - avg(coef) OVER (PARTITION BY {keys}) AS d FROM {source}), s AS (SELECT *, d * d + {lag} AS s FROM d)
    SELECT {keys}, count(*) AS "T", round(avg(coef), 6) AS mean, round(sqrt(greatest(sum(s) / count(*), 0) / count(*)), 6) AS se, round(avg(coef) / nullif(sqrt(greatest(sum(s) / count(*), 0) / count(*)), 0), 4) AS t_stat FROM s GROUP BY {keys}"""


def _fm(df):
    return df.select("term", "T", r6("mean", "mean"), r6("se", "se"), F.round("t_stat", 4).alias("t_stat"))


@query(
    "fama_macbeth_one",
    f"""WITH c AS (SELECT t, regr_slope(r, q) AS q, regr_intercept(r, q) AS const FROM ret WHERE r IS NOT NULL AND q IS NOT NULL GROUP BY t HAVING count(*) >= 5),
    l AS (SELECT t, 'q' AS term, q AS coef FROM c WHERE q IS NOT NULL UNION ALL SELECT t, 'const', const FROM c WHERE const IS NOT NULL), {_nw('l', 'term')}""",
    ("ret",),
)
def fama_macbeth_one(spark, sf):
    return _fm(G.fama_macbeth(panels.weekly_returns(spark, sf), "r", ["q"]))


@query(
    "fama_macbeth_two",
    f"""WITH m AS (SELECT t, count(*) AS n, avg(r) my, avg(q) ma, avg(vol) mb, var_pop(q) saa, var_pop(vol) sbb, covar_pop(q, vol) sab, covar_pop(q, r) say, covar_pop(vol, r) sby FROM ret WHERE r IS NOT NULL AND q IS NOT NULL AND vol IS NOT NULL GROUP BY t HAVING count(*) >= 5),
    c AS (SELECT *, (say * sbb - sby * sab) / nullif(saa * sbb - sab * sab, 0) AS q, (sby * saa - say * sab) / nullif(saa * sbb - sab * sab, 0) AS vol FROM m),
    l AS (SELECT t, 'q' AS term, q AS coef FROM c WHERE q IS NOT NULL UNION ALL SELECT t, 'vol', vol FROM c WHERE vol IS NOT NULL UNION ALL SELECT t, 'const', my - q * ma - vol * mb FROM c WHERE q IS NOT NULL), {_nw('l', 'term')}""",
    ("ret",),
)
def fama_macbeth_two(spark, sf):
    return _fm(G.fama_macbeth(panels.weekly_returns(spark, sf), "r", ["q", "vol"]))


def _sort_sql(source: str, signal: str, extra: str = "", groups: int = 3, cost: str = "") -> str:
    keys = f"t{', ' + extra if extra else ''}"
    edges = ", ".join(f"quantile_cont({signal}, {i / groups}) AS e{i}" for i in range(groups + 1))
    array = "[" + ", ".join(f"e{i}" for i in range(groups + 1)) + "]"
    return f"""sx AS (SELECT * FROM {source} WHERE {signal} IS NOT NULL AND future IS NOT NULL), se AS (SELECT {keys}, {edges} FROM sx GROUP BY {keys}),
    sb AS (SELECT sx.*, greatest(len(list_filter(list_distinct({array}), lambda x: x < {signal})) - 1, 0) AS bucket FROM sx JOIN se USING ({keys})),
    ls AS (SELECT {keys}, avg(future) FILTER (bucket = {groups - 1}) - avg(future) FILTER (bucket = 0){cost} AS ls FROM sb GROUP BY {keys}
      HAVING count(*) >= {2 * groups} AND count(*) FILTER (bucket = {groups - 1}) > 0 AND count(*) FILTER (bucket = 0) > 0)"""


def _future(df):
    return df.withColumn("future", F.lead("r").over(S.by()))


_FUT = "fut AS (SELECT *, lead(r) OVER (PARTITION BY asset ORDER BY t_idx) AS future FROM ret)"


@query("tercile_sort", f"WITH {_FUT}, {_sort_sql('fut', 'q', cost=' - 0.002')} SELECT t, round(ls, 6) AS ls FROM ls", ("ret",))
def tercile_sort(spark, sf):
    return rounded(Q.long_short(_future(panels.weekly_returns(spark, sf)), "q", cost=0.001), "t", ls="ls")


@query(
    "momentum_sorts",
    f"""WITH {_FUT}, h AS (SELECT unnest([13, 26]) AS h), mom AS (
      SELECT *, 13 AS h, CASE WHEN count(r) OVER f = 13 THEN sum(r) OVER f END AS momentum FROM fut WINDOW f AS (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING)
      UNION ALL SELECT *, 26 AS h, CASE WHEN count(r) OVER f = 26 THEN sum(r) OVER f END AS momentum FROM fut WINDOW f AS (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)),
    {_sort_sql('mom', 'momentum', 'h')} SELECT h, count(*) AS n, round(avg(ls), 6) AS mean, round(stddev_samp(ls), 6) AS std FROM ls GROUP BY h""",
    ("ret",),
)
def momentum_sorts(spark, sf):
    df = _future(panels.weekly_returns(spark, sf))
    both = [Q.with_momentum(df, "r", h).withColumn("h", F.lit(h)) for h in (13, 26)]
    ls = Q.long_short(both[0].union(both[1]), "momentum", extra=("h",))
    return ls.groupBy("h").agg(F.count("*").alias("n"), r6(F.avg("ls"), "mean"), r6(F.stddev_samp("ls"), "std"))


@query(
    "volatility_regimes",
    f"""WITH {_FUT}, v AS (SELECT *, CASE WHEN count(r) OVER f >= 26 THEN stddev_samp(r) OVER f END AS sd FROM fut WINDOW f AS (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)),
    k AS (SELECT * FROM v WHERE sd IS NOT NULL), m AS (SELECT t, quantile_cont(sd, 0.5) AS md FROM k GROUP BY t), g AS (SELECT k.*, CASE WHEN sd <= md THEN 'low' ELSE 'high' END AS regime FROM k JOIN m USING (t)),
    {_sort_sql('g', 'q', 'regime', 2)} SELECT regime, count(*) AS n, round(avg(ls), 6) AS mean FROM ls GROUP BY regime""",
    ("ret",),
)
def volatility_regimes(spark, sf):
    df = _future(panels.weekly_returns(spark, sf)).withColumn("sd", S.rolling(F.stddev_samp, "r", 52, 26)).where("sd is not null")
    ls = Q.long_short(Q.split_by_median(df, "sd"), "q", groups=2, extra=("regime",))
    return ls.groupBy("regime").agg(F.count("*").alias("n"), r6(F.avg("ls"), "mean"))


@query(
    "crowding_regimes",
    f"""WITH {_FUT}, c AS (SELECT *, sum(coalesce(flow, 0)) OVER (PARTITION BY asset ORDER BY t_idx) AS cum FROM fut),
    v AS (SELECT *, CASE WHEN count(cum) OVER f = 52 THEN cum - avg(cum) OVER f END AS crowd FROM c WINDOW f AS (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)),
    k AS (SELECT * FROM v WHERE crowd IS NOT NULL), m AS (SELECT t, quantile_cont(crowd, 0.5) AS md FROM k GROUP BY t), g AS (SELECT k.*, CASE WHEN crowd <= md THEN 'low' ELSE 'high' END AS regime FROM k JOIN m USING (t)),
    {_sort_sql('g', 'r', 'regime', 2)} SELECT regime, count(*) AS n, round(avg(ls), 6) AS mean FROM ls GROUP BY regime""",
    ("ret",),
)
def crowding_regimes(spark, sf):
    """Crowding: cumulative flow less its mean over a year."""
    df = _future(panels.weekly_returns(spark, sf)).withColumn("cum", S.cumulative(F.coalesce("flow", F.lit(0.0))))
    df = df.withColumn("crowd", F.col("cum") - S.rolling(F.avg, "cum", 52)).where("crowd is not null")
    ls = Q.long_short(Q.split_by_median(df, "crowd"), "r", groups=2, extra=("regime",))
    return ls.groupBy("regime").agg(F.count("*").alias("n"), r6(F.avg("ls"), "mean"))


def _frame(v: str, a: int, b: int) -> str:
    f = f"(PARTITION BY asset ORDER BY t_idx ROWS BETWEEN {a} FOLLOWING AND {b} FOLLOWING)"
    return f"CASE WHEN count({v}) OVER {f} >= 1 THEN avg({v}) OVER {f} END"


@query(
    "horizon_table",
    f"""WITH x AS (SELECT *, {_frame('r', 1, 3)} AS r1, {_frame('q', 1, 3)} AS q1, {_frame('r', 4, 13)} AS r2, {_frame('q', 4, 13)} AS q2 FROM ret), y AS (SELECT * FROM x WHERE flow IS NOT NULL),
    e AS (SELECT t, quantile_cont(flow, 0.0) e0, quantile_cont(flow, 1/3.0) e1, quantile_cont(flow, 2/3.0) e2, quantile_cont(flow, 1.0) e3 FROM y GROUP BY t),
    b AS (SELECT y.*, greatest(len(list_filter(list_distinct([e0, e1, e2, e3]), lambda z: z < flow)) - 1, 0)::INT AS bucket FROM y JOIN e USING (t))
    SELECT '1-3' AS horizon, bucket, round(avg(r1), 6) AS mean_r, round(avg(q1), 6) AS mean_q FROM b GROUP BY 2 UNION ALL SELECT '4-13', bucket, round(avg(r2), 6), round(avg(q2), 6) FROM b GROUP BY 2""",
    ("ret",),
)
def horizon_table(spark, sf):
    out = Q.horizon_table(panels.weekly_returns(spark, sf), "flow", ["r", "q"], [(1, 3), (4, 13)])
    return out.select("horizon", F.col("bucket").cast("int").alias("bucket"), r6("mean_r", "mean_r"), r6("mean_q", "mean_q"))


_STRAT = "st AS (SELECT asset AS strategy, t, t_idx, r, abs(coalesce(r, 0)) * 10 AS turnover FROM mret)"


def _strategies(spark, sf):
    return panels.monthly_returns(spark, sf).select(F.col("asset").alias("strategy"), "t", "t_idx", "r", (F.abs(F.coalesce("r", F.lit(0.0))) * 10).alias("turnover"))


@query(
    "performance_summary",
    f"""WITH {_STRAT}, e AS (SELECT *, CASE WHEN bool_or(r <= -1) OVER (PARTITION BY strategy ORDER BY t) THEN 0 ELSE exp(sum(CASE WHEN r > -1 THEN ln(1 + r) END) OVER (PARTITION BY strategy ORDER BY t)) END AS eq FROM st WHERE r IS NOT NULL), d AS (SELECT *, coalesce(eq / nullif(max(eq) OVER (PARTITION BY strategy ORDER BY t), 0), 0) - 1 AS dd FROM e),
    s AS (SELECT strategy, count(r) AS n, avg(r) * 12 AS ann_ret, stddev_samp(r) * sqrt(12) AS ann_vol, avg(r) / stddev_samp(r) * sqrt(12) AS sharpe, coalesce(stddev_samp(r) FILTER (r < 0), 0) * sqrt(12) AS down_dev, min(dd) AS max_dd,
      avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, coalesce(avg(r) FILTER (r > 0), 0) / greatest(abs(coalesce(avg(r) FILTER (r < 0), 0)), 1e-10) AS profit_loss, avg(r) / (stddev_samp(r) / sqrt(count(r))) AS t_stat, avg(CASE WHEN dd < 0 THEN 1.0 ELSE 0.0 END) AS under_water FROM d GROUP BY strategy)
    SELECT strategy, n, round(ann_ret, 6) AS ann_ret, round(ann_vol, 6) AS ann_vol, round(sharpe, 6) AS sharpe, round(CASE WHEN down_dev > 1e-12 THEN ann_ret / down_dev ELSE 0 END, 6) AS sortino, round(max_dd, 6) AS max_dd,
      round(CASE WHEN max_dd < -1e-12 THEN ann_ret / -max_dd ELSE 0 END, 6) AS calmar, round(hit_rate, 6) AS hit_rate, round(profit_loss, 6) AS profit_loss, round(t_stat, 6) AS t_stat, round(under_water, 6) AS under_water FROM s""",
    ("mret",),
)
def performance_summary(spark, sf):
    s = P.summary(_strategies(spark, sf), 12)
    return rounded(s, "strategy", "n", **{c: c for c in ("ann_ret", "ann_vol", "sharpe", "sortino", "max_dd", "calmar", "hit_rate", "profit_loss", "t_stat", "under_water")})


@query(
    "performance_conventions",
    f"""WITH {_STRAT} SELECT strategy, round(CASE WHEN bool_or(r <= -1) THEN -1 ELSE exp(sum(CASE WHEN r > -1 THEN ln(1 + r) END) * 12 / count(r)) - 1 END, 6) AS geometric, round(stddev_pop(r) * sqrt(12), 6) AS pop_vol, round((avg(r) - 0.04 / 12) / stddev_pop(r) * sqrt(12), 6) AS pop_sharpe,
    round(exp(sum(r) / (count(r) / 12.0)) - 1, 6) AS log_annual, round(exp(sum(r)) - 1, 4) AS cumulative FROM st GROUP BY strategy""",
    ("mret",),
)
def performance_conventions(spark, sf):
    return (
        _strategies(spark, sf)
        .groupBy("strategy")
        .agg(
            r6(P.annual_return("r", 12, "geometric"), "geometric"), r6(P.volatility("r", 12, False), "pop_vol"), r6(P.sharpe("r", 12, False, 0.04), "pop_sharpe"),
            r6(P.annual_return("r", 12, "log"), "log_annual"), F.round(F.exp(F.sum("r")) - 1, 4).alias("cumulative"),
        )
    )


@query(
    "cost_sweep",
    f"""WITH {_STRAT}, b AS (SELECT unnest([0.0, 1.0, 3.0, 10.0])::DOUBLE AS bps), n AS (SELECT strategy, bps, r - bps / 10000 * turnover AS r FROM st CROSS JOIN b)
    SELECT strategy, bps, round(avg(r) * 12, 6) AS ann_ret, round(avg(r) / stddev_samp(r) * sqrt(12), 6) AS sharpe FROM n GROUP BY 1, 2""",
    ("mret",),
)
def cost_sweep(spark, sf):
    return P.cost_sweep(_strategies(spark, sf), [0, 1, 3, 10]).groupBy("strategy", "bps").agg(r6(P.annual_return("r", 12), "ann_ret"), r6(P.sharpe("r", 12), "sharpe"))


@query(
    "breakeven_cost",
    f"""WITH {_STRAT}, b AS (SELECT range AS bps FROM range(500)), x AS (SELECT strategy, bps, r - bps / 10000.0 * coalesce(turnover, 0) AS net FROM st CROSS JOIN b WHERE r IS NOT NULL),
    n AS (SELECT strategy, bps, CASE WHEN bool_or(net <= -1) THEN -1 ELSE exp(sum(CASE WHEN net > -1 THEN ln(1 + net) END) * 12 / count(*)) - 1 END AS ann FROM x GROUP BY 1, 2)
    SELECT strategy, min(CASE WHEN ann <= 0 THEN bps END)::INT AS breakeven_bps FROM n GROUP BY 1""",
    ("mret",),
)
def breakeven_cost(spark, sf):
    return P.breakeven_cost(_strategies(spark, sf).where("r is not null"), 12)


@query(
    "crash_rate",
    f"""WITH {_STRAT}, s AS (SELECT range AS shift FROM range(12)), x AS (SELECT strategy, t_idx, coalesce(r, 0) AS r, shift, floor((t_idx - shift) / 12.0) AS block FROM st CROSS JOIN s WHERE t_idx >= shift),
    e AS (SELECT *, CASE WHEN bool_or(r <= -1) OVER (PARTITION BY strategy, shift, block ORDER BY t_idx) THEN 0 ELSE exp(sum(CASE WHEN r > -1 THEN ln(1 + r) END) OVER (PARTITION BY strategy, shift, block ORDER BY t_idx)) END AS eq FROM x), d AS (SELECT *, coalesce(eq / nullif(max(eq) OVER (PARTITION BY strategy, shift, block ORDER BY t_idx), 0), 0) - 1 AS dd FROM e),
    b AS (SELECT strategy, shift, block, count(*) AS n, min(dd) AS dd FROM d GROUP BY 1, 2, 3) SELECT strategy, round(avg(CASE WHEN dd < -0.2 THEN 1.0 ELSE 0.0 END), 6) AS crash_rate, count(*) AS blocks FROM b WHERE n = 12 GROUP BY 1""",
    ("mret",),
)
def crash_rate(spark, sf):
    return rounded(P.crash_rate(_strategies(spark, sf)), "strategy", "blocks", crash_rate="crash_rate")


@query(
    "weight_turnover",
    """WITH w AS (SELECT t, t_idx, asset, cap / sum(cap) OVER (PARTITION BY t) AS w FROM weekly) SELECT t, round(sum(abs(coalesce(w, 0) - coalesce(p, 0))), 6) AS turnover FROM (SELECT *, lag(w) OVER (PARTITION BY asset ORDER BY t_idx) AS p FROM w) GROUP BY t""",
    ("weekly",),
)
def weight_turnover(spark, sf):
    w = panels.weekly(spark, sf).withColumn("w", F.col("cap") / F.sum("cap").over(W.partitionBy("t"))).withColumn("strategy", F.lit("market"))
    return rounded(P.turnover(w), "t", turnover="turnover")


_SPREAD = "sp AS (SELECT r.asset, r.t, r.t_idx, ln(r.price) AS y, avg(ln(r.price)) OVER (PARTITION BY r.t) AS x FROM ret r)"


def _spread_panel(spark, sf):
    df = panels.weekly_returns(spark, sf).withColumn("y", F.when(F.col("price") > 0, F.log("price")))
    return df.withColumn("x", F.avg("y").over(W.partitionBy("t"))).select("t", "t_idx", "asset", "y", "x")


@query(
    "rolling_hedge_spread",
    f"""WITH {_SPREAD}, g AS (SELECT *, CASE WHEN count(x * y) OVER f = 60 THEN sum(x * y) OVER f / nullif(sum(CASE WHEN y IS NOT NULL THEN x * x END) OVER f, 0) END AS gamma FROM sp WINDOW f AS (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
    SELECT t, asset, round(gamma, 6) AS gamma, round(y - gamma * x, 6) AS spread FROM g WHERE y IS NOT NULL AND gamma IS NOT NULL""",
    ("ret",),
)
def rolling_hedge_spread(spark, sf):
    from quantweave.operators.spreads import rolling_spread

    return rounded(rolling_spread(_spread_panel(spark, sf), 60), "t", "asset", gamma="gamma", spread="spread")


@query(
    "constant_hedge_spread",
    f"""WITH {_SPREAD}, g AS (SELECT asset, sum(x * y) / sum(x * x) AS gamma FROM sp WHERE y IS NOT NULL GROUP BY asset) SELECT t, asset, round(y - gamma * x, 6) AS spread FROM sp JOIN g USING (asset) WHERE y IS NOT NULL""",
    ("ret",),
)
def constant_hedge_spread(spark, sf):
    from quantweave.operators.spreads import constant_spread

    return rounded(constant_spread(_spread_panel(spark, sf)), "t", "asset", spread="spread")


@query(
    "mean_reversion_score",
    f"""WITH {_SPREAD}, z AS (SELECT asset, t, t_idx, y - x AS s FROM sp), d AS (SELECT *, lag(s) OVER w AS x1, s - lag(s) OVER w AS d FROM z WINDOW w AS (PARTITION BY asset ORDER BY t_idx)),
    m AS (SELECT *, count(d * x1) OVER f AS n, regr_slope(d, x1) OVER f AS b, regr_intercept(d, x1) OVER f AS a, regr_syy(d, x1) OVER f AS syy, regr_sxy(d, x1) OVER f AS sxy FROM d WINDOW f AS (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
    v AS (SELECT *, (syy - b * sxy) / (n - 2) AS v FROM m WHERE n = 60)
    SELECT t, asset, round((s + a / b) / sqrt(v / (1 - (1 + b) * (1 + b))), 5) AS s_score FROM v WHERE b < 0 AND b > -2 AND v > 0 AND s IS NOT NULL""",
    ("ret",),
)
def mean_reversion_score(spark, sf):
    df = _spread_panel(spark, sf).withColumn("s", F.col("y") - F.col("x"))
    return G.s_score(df, "s").where("s_score is not null").select("t", "asset", F.round("s_score", 5).alias("s_score"))


@query(
    "kalman_slope",
    f"""WITH RECURSIVE {_SPREAD}, o AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t_idx) AS k FROM sp WHERE y IS NOT NULL),
    k AS (SELECT asset, t, k, y, x, (1.0001 * x / (x * 1.0001 * x + 0.01)) * y AS beta, 1.0001 * (1 - 1.0001 * x * x / (x * 1.0001 * x + 0.01)) AS p FROM o WHERE k = 1 UNION ALL
      SELECT o.asset, o.t, o.k, o.y, o.x, k.beta + ((k.p + 0.0001) * o.x / (o.x * (k.p + 0.0001) * o.x + 0.01)) * (o.y - o.x * k.beta), (k.p + 0.0001) * (1 - (k.p + 0.0001) * o.x * o.x / (o.x * (k.p + 0.0001) * o.x + 0.01)) FROM k JOIN o ON o.asset = k.asset AND o.k = k.k + 1)
    SELECT t, asset, round(beta, 6) AS beta, round(y - x * beta, 6) AS spread FROM k""",
    ("ret",),
)
def kalman_slope(spark, sf):
    from quantweave.operators.recursive import with_kalman

    df = with_kalman(_spread_panel(spark, sf).where("y is not null"), "y", "x", 1e-4, 1e-2)
    return rounded(df, "t", "asset", beta="kalman_beta", spread="kalman_spread")
