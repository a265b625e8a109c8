"""Queries of lead-lag scores, graphs and network features."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quantweave.functions import series as S
from quantweave.operators import graphgrid, graphs, labels, leadlag, trend
from quantweave.operators import recursive as R
from quantweave.sources import panels
from quantweave.sources.stored import stored

from .registry import query
from .series import r6, rounded, unsigned_zeros


def _window(spark, sf):
    """Monthly returns of all assets as one window."""
    return panels.monthly_returns(spark, sf).select(F.lit(0).alias("win"), "t_idx", "asset", F.col("r").alias("v"))


_LAG = """v AS (SELECT asset, t_idx, r AS x, lag(r, 1) OVER w AS p1, lag(r, 2) OVER w AS p2, lag(r, 3) OVER w AS p3 FROM mret WINDOW w AS (PARTITION BY asset ORDER BY t_idx)),
    pr AS (SELECT a.asset AS i, b.asset AS j, a.x, b.p1, b.p2, b.p3 FROM v a JOIN v b ON a.t_idx = b.t_idx AND a.asset <> b.asset WHERE a.x IS NOT NULL),
    cc AS (SELECT i, j, 1 AS lag, corr(x, p1) AS c FROM pr GROUP BY 1, 2 HAVING count(p1) >= 3 UNION ALL SELECT i, j, 2, corr(x, p2) FROM pr GROUP BY 1, 2 HAVING count(p2) >= 3 UNION ALL SELECT i, j, 3, corr(x, p3) FROM pr GROUP BY 1, 2 HAVING count(p3) >= 3)"""


@query("lagged_correlations", f"WITH {_LAG} SELECT i, j, lag::INT AS lag, round(c, 6) AS c FROM cc", ("mret",))
def lagged_correlations(spark, sf):
    return rounded(leadlag.lagged_correlations(_window(spark, sf), 3), "i", "j", F.col("lag").cast("int").alias("lag"), c="c")


for _method, _size in (("c1", "max(abs(c))"), ("c2", "avg(abs(c))")):

    @query(
        f"leadlag_{_method}",
        f"""WITH {_LAG}, o AS (SELECT i, j, {_size} AS s FROM cc GROUP BY 1, 2) SELECT a.i, a.j, round(a.s - b.s, 6) AS score FROM o a JOIN o b ON a.i = b.j AND a.j = b.i""",
        ("mret",),
    )
    def leadlag_scores(spark, sf, method=_method):
        c = leadlag.lagged_correlations(_window(spark, sf), 3)
        return rounded(leadlag.lag_scores(c, method), "i", "j", score="score")


@query("leadlag_signed", f"WITH {_LAG}, o AS (SELECT i, j, max(c) AS s FROM cc GROUP BY 1, 2) SELECT a.i, a.j, round(a.s - b.s, 6) AS score FROM o a JOIN o b ON a.i = b.j AND a.j = b.i", ("mret",))
def leadlag_signed(spark, sf):
    c = leadlag.lagged_correlations(_window(spark, sf), 3)
    return rounded(leadlag.lag_scores(c, "c1", "signed_correlation"), "i", "j", score="score")


@query(
    "leadlag_leaders",
    f"""WITH {_LAG}, o AS (SELECT i, j, max(abs(c)) AS s FROM cc GROUP BY 1, 2), m AS (SELECT a.j AS asset, sum(a.s - b.s) / (count(*) + 1) AS mean FROM o a JOIN o b ON a.i = b.j AND a.j = b.i GROUP BY 1),
    k AS (SELECT *, row_number() OVER (ORDER BY mean DESC, asset) AS hi, row_number() OVER (ORDER BY mean, asset DESC) AS lo, count(*) OVER () AS n FROM m)
    SELECT asset, CASE WHEN hi <= greatest(floor(n * 0.2), 1) THEN 'leader' ELSE 'follower' END AS side, round(mean, 6) AS mean FROM k WHERE hi <= greatest(floor(n * 0.2), 1) OR lo <= greatest(floor(n * 0.2), 1)""",
    ("mret",),
)
def leadlag_leaders(spark, sf):
    scores = leadlag.lag_scores(leadlag.lagged_correlations(_window(spark, sf), 3))
    return rounded(leadlag.pick(scores, 0.2, 0.2), "asset", "side", mean="mean")


_PATHS = """z AS ({z}), pp AS (SELECT a.t_idx, a.asset AS i, b.asset AS j, a.v AS x, b.v AS y FROM z a JOIN z b ON a.t_idx = b.t_idx AND a.asset < b.asset WHERE a.v IS NOT NULL AND b.v IS NOT NULL),
    c AS (SELECT *, sum(x) OVER w AS cx, sum(y) OVER w AS cy FROM pp WINDOW w AS (PARTITION BY i, j ORDER BY t_idx)),
    d AS (SELECT *, cx - lag(cx) OVER w AS dx, cy - lag(cy) OVER w AS dy, lag(cx) OVER w AS x0, lag(cy) OVER w AS y0 FROM c WINDOW w AS (PARTITION BY i, j ORDER BY t_idx))"""
_ZSCORE = "SELECT asset, t_idx, (r - avg(r) OVER (PARTITION BY asset)) / nullif(stddev_pop(r) OVER (PARTITION BY asset), 0) AS v FROM mret"


@query("levy_area_end_point", f"WITH {_PATHS.format(z=_ZSCORE)} SELECT i, j, round(-sum(coalesce(cx * dy - cy * dx, 0)) / 2 / count(*), 6) AS score FROM d GROUP BY 1, 2", ("mret",))
def levy_area_end_point(spark, sf):
    return rounded(leadlag.levy_end_point(leadlag.standardise(_window(spark, sf))).where("i < j"), "i", "j", score="score")


@query("levy_area_midpoint", f"WITH {_PATHS.format(z='SELECT asset, t_idx, r / stddev_samp(r) OVER (PARTITION BY asset) AS v FROM mret')} SELECT i, j, round(sum((x0 + cx) / 2 * dy - (y0 + cy) / 2 * dx) / 2, 6) AS score FROM d GROUP BY 1, 2", ("mret",))
def levy_area_midpoint(spark, sf):
    rows = _window(spark, sf).withColumn("v", F.col("v") / F.stddev_samp("v").over(W.partitionBy("asset")))
    return rounded(leadlag.levy_midpoint(rows).where("i < j"), "i", "j", score="score")


@query(
    "cross_correlation_lag",
    """WITH z AS (SELECT asset, t_idx, r - avg(r) OVER (PARTITION BY asset) AS v FROM mret), n AS (SELECT floor(count(*) / 4.0)::INT AS m FROM mcal), l AS (SELECT unnest(range(-m, m + 1)) AS lag FROM n),
    s AS (SELECT a.asset AS i, b.asset AS j, lag, sum(a.v * b.v) AS c FROM z a CROSS JOIN l JOIN z b ON b.t_idx = a.t_idx + lag AND a.asset < b.asset WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY 1, 2, 3)
    SELECT i, j, lag::BIGINT AS lag FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY c DESC, abs(lag), lag DESC) AS k FROM s) WHERE k = 1""",
    ("mret",),
)
def cross_correlation_lag(spark, sf):
    return leadlag.cross_correlation_lag(_window(spark, sf)).select("i", "j", F.col("lag").cast("long").alias("lag"))


_STRATEGY = """WITH days AS (SELECT DISTINCT t_idx FROM mret WHERE t_idx >= 23 AND t_idx <= (SELECT max(t_idx) FROM mret) - 2),
    ends AS (SELECT t_idx AS win FROM days WHERE (t_idx - 23) % 6 = 0),
    wr AS (SELECT win, t_idx, asset, r AS v FROM ends JOIN mret ON t_idx BETWEEN win - 23 AND win),
    z AS (SELECT win, t_idx, asset, (v - avg(v) OVER o) / nullif(stddev_pop(v) OVER o, 0) AS v FROM wr WINDOW o AS (PARTITION BY win, asset) QUALIFY count(v) OVER o >= 12),
    lagged AS (SELECT win, asset, t_idx, lag, lag(v, lag) OVER (PARTITION BY win, asset, lag ORDER BY t_idx) AS y FROM z CROSS JOIN (SELECT unnest([1, 2]) AS lag)),
    cor AS (SELECT a.win, a.asset AS i, b.asset AS j, b.lag, corr(a.v, y) AS c FROM z a JOIN lagged b ON a.win = b.win AND a.t_idx = b.t_idx AND a.asset <> b.asset
        WHERE a.v IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3 AND stddev_pop(a.v) > 0 AND stddev_pop(y) > 0),
    one AS (SELECT 'c1' AS method, win, i, j, max(abs(c)) AS s, sign(arg_max(c, (abs(c), -lag))) AS relation FROM cor GROUP BY 2, 3, 4
        UNION ALL SELECT 'c2', win, i, j, avg(abs(c)), sign(avg(c)) FROM cor GROUP BY 2, 3, 4),
    strength AS (SELECT method, win, i, j, coalesce(a.s, 0) - coalesce(b.s, 0) AS score, coalesce(a.relation, 0) AS relation
        FROM one a FULL JOIN (SELECT method, win, j AS i, i AS j, s FROM one) b USING (method, win, i, j)),
    pp AS (SELECT a.win, a.t_idx, a.asset AS i, b.asset AS j, a.v AS x, b.v AS y FROM z a JOIN z b ON a.win = b.win AND a.t_idx = b.t_idx AND a.asset < b.asset WHERE a.v IS NOT NULL AND b.v IS NOT NULL),
    pc AS (SELECT *, sum(x) OVER w AS cx, sum(y) OVER w AS cy FROM pp WINDOW w AS (PARTITION BY win, i, j ORDER BY t_idx)),
    pd AS (SELECT *, cx - lag(cx) OVER w AS dx, cy - lag(cy) OVER w AS dy FROM pc WINDOW w AS (PARTITION BY win, i, j ORDER BY t_idx)),
    area AS (SELECT win, i, j, CASE WHEN count(*) >= 3 THEN -sum(coalesce(cx * dy - cy * dx, 0)) / 2 / count(*) ELSE 0 END AS score FROM pd GROUP BY 1, 2, 3),
    scores AS (SELECT * FROM strength UNION ALL SELECT 'levy', win, i, j, score, 1 FROM area UNION ALL SELECT 'levy', win, j, i, -score, 1 FROM area),
    means AS (SELECT method, win, j AS asset, sum(score) / (count(*) + 1) AS m FROM scores GROUP BY 1, 2, 3),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY method, win ORDER BY m DESC, asset) AS hi, row_number() OVER (PARTITION BY method, win ORDER BY m, asset DESC) AS lo,
        greatest(floor(count(*) OVER (PARTITION BY method, win) * 0.2::DOUBLE), 1) AS k, count(*) OVER (PARTITION BY method, win) AS n FROM means),
    leader AS (SELECT method, win, asset FROM ranked WHERE 2 * k <= n AND hi <= k),
    follower AS (SELECT method, win, asset, count(*) OVER (PARTITION BY method, win) AS n FROM ranked WHERE 2 * k <= n AND hi > k AND lo <= k),
    signs AS (SELECT f.method, f.win, f.asset, any_value(f.n) AS n, CASE WHEN avg(nullif(s.relation, 0)) < 0 THEN -1.0 ELSE 1.0 END AS sgn
        FROM follower f LEFT JOIN (SELECT s.* FROM scores s JOIN leader l ON s.method = l.method AND s.win = l.win AND s.j = l.asset) s ON f.method = s.method AND f.win = s.win AND f.asset = s.i GROUP BY 1, 2, 3),
    signal AS (SELECT method, win, CASE WHEN avg(r) >= 0 THEN 1.0::DOUBLE ELSE -1.0 END AS g FROM leader LEFT JOIN mret ON t_idx = win AND mret.asset = leader.asset GROUP BY 1, 2),
    formed AS (SELECT method, win, asset, g * sgn / n AS w FROM signs JOIN signal USING (method, win) UNION ALL SELECT DISTINCT method, win, 'market', -g FROM signs JOIN signal USING (method, win)),
    priced AS (SELECT t_idx, asset, r FROM mret UNION ALL SELECT t_idx, 'market', avg(r) FROM mret GROUP BY 1),
    pnl AS (SELECT method, d.t_idx + 2 AS t_idx, sum(w * coalesce(r, 0)) AS gross FROM days d JOIN formed f ON f.win = (d.t_idx - 23) // 6 * 6 + 23 LEFT JOIN priced p ON p.t_idx = d.t_idx + 2 AND p.asset = f.asset GROUP BY 1, 2),
    moved AS (SELECT method, win, sum(abs(coalesce(f.w, 0) - coalesce(b.w, 0))) AS turnover
        FROM formed f FULL JOIN (SELECT method, win + 6 AS win, asset, w FROM formed) b USING (method, win, asset) WHERE win IN (SELECT win FROM ends) GROUP BY 1, 2)
    SELECT pnl.t_idx, round(gross - 0.0004 * coalesce(turnover, 0), 6) AS r, round(coalesce(turnover, 0), 6) AS turnover, pnl.method FROM pnl LEFT JOIN moved ON moved.method = pnl.method AND moved.win + 2 = pnl.t_idx"""


@query("leadlag_strategy", _STRATEGY, ("mret",))
def leadlag_strategy(spark, sf):
    """The three methods side by side, net of 4 bps, on months."""
    panel = stored(panels.monthly_returns(spark, sf).select("t_idx", "asset", "r"))
    market = panel.groupBy("t_idx").agg(F.avg("r").alias("r"))
    runs = [leadlag.strategy(panel, market, m, lookback=24, every=6, lags=2, least=12, cost_bps=4).withColumn("method", F.lit(m)) for m in ("c1", "c2", "levy")]
    return rounded(runs[0].union(runs[1]).union(runs[2]), "t_idx", "method", r="r", turnover="turnover")


# --- graphs -----------------------------------------------------------------------------------

_VEC = "vec AS (SELECT vec_id AS asset, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_UNIT = "u AS (SELECT asset, list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-10)) AS v FROM vec)"
_COS = f"WITH {_VEC}, {_UNIT}, hf AS (SELECT a.asset AS i, b.asset AS j, round(list_dot_product(a.v, b.v), 12) AS s FROM u a JOIN u b ON a.asset < b.asset), cs AS (SELECT * FROM hf UNION ALL SELECT j, i, s FROM hf)"
_GRAPH = f"{_COS}, cut AS (SELECT round(quantile_cont(s, 0.8), 12) AS c FROM cs WHERE s > 0), g AS (SELECT i, j, s - c AS w FROM cs, cut WHERE s > c)"


def _vectors(spark, sf):
    return graphs.whole_vectors(panels.read(spark, sf, "embeddings"), "vec_id", "embedding")


_COSINE = f"{_GRAPH} SELECT i, j, round(w, 6) AS w FROM g"
_NORMALISED = f"{_GRAPH}, d AS (SELECT i, sum(w) AS d FROM g GROUP BY i) SELECT g.i, g.j, round(w / sqrt(a.d * b.d), 6) AS w FROM g JOIN d a ON a.i = g.i JOIN d b ON b.i = g.j"
_PROPAGATED = f"""{_GRAPH}, l AS (SELECT * FROM g UNION ALL SELECT vec_id, vec_id, 1.0 FROM embeddings), d AS (SELECT i, sum(w) AS d FROM l GROUP BY i), n AS (SELECT l.i, l.j, w / sqrt(a.d * b.d) AS w FROM l JOIN d a ON a.i = l.i JOIN d b ON b.i = l.j)
    SELECT n.i AS asset, round(sum(w * embedding[1]::DOUBLE), 6) AS f1, round(sum(w * embedding[2]::DOUBLE), 6) AS f2 FROM n JOIN embeddings e ON e.vec_id = n.j GROUP BY 1"""


# all vectors; the second names are from when the first took a part only
@query("cosine_graph_all", _COSINE)
@query("cosine_graph", _COSINE)
def cosine_graph(spark, sf):
    return graphs.whole_cosine_graph(_vectors(spark, sf), 8, digits=6).select("i", "j", "w")


@query("normalised_graph_all", _NORMALISED)
@query("normalised_graph", _NORMALISED)
def normalised_graph(spark, sf):
    return graphs.whole_normalised_graph(_vectors(spark, sf), 8, digits=6).select("i", "j", "w")


@query("propagated_features_all", _PROPAGATED)
@query("propagated_features", _PROPAGATED)
def propagated_features(spark, sf):
    e = panels.read(spark, sf, "embeddings").select(F.lit(0).alias("t"), F.col("vec_id").alias("asset"), F.col("embedding")[0].cast("double").alias("f1"), F.col("embedding")[1].cast("double").alias("f2"))
    return rounded(graphs.whole_propagated(_vectors(spark, sf), 8, e, ["f1", "f2"]), "asset", f1="f1", f2="f2")


@query(
    "sparse_graph",
    f"""WITH {_LAG}, o AS (SELECT i, j, max(abs(c)) AS s FROM cc GROUP BY 1, 2), sv AS (SELECT a.i, a.j, greatest(a.s - b.s, 0) AS v FROM o a JOIN o b ON a.i = b.j AND a.j = b.i)
    SELECT x.i, x.j, round(((x.v + y.v) / 2 - 0.01) / 1.5, 6) AS w FROM sv x JOIN sv y ON x.i = y.j AND x.j = y.i WHERE (x.v + y.v) / 2 > 0.01""",
    ("mret",),
)
def sparse_graph(spark, sf):
    s = leadlag.lag_scores(leadlag.lagged_correlations(_window(spark, sf), 3)).select(F.col("win").alias("t"), "i", "j", F.col("score").alias("v"))
    return rounded(graphs.sparse_graph(s, 0.02, 0.5), "i", "j", w="w")


def _yearly(spark, sf):
    """Returns of each full year as the vectors of that year's graph."""
    m = panels.monthly_returns(spark, sf).where("r is not null")
    return m.select(F.floor(F.col("t_idx") / 12).cast("int").alias("t"), "asset", (F.col("t_idx") % 12).alias("k"), F.col("r").alias("v"))


_YEAR = """vec AS (SELECT floor(t_idx / 12.0)::INT AS t, asset, t_idx % 12 AS k, r AS v FROM mret WHERE r IS NOT NULL), u AS (SELECT t, asset, k, v / (sqrt(sum(v * v) OVER (PARTITION BY t, asset)) + 1e-10) AS v FROM vec),
    hf AS (SELECT a.t, a.asset AS i, b.asset AS j, round(sum(a.v * b.v), 12) AS s FROM u a JOIN u b USING (t, k) WHERE a.asset < b.asset GROUP BY 1, 2, 3), cs AS (SELECT * FROM hf UNION ALL SELECT t, j, i, s FROM hf), cut AS (SELECT t, round(quantile_cont(s, 0.5), 12) AS c FROM cs WHERE s > 0 GROUP BY t),
    g AS (SELECT t, i, j, s - c AS w FROM cs JOIN cut USING (t) WHERE s > c)"""


@query(
    "graph_topology",
    f"""WITH {_YEAR}, e AS (SELECT t, i, j FROM g WHERE i < j), n AS (SELECT t, count(DISTINCT asset) AS n FROM vec GROUP BY t), b AS (SELECT t, n, lag(t) OVER (ORDER BY t) AS before FROM n),
    c AS (SELECT t, count(*) AS m FROM e GROUP BY t), sh AS (SELECT e.t, count(*) AS same FROM e JOIN b ON b.t = e.t JOIN e f ON f.t = b.before AND f.i = e.i AND f.j = e.j GROUP BY 1)
    SELECT b.t, n, coalesce(c.m, 0) AS edges, round(2.0 * coalesce(c.m, 0) / (n * (n - 1)), 6) AS density, round(2.0 * coalesce(c.m, 0) / n, 6) AS mean_degree,
      round(CASE WHEN before IS NULL OR coalesce(c.m, 0) + coalesce(l.m, 0) - coalesce(same, 0) = 0 THEN 1.0 ELSE coalesce(same, 0)::DOUBLE / (coalesce(c.m, 0) + coalesce(l.m, 0) - coalesce(same, 0)) END, 6) AS jaccard
    FROM b LEFT JOIN c ON c.t = b.t LEFT JOIN c l ON l.t = b.before LEFT JOIN sh ON sh.t = b.t""",
    ("mret",),
)
def graph_topology(spark, sf):
    rows = _yearly(spark, sf)
    return rounded(graphs.topology(graphs.cosine_graph(rows, 5), rows.select("t", "asset").distinct()), "t", "n", "edges", density="density", mean_degree="mean_degree", jaccard="jaccard")


@query("graph_ensemble", f"WITH {_YEAR} SELECT i, j, round(sum(w) / (SELECT count(DISTINCT t) FROM g), 6) AS w FROM g GROUP BY 1, 2", ("mret",))
def graph_ensemble(spark, sf):
    g = graphs.cosine_graph(_yearly(spark, sf), 5).withColumnRenamed("t", "win").withColumn("t", F.lit(0))
    return rounded(graphs.ensemble(g), "i", "j", w="w")


# --- trend features ----------------------------------------------------------------------------

_EWMA = """{name} AS (SELECT asset, t, t_idx, k, price AS y FROM x WHERE k = 1 UNION ALL SELECT x.asset, x.t, x.t_idx, x.k, (1 - {a}) * e.y + {a} * x.price FROM {name} e JOIN x ON x.asset = e.asset AND x.k = e.k + 1)"""


@query(
    "normalised_macd",
    f"""WITH RECURSIVE x AS (SELECT asset, t, t_idx, price, row_number() OVER (PARTITION BY asset ORDER BY t_idx) AS k FROM monthly WHERE price IS NOT NULL), {_EWMA.format(name='f', a='0.5')}, {_EWMA.format(name='s', a='0.125')},
    m AS (SELECT f.asset, f.t, f.t_idx, (f.y - s.y) / (CASE WHEN count(x.price) OVER p >= 6 THEN stddev_samp(x.price) OVER p END + 1e-10) AS q FROM f JOIN s ON s.asset = f.asset AND s.k = f.k JOIN x ON x.asset = f.asset AND x.k = f.k WINDOW p AS (PARTITION BY f.asset ORDER BY f.t_idx ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
    SELECT t, asset, round(q / (CASE WHEN count(q) OVER v >= 12 THEN stddev_samp(q) OVER v END + 1e-10), 5) AS macd FROM m WINDOW v AS (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""",
    ("monthly",),
)
def normalised_macd(spark, sf):
    df = panels.monthly(spark, sf).where("price is not null")
    df = R.with_ewma(R.with_ewma(df, "price", "fast", 0.5), "price", "slow", 0.125)
    df = df.withColumn("q", (F.col("fast") - F.col("slow")) / (S.rolling(F.stddev_samp, "price", 12, 6) + 1e-10))
    return df.select("t", "asset", F.round(F.col("q") / (S.rolling(F.stddev_samp, "q", 24, 12) + 1e-10), 5).alias("macd"))


@query(
    "vol_scaled_momentum",
    """WITH v AS (SELECT *, CASE WHEN count(r) OVER f >= 12 THEN stddev_samp(r) OVER f END AS sd FROM ret WINDOW f AS (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)),
    y AS (SELECT t, asset, ln(price / lag(price, 4) OVER w) / (sd * 2 + 1e-10) AS m4, ln(price / lag(price, 13) OVER w) / (sd * sqrt(13) + 1e-10) AS m13 FROM v WINDOW w AS (PARTITION BY asset ORDER BY t_idx))
    SELECT t, asset, round(m4, 6) AS m4, round(m13, 6) AS m13, round((m4 * exp(-m4 * m4 / 4) / 0.89 + m13 * exp(-m13 * m13 / 4) / 0.89) / 2, 6) AS signal FROM y WHERE m4 IS NOT NULL AND m13 IS NOT NULL""",
    ("ret",),
)
def vol_scaled_momentum(spark, sf):
    df = panels.weekly_returns(spark, sf).withColumn("sd", S.rolling(F.stddev_samp, "r", 26, 12))
    df = df.withColumns({f"m{k}": S.log_return(k=k) / (F.col("sd") * k**0.5 + 1e-10) for k in (4, 13)}).where("m4 is not null and m13 is not null")
    return rounded(df, "t", "asset", m4="m4", m13="m13", signal=(S.response("m4") + S.response("m13")) / 2)


@query(
    "trend_positions",
    """WITH v AS (SELECT *, CASE WHEN count(r) OVER f >= 12 THEN stddev_samp(r) OVER f END AS sd FROM ret WINDOW f AS (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)),
    y AS (SELECT t, t_idx, asset, r, sd, ln(price / lag(price, 13) OVER w) / (sd * sqrt(13) + 1e-10) AS m FROM v WINDOW w AS (PARTITION BY asset ORDER BY t_idx)),
    p AS (SELECT *, lead(r, 2) OVER (PARTITION BY asset ORDER BY t_idx) AS r2, m * exp(-m * m / 4) / 0.89 * 0.1 / (sd * sqrt(52) + 1e-10) AS pos FROM y)
    SELECT t, round(avg(pos * r2), 8) AS pnl, count(pos * r2) AS n FROM p GROUP BY t HAVING count(pos * r2) > 0""",
    ("ret",),
)
def trend_positions(spark, sf):
    """Volatility-targeted trend positions; the profit of t + 2 is stamped t."""
    df = panels.weekly_returns(spark, sf).withColumn("sd", S.rolling(F.stddev_samp, "r", 26, 12))
    df = df.withColumns({"m": S.log_return(k=13) / (F.col("sd") * 13**0.5 + 1e-10), "r2": F.lead("r", 2).over(S.by())})
    pos = S.response("m") * 0.1 / (F.col("sd") * 52**0.5 + 1e-10)
    return df.withColumn("x", pos * F.col("r2")).groupBy("t").agg(F.round(F.avg("x"), 8).alias("pnl"), F.count("x").alias("n")).where("n > 0")


@query(
    "ridge_moments",
    """WITH x AS (SELECT q, flow, lead(r) OVER (PARTITION BY asset ORDER BY t_idx) AS y FROM ret) SELECT count(*) AS n, round(sum(q * q), 6) AS qq, round(sum(q * flow), 6) AS qf, round(sum(flow * flow), 6) AS ff, round(sum(q * y), 6) AS qy, round(sum(flow * y), 6) AS fy, round(sum(q), 6) AS q1, round(sum(flow), 6) AS f1, round(sum(y), 6) AS y1
    FROM x WHERE q IS NOT NULL AND flow IS NOT NULL AND y IS NOT NULL""",
    ("ret",),
)
def ridge_moments(spark, sf):
    """The Gram matrix of the pooled ridge regression."""
    df = panels.weekly_returns(spark, sf).withColumn("y", F.lead("r").over(S.by())).where("q is not null and flow is not null and y is not null")
    p = lambda a, b: F.sum(F.col(a) * F.col(b))
    return df.agg(F.count("*").alias("n"), *[r6(v, k) for k, v in {"qq": p("q", "q"), "qf": p("q", "flow"), "ff": p("flow", "flow"), "qy": p("q", "y"), "fy": p("flow", "y"), "q1": F.sum("q"), "f1": F.sum("flow"), "y1": F.sum("y")}.items()])


# --- labels --------------------------------------------------------------------------------------


def _features(spark, sf):
    return labels.features(panels.monthly_returns(spark, sf))


_FEAT = """base AS (SELECT *, ln(1 + coalesce(r, 0)) AS lr FROM mret), x AS (SELECT t, t_idx, asset, r AS x1, {x}, 100 * exp(sum(lr) OVER (PARTITION BY asset ORDER BY t_idx)) AS cap_proxy, lead(r) OVER (PARTITION BY asset ORDER BY t_idx) AS ret_fwd FROM base),
    k AS (SELECT *, rank() OVER (PARTITION BY t ORDER BY cap_proxy) + (count(*) OVER (PARTITION BY t, cap_proxy) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY t) AS n, {m} FROM x),
    ft AS (SELECT t, t_idx, asset, {z}, least(greatest(ceil(10 * rk / n), 1), 10)::INT AS size, ret_fwd FROM k WHERE {ok})""".format(
    x=", ".join(f"CASE WHEN count(lr) OVER (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN {m - 1} PRECEDING AND 1 PRECEDING) = {m - 1} THEN exp(sum(lr) OVER (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN {m - 1} PRECEDING AND 1 PRECEDING)) - 1 END AS x{m}" for m in (3, 6, 9, 12)),
    m=", ".join(f"avg(x{m}) OVER (PARTITION BY t) AS m{m}, stddev_samp(x{m}) OVER (PARTITION BY t) AS s{m}, count(x{m}) OVER (PARTITION BY t) AS n{m}" for m in (1, 3, 6, 9, 12)),
    z=", ".join(f"CASE WHEN s{m} > 1e-8 THEN (x{m} - m{m}) / s{m} ELSE x{m} * 0 END AS z{m}" for m in (1, 3, 6, 9, 12)),
    ok=" AND ".join(f"n{m} >= 5 AND x{m} IS NOT NULL" for m in (1, 3, 6, 9, 12)),
)


@query("momentum_features", f"WITH {_FEAT} SELECT t, asset, round(z1, 5) AS z1, round(z3, 5) AS z3, round(z6, 5) AS z6, round(z9, 5) AS z9, round(z12, 5) AS z12, size, round(ret_fwd, 6) AS ret_fwd FROM ft", ("mret",))
def momentum_features(spark, sf):
    return _features(spark, sf).select("t", "asset", *[F.round(f"z{m}", 5).alias(f"z{m}") for m in (1, 3, 6, 9, 12)], "size", r6("ret_fwd", "ret_fwd"))


_CLS = """e AS (SELECT t, quantile_cont(ret_fwd, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM ft WHERE ret_fwd IS NOT NULL GROUP BY t),
    cl AS (SELECT ft.*, greatest(len(list_filter(list_distinct(e), lambda v: v < ret_fwd)) - 1, 0)::INT AS cls FROM ft JOIN e USING (t) WHERE ret_fwd IS NOT NULL)"""


@query("return_classes", f"WITH {_FEAT}, {_CLS} SELECT t, asset, cls FROM cl", ("mret",))
def return_classes(spark, sf):
    return labels.return_class(_features(spark, sf)).select("t", "asset", "cls")


@query(
    "class_statistics",
    f"WITH {_FEAT}, {_CLS} SELECT k::INT AS cls, round(coalesce(mu, 0), 6) AS mu, round(coalesce(sigma, 1), 6) AS sigma FROM (SELECT unnest(range(10)) AS k) LEFT JOIN (SELECT cls, avg(ret_fwd) AS mu, stddev_samp(ret_fwd) AS sigma FROM cl GROUP BY 1 HAVING count(*) > 5) ON cls = k",
    ("mret",),
)
def class_statistics(spark, sf):
    return rounded(labels.class_statistics(labels.return_class(_features(spark, sf))), "cls", mu="mu", sigma="sigma")


_PROB = "pr AS (SELECT t, asset, c AS cls, exp(-abs(c - size + 1) * 0.5) AS e FROM ft CROSS JOIN (SELECT unnest(range(10)) AS c)), pb AS (SELECT t, asset, cls, e / sum(e) OVER (PARTITION BY t, asset) AS p FROM pr)"


def _probabilities(spark, sf):
    """Made-up class probabilities around the size decile."""
    f = _features(spark, sf).select("t", "asset", "size", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("cls"))
    f = f.withColumn("e", F.exp(-F.abs(F.col("cls") - F.col("size") + 1) * 0.5))
    return f.withColumn("p", F.col("e") / F.sum("e").over(W.partitionBy("t", "asset"))).select("t", "asset", "cls", "p")


@query(
    "class_scores",
    f"""WITH {_FEAT}, {_CLS}, {_PROB}, st AS (SELECT cls, avg(ret_fwd) AS mu, stddev_samp(ret_fwd) AS sg FROM cl GROUP BY 1), s AS (SELECT t, asset, sum(p * (10 - least(pb.cls, 9 - pb.cls)) / 2.0 * CASE WHEN pb.cls < 5 THEN -1 ELSE 1 END) AS dpr, sum(p * mu) AS ret, sum(p * (sg * sg + mu * mu)) AS m2 FROM pb JOIN st USING (cls) GROUP BY 1, 2)
    SELECT t, asset, round(dpr, 6) AS dpr, round(ret, 6) AS ret, round(ret / sqrt(greatest(m2 - ret * ret, 1e-12)), 6) AS srp FROM s""",
    ("mret",),
)
def class_scores(spark, sf):
    stats = labels.class_statistics(labels.return_class(_features(spark, sf)))
    return rounded(labels.scores(_probabilities(spark, sf), stats), "t", "asset", dpr="dpr", ret="ret", srp="srp")


@query(
    "bimodality",
    f"""WITH {_FEAT}, {_CLS}, c AS (SELECT t, count(*) FILTER (size = 10 AND cls = 9) tp, count(*) FILTER (size = 10 AND cls = 0) fp, count(*) FILTER (size <> 10 AND cls = 0) tn, count(*) FILTER (size <> 10 AND cls = 9) fn FROM cl GROUP BY t)
    SELECT t, round(-(CASE WHEN tp + fp > 0 THEN (tp - fp) / (tp + fp)::DOUBLE ELSE 0 END + CASE WHEN tn + fn > 0 THEN (tn - fn) / (tn + fn)::DOUBLE ELSE 0 END) / 2, 6) + 0.0 AS bm FROM c""",
    ("mret",),
)
def bimodality(spark, sf):
    rows = labels.return_class(_features(spark, sf)).select("t", F.col("cls").alias("true_cls"), (F.col("size") - 1).alias("pred_cls"))
    return unsigned_zeros(rounded(labels.bimodality(rows), "t", bm="bm"), "bm")


@query(
    "extreme_portfolio",
    f"""WITH {_FEAT}, kk AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY z12 DESC, asset) AS hi, row_number() OVER (PARTITION BY t ORDER BY z12, asset) AS lo, greatest(ceil(count(*) OVER (PARTITION BY t) * 0.1), 1) AS k FROM ft)
    SELECT t, round(avg(ret_fwd) FILTER (hi <= k) - avg(ret_fwd) FILTER (lo <= k), 6) AS ls FROM kk GROUP BY t""",
    ("mret",),
)
def extreme_portfolio(spark, sf):
    return rounded(labels.extreme_portfolio(_features(spark, sf), "z12"), "t", ls="ls")


# --- five strategies by class, year by year --------------------------------------------------------

_YEARS = """lab AS (SELECT *, t_idx // 12 AS year FROM cl), yc AS (SELECT year, cls, count(*) AS n, sum(ret_fwd) AS s, sum(ret_fwd * ret_fwd) AS q FROM lab GROUP BY 1, 2),
    yk AS (SELECT year, k::INT AS cls FROM (SELECT DISTINCT year FROM lab), (SELECT unnest(range(10)) AS k)), ys AS (SELECT k.year, k.cls, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM yk k LEFT JOIN yc ON yc.cls = k.cls AND yc.year BETWEEN k.year - 3 AND k.year - 1 GROUP BY 1, 2),
    st AS (SELECT year, cls, CASE WHEN n >= 6 THEN s / n ELSE 0 END AS mu, CASE WHEN n >= 6 THEN sqrt(greatest((q - s * s / n) / (n - 1), 0)) ELSE 1 END AS sigma FROM ys)"""


def _labelled(spark, sf):
    return labels.return_class(_features(spark, sf)).withColumn("year", F.floor(F.col("t_idx") / 12).cast("int"))


@query("yearly_class_statistics", f"WITH {_FEAT}, {_CLS}, {_YEARS} SELECT year, cls, round(mu, 6) AS mu, round(sigma, 6) AS sigma FROM st", ("mret",))
def yearly_class_statistics(spark, sf):
    """Returns by class over the three years before each year."""
    return rounded(labels.yearly_class_statistics(_labelled(spark, sf), 3), "year", "cls", mu="mu", sigma="sigma")


@query(
    "class_strategies",
    f"""WITH {_FEAT}, {_CLS}, {_YEARS}, bk AS (SELECT year, size, cls FROM yk, (SELECT DISTINCT size FROM lab)), bn AS (SELECT b.year, b.size, b.cls, count(l.asset) + 1 AS n FROM bk b LEFT JOIN lab l ON l.size = b.size AND l.cls = b.cls AND l.year < b.year GROUP BY 1, 2, 3),
    pb AS (SELECT *, n / sum(n) OVER (PARTITION BY year, size) AS p FROM bn), ap AS (SELECT l.year, t, asset, ret_fwd, z12, pb.cls, p FROM lab l JOIN pb ON pb.year = l.year AND pb.size = l.size WHERE l.year >= 3),
    sc AS (SELECT t, asset, any_value(ret_fwd) AS ret_fwd, any_value(z12) AS momentum, arg_max(ap.cls, (p, -ap.cls))::DOUBLE AS class, sum(p * (10 - least(ap.cls, 9 - ap.cls)) / 2.0 * CASE WHEN ap.cls < 5 THEN -1 ELSE 1 END) AS dpr, sum(p * mu) AS ret, sum(p * mu) / sqrt(greatest(sum(p * (sigma * sigma + mu * mu)) - sum(p * mu) * sum(p * mu), 1e-12)) AS srp FROM ap JOIN st USING (year, cls) GROUP BY 1, 2),
    lg AS (SELECT t, asset, ret_fwd, k.strategy, round(CASE k.strategy WHEN 'momentum' THEN momentum WHEN 'class' THEN class WHEN 'dpr' THEN dpr WHEN 'ret' THEN ret ELSE srp END, 10) AS score FROM sc, (VALUES ('momentum'), ('class'), ('dpr'), ('ret'), ('srp')) k(strategy)),
    kk AS (SELECT *, row_number() OVER (PARTITION BY t, strategy ORDER BY score DESC, asset) AS hi, row_number() OVER (PARTITION BY t, strategy ORDER BY score, asset) AS lo, greatest(ceil(count(*) OVER (PARTITION BY t, strategy) * 0.1), 1) AS k FROM lg)
    SELECT t, strategy, round(avg(ret_fwd) FILTER (hi <= k) - avg(ret_fwd) FILTER (lo <= k), 6) AS ls FROM kk GROUP BY 1, 2""",
    ("mret",),
)
def class_strategies(spark, sf):
    """Momentum, the likeliest class, and three scores of the classes' probabilities, from what came of each size
    decile in the years before: the tenth at either end, month by month."""
    rows = stored(_labelled(spark, sf).select("year", "t", "asset", "size", "cls", "ret_fwd", "z12"))
    traded = rows.where("year >= 3")
    p = traded.drop("cls").join(labels.past_frequencies(rows, "size"), ["year", "size"]).select("year", "t", "asset", "cls", "p")
    made = labels.strategy_scores(traded, p, labels.yearly_class_statistics(rows, 3), "z12")
    return rounded(labels.extreme_portfolio(made, "score", keys=("t", "strategy")), "t", "strategy", ls="ls")


# --- all graphs of a grid ------------------------------------------------------------------------

_ALPHA_GRID, _BETA_GRID = [0.0, 0.05, 0.1, 0.2, 0.3, 0.4], [0.0, 0.1, 0.3, 1.0, 3.0, 10.0]
_OSC = "WITH RECURSIVE pa AS (SELECT asset, t_idx, r, sum(coalesce(r, 0)) OVER (PARTITION BY asset ORDER BY t_idx) AS price FROM mret), en AS (SELECT asset, t_idx, {first} FROM pa WHERE t_idx = 0 UNION ALL SELECT pa.asset, pa.t_idx, {next} FROM en JOIN pa ON pa.asset = en.asset AND pa.t_idx = en.t_idx + 1)".format(
    first=", ".join(f"price AS {p}{k}" for k in (1, 2, 3) for p in "fs"), next=", ".join(f"(1 - {a}) * en.{p}{k} + {a} * pa.price" for k in (1, 2, 3) for p, a in (("f", 0.5**k), ("s", 0.5**k / 4)))
)
_GRID_SCORES = """ws AS (SELECT win, asset, t_idx, r AS x, lag(r, 1) OVER w AS p1, lag(r, 2) OVER w AS p2, lag(r, 3) OVER w AS p3 FROM mret, (VALUES (18), (24)) g(win) WHERE t_idx < 36 AND t_idx >= 36 - win WINDOW w AS (PARTITION BY win, asset ORDER BY t_idx)),
    pr AS (SELECT a.win, a.asset AS i, b.asset AS j, a.x, b.p1, b.p2, b.p3 FROM ws a JOIN ws b ON a.win = b.win AND a.t_idx = b.t_idx AND a.asset <> b.asset WHERE a.x IS NOT NULL),
    cc AS (SELECT win, i, j, corr(x, p1) AS c FROM pr GROUP BY 1, 2, 3 HAVING count(p1) >= 3 UNION ALL SELECT win, i, j, corr(x, p2) FROM pr GROUP BY 1, 2, 3 HAVING count(p2) >= 3 UNION ALL SELECT win, i, j, corr(x, p3) FROM pr GROUP BY 1, 2, 3 HAVING count(p3) >= 3),
    o AS (SELECT win, i, j, max(abs(c)) AS s FROM cc WHERE NOT isnan(c) GROUP BY 1, 2, 3), sv AS (SELECT a.win, a.i, a.j, greatest(a.s - b.s, 0) AS v FROM o a JOIN o b ON a.win = b.win AND a.i = b.j AND a.j = b.i)"""


@query(
    "graph_grid",
    f"""{_OSC}, {_GRID_SCORES}, mm AS (SELECT x.win, x.i, x.j, (x.v + y.v) / 2 AS m FROM sv x JOIN sv y ON x.win = y.win AND x.i = y.j AND x.j = y.i), nd AS (SELECT DISTINCT i FROM o),
    ab AS (SELECT a, b FROM (SELECT unnest({_ALPHA_GRID}) AS a), (SELECT unnest({_BETA_GRID}) AS b)),
    wt AS (SELECT a, b, i, j, sum(greatest(m - a / 2, 0)) / 2 / (1 + b) AS w FROM mm, ab GROUP BY 1, 2, 3, 4), dg AS (SELECT a, b, i, 1 + sum(w) AS d FROM wt GROUP BY 1, 2, 3),
    al AS (SELECT a, b, i, j, w FROM wt UNION ALL SELECT a, b, i, i, 1.0 FROM nd, ab), nm AS (SELECT l.a, l.b, l.i, l.j, w / sqrt(p.d * q.d) AS w FROM al l JOIN dg p ON p.a = l.a AND p.b = l.b AND p.i = l.i JOIN dg q ON q.a = l.a AND q.b = l.b AND q.i = l.j),
    v0 AS (SELECT pa.asset, pa.t_idx, CASE WHEN pa.t_idx >= 7 THEN f1 - s1 END AS o1, CASE WHEN pa.t_idx >= 15 THEN f2 - s2 END AS o2, CASE WHEN pa.t_idx >= 31 THEN f3 - s3 END AS o3, CASE WHEN count(r) OVER f >= 6 THEN stddev_samp(r) OVER f END AS sd, r FROM pa JOIN en USING (asset, t_idx) WINDOW f AS (PARTITION BY asset ORDER BY pa.t_idx ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
    vl AS (SELECT *, lead(r, 2) OVER (PARTITION BY asset ORDER BY t_idx) AS r2, lead(true, 2) OVER (PARTITION BY asset ORDER BY t_idx) AS there FROM v0 WHERE t_idx >= 36 AND t_idx < 72),
    ne AS (SELECT a, b, t_idx, i, sum(w * o1) AS x1, sum(w * o2) AS x2, sum(w * o3) AS x3 FROM nm JOIN vl ON vl.asset = nm.j GROUP BY 1, 2, 3, 4),
    pn AS (SELECT a, b, ne.t_idx, sum(({" + ".join(f"x{k} * exp(-(x{k} * x{k}) / 4) / 0.89" for k in (1, 2, 3))}) / 3 * 0.1 / (sd * sqrt(12) + 1e-10) / (SELECT count(*) FROM nd) * r2) AS p FROM ne JOIN vl ON vl.asset = ne.i AND vl.t_idx = ne.t_idx WHERE there GROUP BY 1, 2, 3),
    sh AS (SELECT a AS alpha, b AS beta, count(p) AS n, avg(p) / (stddev_samp(p) + 1e-12) * sqrt(12) AS sharpe FROM pn GROUP BY 1, 2)
    SELECT alpha::DOUBLE AS alpha, beta::DOUBLE AS beta, n, round(sharpe, 6) AS sharpe, row_number() OVER (ORDER BY round(sharpe, 8) DESC, alpha, beta) = 1 AS best FROM sh""",
    ("mret",),
)
def graph_grid(spark, sf):
    """36 graphs of lead-lag scores at the end of three years, by the Sharpe ratio of the three after them."""
    m = stored(panels.monthly_returns(spark, sf).select("t_idx", "asset", "r"))
    wins = m.where("t_idx < 36").withColumn("win", F.explode(F.array(F.lit(18), F.lit(24)))).where(F.col("t_idx") >= 36 - F.col("win"))
    found = stored(leadlag.lag_scores(leadlag.lagged_correlations(wins.select("win", "t_idx", "asset", F.col("r").alias("v")), 3)))
    osc = trend.oscillators(m.withColumn("x", S.cumulative(F.coalesce("r", F.lit(0.0)))), (1, 2, 3)).withColumn("sd", S.rolling(F.stddev_samp, "r", 12, 6))
    rows = osc.where("t_idx >= 36 and t_idx < 72").select("t_idx", "asset", "osc_1", "osc_2", "osc_3", "sd", "r")
    return graphgrid.search(found, rows, _ALPHA_GRID, _BETA_GRID, ["osc_1", "osc_2", "osc_3"], periods=12).select("alpha", "beta", "n", r6("sharpe", "sharpe"), "best")
