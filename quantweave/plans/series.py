"""Queries of series operators: returns, fills, frames, ranks, folds."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quantweave.functions import series as S
from quantweave.operators import recursive as R
from quantweave.sources import files, panels

from .registry import query

_W = "WINDOW w AS (PARTITION BY asset ORDER BY t_idx)"


def r6(c, name=None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


def unsigned_zeros(df, *names):
    """-0.0 becomes 0.0."""
    return df.withColumns({c: F.col(c) + F.lit(0.0) for c in names})


def rounded(df, *keep, **cols):
    """Keys as they are; other columns to six decimals."""
    return df.select(*keep, *(r6(v, k) for k, v in cols.items()))


@query("weekly_panel", "SELECT t, asset, round(price, 6) AS price, round(flow, 6) AS flow, round(r, 6) AS r, round(q, 6) AS q FROM ret", ("ret",))
def weekly_panel(spark, sf):
    return rounded(panels.weekly_returns(spark, sf), "t", "asset", price="price", flow="flow", r="r", q="q")


@query("monthly_simple_returns", "SELECT t, asset, round(r, 6) AS r FROM mret WHERE r IS NOT NULL", ("mret",))
def monthly_simple_returns(spark, sf):
    return rounded(panels.monthly_returns(spark, sf).where("r is not null"), "t", "asset", r="r")


@query(
    "fill_limited",
    f"""SELECT t, asset, round(coalesce(price, lag(price) OVER w, lag(price, 2) OVER w), 6) AS filled FROM weekly {_W}""",
    ("weekly",),
)
def fill_limited(spark, sf):
    return rounded(files.clean_prices(panels.weekly(spark, sf), forward=2), "t", "asset", filled="price")


@query(
    "fill_both_ways",
    """WITH f AS (SELECT *, last_value(price IGNORE NULLS) OVER (PARTITION BY asset ORDER BY t_idx ROWS UNBOUNDED PRECEDING) AS p FROM weekly)
    SELECT t, asset, round(coalesce(p, first_value(p IGNORE NULLS) OVER (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS filled FROM f""",
    ("weekly",),
)
def fill_both_ways(spark, sf):
    return rounded(files.clean_prices(panels.weekly(spark, sf), back=True), "t", "asset", filled="price")


@query(
    "coverage_filter",
    """WITH keep AS (SELECT asset FROM monthly GROUP BY asset HAVING count(price) >= 0.98 * (SELECT count(*) FROM mcal)),
    full_t AS (SELECT t FROM monthly GROUP BY t HAVING count(price) = (SELECT count(DISTINCT asset) FROM monthly))
    SELECT m.t, m.asset, round(price, 6) AS price FROM monthly m WHERE asset IN (SELECT asset FROM keep) AND t IN (SELECT t FROM full_t)""",
    ("monthly",),
)
def coverage_filter(spark, sf):
    """Assets with enough values, and periods without a gap."""
    m = panels.monthly(spark, sf)
    keep = m.groupBy("asset").agg(F.count("price").alias("n"), F.count("*").alias("all")).where("n >= 0.98 * all")
    whole = m.groupBy("t").agg(F.count("price").alias("n"), F.count("*").alias("all")).where("n = all")
    return rounded(m.join(keep, "asset", "left_semi").join(whole, "t", "left_semi"), "t", "asset", price="price")


@query(
    "rolling_moments",
    f"""SELECT t, asset, CASE WHEN count(r) OVER f = 12 THEN round(sum(r) OVER f, 6) END AS sum12, CASE WHEN count(r) OVER f >= 6 THEN round(avg(r) OVER f, 6) END AS mean12,
    CASE WHEN count(r) OVER f >= 6 THEN round(stddev_samp(r) OVER f, 6) END AS std12,
    CASE WHEN count(r) OVER f = 12 THEN round((r - avg(r) OVER f) / nullif(stddev_samp(r) OVER f, 0), 6) END AS z12
    FROM ret WINDOW f AS (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
    ("ret",),
)
def rolling_moments(spark, sf):
    df = panels.weekly_returns(spark, sf)
    mean, std = S.rolling(F.avg, "r", 12), S.rolling(F.stddev_samp, "r", 12)
    return rounded(df, "t", "asset", sum12=S.rolling(F.sum, "r", 12), mean12=S.rolling(F.avg, "r", 12, 6), std12=S.rolling(F.stddev_samp, "r", 12, 6), z12=F.try_divide(F.col("r") - mean, std))


@query(
    "cross_section_rank",
    """WITH k AS (SELECT t, asset, r, rank() OVER (PARTITION BY t ORDER BY r) + (count(*) OVER (PARTITION BY t, r) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY t) AS n FROM mret WHERE r IS NOT NULL)
    SELECT t, asset, rk::DOUBLE AS avg_rank, least(greatest(ceil(10 * rk / n), 1), 10)::INT AS decile FROM k""",
    ("mret",),
)
def cross_section_rank(spark, sf):
    df = panels.monthly_returns(spark, sf).where("r is not null")
    rank = S.average_rank("r", "t")
    df = df.withColumn("rk", rank).withColumn("n", F.count("*").over(W.partitionBy("t")))
    return df.select("t", "asset", F.col("rk").cast("double").alias("avg_rank"), F.least(F.greatest(F.ceil(10 * F.col("rk") / F.col("n")), F.lit(1)), F.lit(10)).cast("int").alias("decile"))


@query(
    "quantile_buckets",
    """WITH e AS (SELECT t, quantile_cont(vol, 0.0) e0, quantile_cont(vol, 1/3.0) e1, quantile_cont(vol, 2/3.0) e2, quantile_cont(vol, 1.0) e3 FROM weekly WHERE vol IS NOT NULL GROUP BY t)
    SELECT t, asset, greatest(len(list_filter(list_distinct([e0, e1, e2, e3]), lambda x: x < vol)) - 1, 0)::INT AS bucket FROM weekly JOIN e USING (t) WHERE vol IS NOT NULL""",
    ("weekly",),
)
def quantile_buckets(spark, sf):
    df = panels.weekly(spark, sf).where("vol is not null")
    return df.select("t", "asset", S.quantile_bucket("vol", 3, "t").cast("int").alias("bucket"))


@query(
    "month_winsorise",
    """WITH q AS (SELECT t, quantile_cont(greatest(least(r, 3), -0.95), 0.01) lo, quantile_cont(greatest(least(r, 3), -0.95), 0.99) hi FROM mret WHERE r IS NOT NULL GROUP BY t)
    SELECT t, asset, round(least(greatest(greatest(least(r, 3), -0.95), lo), hi), 6) AS r FROM mret JOIN q USING (t) WHERE r IS NOT NULL""",
    ("mret",),
)
def month_winsorise(spark, sf):
    df = panels.monthly_returns(spark, sf).where("r is not null").withColumn("r", S.clip("r", -0.95, 3.0))
    edge = F.percentile("r", F.array(F.lit(0.01), F.lit(0.99))).over(W.partitionBy("t"))
    return rounded(df.withColumn("e", edge), "t", "asset", r=S.clip("r", F.col("e")[0], F.col("e")[1]))


@query(
    "ewma_fold",
    """WITH RECURSIVE x AS (SELECT asset, t, price, row_number() OVER (PARTITION BY asset ORDER BY t_idx) AS k FROM monthly WHERE price IS NOT NULL),
    e AS (SELECT asset, t, k, price AS y FROM x WHERE k = 1 UNION ALL SELECT x.asset, x.t, x.k, (1 - 0.2) * e.y + 0.2 * x.price FROM e JOIN x ON x.asset = e.asset AND x.k = e.k + 1)
    SELECT t, asset, round(y, 6) AS ewma FROM e""",
    ("monthly",),
)
def ewma_fold(spark, sf):
    return rounded(R.with_ewma(panels.monthly(spark, sf).where("price is not null"), "price", "ewma", 0.2), "t", "asset", ewma="ewma")


@query(
    "ew_std_plain",
    """WITH RECURSIVE x AS (SELECT asset, t, r, row_number() OVER (PARTITION BY asset ORDER BY t_idx) AS k FROM mret WHERE r IS NOT NULL),
    e AS (SELECT asset, t, k, r AS m, 0.0::DOUBLE AS c, 1.0::DOUBLE AS s2 FROM x WHERE k = 1 UNION ALL
      SELECT x.asset, x.t, x.k, 0.9 * e.m + 0.1 * x.r, 0.9 * (e.c + (e.m - (0.9 * e.m + 0.1 * x.r)) ** 2) + 0.1 * (x.r - (0.9 * e.m + 0.1 * x.r)) ** 2, e.s2 * 0.81 + 0.01
      FROM e JOIN x ON x.asset = e.asset AND x.k = e.k + 1)
    SELECT t, asset, round(sqrt(c / (1 - s2)), 6) AS ew_std FROM e WHERE k >= 6""",
    ("mret",),
)
def ew_std_plain(spark, sf):
    df = R.with_ew_moments(panels.monthly_returns(spark, sf).where("r is not null"), "r", "m", "s", 0.1, False, 6)
    return rounded(df.where("s is not null"), "t", "asset", ew_std="s")


@query(
    "ew_std_adjusted",
    """WITH x AS (SELECT asset, t, r, row_number() OVER (PARTITION BY asset ORDER BY t_idx) AS k FROM mret WHERE r IS NOT NULL),
    p AS (SELECT a.asset, a.t, a.k, b.r, 0.9 ** (a.k - b.k) AS w FROM x a JOIN x b ON a.asset = b.asset AND b.k <= a.k WHERE a.k >= 6),
    m AS (SELECT asset, t, sum(w * r) / sum(w) AS mu FROM p GROUP BY 1, 2)
    SELECT t, asset, round(sqrt(sum(w * (r - mu) ** 2) / sum(w) * sum(w) ** 2 / (sum(w) ** 2 - sum(w * w))), 6) AS ew_std FROM p JOIN m USING (asset, t) GROUP BY 1, 2""",
    ("mret",),
)
def ew_std_adjusted(spark, sf):
    df = R.with_ew_moments(panels.monthly_returns(spark, sf).where("r is not null"), "r", "m", "s", 0.1, True, 6)
    return rounded(df.where("s is not null"), "t", "asset", ew_std="s")


@query(
    "ew_winsorise",
    """WITH x AS (SELECT asset, t, r, row_number() OVER (PARTITION BY asset ORDER BY t_idx) AS k FROM mret WHERE r IS NOT NULL),
    p AS (SELECT a.asset, a.t, a.k, a.r AS r0, b.r, exp(-ln(2.0) / 12 * (a.k - b.k)) AS w FROM x a JOIN x b ON a.asset = b.asset AND b.k <= a.k WHERE a.k >= 6),
    m AS (SELECT asset, t, sum(w * r) / sum(w) AS mu FROM p GROUP BY 1, 2),
    s AS (SELECT asset, t, any_value(r0) AS r, any_value(mu) AS mu, sqrt(sum(w * (p.r - mu) ** 2) / sum(w) * sum(w) ** 2 / (sum(w) ** 2 - sum(w * w))) AS sd FROM p JOIN m USING (asset, t) GROUP BY 1, 2)
    SELECT t, asset, round(least(greatest(r, mu - 1.5 * sd), mu + 1.5 * sd), 6) AS r FROM s""",
    ("mret",),
)
def ew_winsorise(spark, sf):
    import math

    df = R.with_ew_moments(panels.monthly_returns(spark, sf).where("r is not null"), "r", "m", "s", 1 - math.exp(-math.log(2) / 12), True, 6)
    return rounded(df.where("s is not null"), "t", "asset", r=S.clip("r", F.col("m") - 1.5 * F.col("s"), F.col("m") + 1.5 * F.col("s")))


_Z = "CASE WHEN count(r) OVER f = 12 THEN (r - avg(r) OVER f) / nullif(stddev_samp(r) OVER f, 0) END"
_F = "WINDOW f AS (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"


def _z(spark, sf):
    df = panels.weekly_returns(spark, sf)
    return df.withColumn("z", F.try_divide(F.col("r") - S.rolling(F.avg, "r", 12), S.rolling(F.stddev_samp, "r", 12)))


@query(
    "threshold_states",
    f"""WITH RECURSIVE z AS (SELECT asset, t, t_idx, {_Z} AS z FROM ret {_F}),
    s AS (SELECT asset, t, t_idx, CASE WHEN z > 1 THEN -1 WHEN z < -1 THEN 1 ELSE 0 END AS st, z IS NULL AS gap FROM z WHERE t_idx = 0 UNION ALL
      SELECT z.asset, z.t, z.t_idx, CASE WHEN z.z IS NULL THEN s.st WHEN s.st = 0 THEN CASE WHEN z.z > 1 THEN -1 WHEN z.z < -1 THEN 1 ELSE 0 END
        WHEN s.st = 1 AND z.z > -0.25 THEN 0 WHEN s.st = -1 AND z.z < 0.25 THEN 0 ELSE s.st END, z.z IS NULL FROM s JOIN z ON z.asset = s.asset AND z.t_idx = s.t_idx + 1)
    SELECT t, asset, CASE WHEN gap THEN 0 ELSE st END::BIGINT AS position FROM s""",
    ("ret",),
)
def threshold_states(spark, sf):
    return R.with_state(_z(spark, sf).select("t", "t_idx", "asset", "z"), "z", "position", 1.0, 0.25).select("t", "asset", "position")


@query(
    "hysteresis_band",
    f"""WITH z AS (SELECT asset, t, t_idx, {_Z} AS z FROM ret {_F}), e AS (SELECT *, CASE WHEN z >= 1 THEN 1 WHEN z <= -1 THEN -1 WHEN abs(z) < 0.25 THEN 0 END AS ev FROM z)
    SELECT t, asset, CASE WHEN z IS NULL THEN 0 ELSE coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY asset ORDER BY t_idx ROWS UNBOUNDED PRECEDING), 0) END::INT AS position FROM e""",
    ("ret",),
)
def hysteresis_band(spark, sf):
    return _z(spark, sf).select("t", "asset", S.hysteresis("z", 1.0, 0.25).cast("int").alias("position"))


@query(
    "minimum_hold",
    """WITH RECURSIVE x AS (SELECT asset, t, t_idx, coalesce(sign(r), 0) AS v FROM mret),
    s AS (SELECT asset, t, t_idx, v AS pos, CASE WHEN v <> 0 THEN 1 ELSE 4 END AS age FROM x WHERE t_idx = 0 UNION ALL
      SELECT x.asset, x.t, x.t_idx, CASE WHEN x.v <> s.pos AND s.age >= 3 THEN x.v ELSE s.pos END, CASE WHEN x.v <> s.pos AND s.age >= 3 THEN 1 ELSE s.age + 1 END FROM s JOIN x ON x.asset = s.asset AND x.t_idx = s.t_idx + 1)
    SELECT t, asset, pos::DOUBLE AS position FROM s""",
    ("mret",),
)
def minimum_hold(spark, sf):
    df = panels.monthly_returns(spark, sf).withColumn("v", F.coalesce(F.signum("r"), F.lit(0.0)))
    return R.with_hold(df.select("t", "t_idx", "asset", "v"), "v", "position", 3).select("t", "asset", "position")


@query(
    "garch_variance",
    """WITH RECURSIVE x AS (SELECT asset, t, t_idx, coalesce(r, 0) AS r FROM mret),
    h0 AS (SELECT asset, CASE WHEN (SELECT count(*) FROM mcal) > 21 THEN var_pop(r) FILTER (t_idx < 21) ELSE 1e-4 END AS h FROM x GROUP BY asset),
    g AS (SELECT x.asset, x.t, x.t_idx, x.r, h0.h FROM x JOIN h0 USING (asset) WHERE t_idx = 0 UNION ALL
      SELECT x.asset, x.t, x.t_idx, x.r, 0.00001 + 0.08 * g.r ** 2 + 0.9 * g.h FROM g JOIN x ON x.asset = g.asset AND x.t_idx = g.t_idx + 1)
    SELECT t, asset, round(h, 8) AS h FROM g""",
    ("mret",),
)
def garch_variance(spark, sf):
    df = R.with_garch(panels.monthly_returns(spark, sf).select("t", "t_idx", "asset", "r"), "r", "h", 1e-5, 0.08, 0.9)
    return df.select("t", "asset", F.round("h", 8).alias("h"))


@query(
    "realised_variance",
    """SELECT t, asset, round(coalesce(CASE WHEN count(r) OVER f >= 5 THEN avg(r * r) OVER f END, avg(r * r) OVER (PARTITION BY asset)), 8) AS rv
    FROM ret WINDOW f AS (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""",
    ("ret",),
)
def realised_variance(spark, sf):
    square = F.col("r") * F.col("r")
    rv = F.coalesce(S.rolling(F.avg, square, 21, 5), F.avg(square).over(W.partitionBy("asset")))
    return panels.weekly_returns(spark, sf).select("t", "asset", F.round(rv, 8).alias("rv"))


@query(
    "execution_lag",
    """WITH x AS (SELECT asset, t, t_idx, r, sign(lag(q, 2) OVER w) AS ex FROM ret WINDOW w AS (PARTITION BY asset ORDER BY t_idx)),
    v AS (SELECT *, coalesce(lag(ex) OVER (PARTITION BY asset ORDER BY t_idx), 0) AS prev FROM x WHERE ex IS NOT NULL AND r IS NOT NULL)
    SELECT t, asset, ex::DOUBLE AS executed, round(ex * r - 0.0003 * abs(ex - prev), 6) AS pnl FROM v""",
    ("ret",),
)
def execution_lag(spark, sf):
    """Positions trade two periods late, at a cost; periods without both values do not count."""
    df = panels.weekly_returns(spark, sf).withColumn("ex", F.signum(F.lag("q", 2).over(S.by())))
    df = df.where("ex is not null and r is not null").withColumn("prev", F.coalesce(F.lag("ex").over(S.by()), F.lit(0.0)))
    return df.select("t", "asset", F.col("ex").alias("executed"), r6(F.col("ex") * F.col("r") - 0.0003 * F.abs(F.col("ex") - F.col("prev")), "pnl"))


@query(
    "longest_below_peak",
    f"""WITH c AS (SELECT asset, t_idx, sum(coalesce(r, 0)) OVER (PARTITION BY asset ORDER BY t_idx) AS eq FROM ret),
    d AS (SELECT *, eq < max(eq) OVER (PARTITION BY asset ORDER BY t_idx) AS under FROM c),
    i AS (SELECT *, sum(CASE WHEN under THEN 0 ELSE 1 END) OVER (PARTITION BY asset ORDER BY t_idx) AS island FROM d),
    n AS (SELECT asset, island, count(*) FILTER (under) AS n FROM i GROUP BY 1, 2) SELECT asset, max(n) AS longest FROM n GROUP BY 1""",
    ("ret",),
)
def longest_below_peak(spark, sf):
    df = panels.weekly_returns(spark, sf).withColumn("eq", S.cumulative(F.coalesce("r", F.lit(0.0))))
    df = df.withColumn("under", F.col("eq") < F.max("eq").over(S.by().rowsBetween(W.unboundedPreceding, 0)))
    df = df.withColumn("island", S.cumulative((~F.col("under")).cast("int")))
    return df.groupBy("asset", "island").agg(F.count_if("under").alias("n")).groupBy("asset").agg(F.max("n").alias("longest"))


@query(
    "top_bottom_assets",
    """WITH k AS (SELECT t, asset, cap, row_number() OVER (PARTITION BY t ORDER BY cap DESC, asset) AS hi, row_number() OVER (PARTITION BY t ORDER BY cap, asset DESC) AS lo, count(*) OVER (PARTITION BY t) AS n FROM weekly WHERE cap IS NOT NULL)
    SELECT t, asset, CASE WHEN hi <= greatest(floor(n * 0.2), 1) THEN 'leader' ELSE 'follower' END AS side FROM k WHERE hi <= greatest(floor(n * 0.2), 1) OR lo <= greatest(floor(n * 0.2), 1)""",
    ("weekly",),
)
def top_bottom_assets(spark, sf):
    df = panels.weekly(spark, sf).where("cap is not null")
    at = W.partitionBy("t")
    df = df.withColumns({"hi": F.row_number().over(at.orderBy(F.desc("cap"), "asset")), "lo": F.row_number().over(at.orderBy("cap", F.desc("asset"))), "k": F.greatest(F.floor(F.count("*").over(at) * 0.2), F.lit(1))})
    return df.where("hi <= k or lo <= k").select("t", "asset", F.when(F.col("hi") <= F.col("k"), "leader").otherwise("follower").alias("side"))


@query(
    "spearman_ic",
    """WITH x AS (SELECT t, asset, q, lead(r) OVER (PARTITION BY asset ORDER BY t_idx) AS f FROM ret), y AS (SELECT * FROM x WHERE q IS NOT NULL AND f IS NOT NULL),
    k AS (SELECT asset, rank() OVER (PARTITION BY asset ORDER BY q) + (count(*) OVER (PARTITION BY asset, q) - 1) / 2.0 AS a, rank() OVER (PARTITION BY asset ORDER BY f) + (count(*) OVER (PARTITION BY asset, f) - 1) / 2.0 AS b FROM y)
    SELECT asset, count(*) AS n, round(corr(a, b), 6) AS ic FROM k GROUP BY asset HAVING count(*) >= 30""",
    ("ret",),
)
def spearman_ic(spark, sf):
    df = panels.weekly_returns(spark, sf).withColumn("f", F.lead("r").over(S.by())).where("q is not null and f is not null")
    df = df.select("asset", S.average_rank("q", "asset").alias("a"), S.average_rank("f", "asset").alias("b"))
    return df.groupBy("asset").agg(F.count("*").alias("n"), r6(F.corr("a", "b"), "ic")).where("n >= 30")


@query(
    "describe_returns",
    """SELECT asset, count(r) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, round(min(r), 6) AS lowest, round(quantile_cont(r, 0.25), 6) AS q25, round(quantile_cont(r, 0.5), 6) AS q50,
    round(quantile_cont(r, 0.75), 6) AS q75, round(max(r), 6) AS highest FROM ret GROUP BY asset""",
    ("ret",),
)
def describe_returns(spark, sf):
    q = lambda p: r6(F.percentile("r", p))
    return panels.weekly_returns(spark, sf).groupBy("asset").agg(
        F.count("r").alias("n"), r6(F.avg("r"), "mean"), r6(F.stddev_samp("r"), "std"), r6(F.min("r"), "lowest"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), r6(F.max("r"), "highest")
    )


@query(
    "skew_by_horizon",
    """WITH h AS (SELECT unnest([1, 5, 10, 21, 42, 63]) AS h), s AS (SELECT asset, h, floor(t_idx / h) AS g, sum(coalesce(r, 0)) AS x, count(*) AS n FROM ret CROSS JOIN h GROUP BY 1, 2, 3), f AS (SELECT * FROM s WHERE n = h),
    m AS (SELECT asset, h, avg(x) AS mu, count(*) AS k FROM f GROUP BY 1, 2)
    SELECT f.asset, f.h, any_value(k) AS k, round(avg((x - mu) ** 3) / avg((x - mu) ** 2) ** 1.5, 6) AS skew FROM f JOIN m USING (asset, h) GROUP BY 1, 2 HAVING any_value(k) >= 3""",
    ("ret",),
)
def skew_by_horizon(spark, sf):
    from quantweave.operators.performance import skew_by_horizon

    return skew_by_horizon(panels.weekly_returns(spark, sf), (1, 5, 10, 21, 42, 63)).select("asset", "h", "k", r6("skew", "skew"))


@query(
    "dedupe_last",
    """SELECT event_type, user_id, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""",
)
def dedupe_last(spark, sf):
    last = F.row_number().over(W.partitionBy("event_type", "user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return panels.read(spark, sf, "events").withColumn("k", last).where("k = 1").select("event_type", "user_id", "event_id", r6("value", "value"))


@query(
    "wide_to_long_and_back",
    """SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS o, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS p FROM orders GROUP BY 1""",
)
def wide_to_long_and_back(spark, sf):
    return panels.read(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0).select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("mode_smallest", "SELECT event_type, user_id AS mode_user, n FROM (SELECT event_type, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS k FROM events GROUP BY 1, 2) WHERE k = 1")
def mode_smallest(spark, sf):
    n = panels.read(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    k = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("n"), "user_id"))
    return n.withColumn("k", k).where("k = 1").select("event_type", F.col("user_id").alias("mode_user"), "n")
