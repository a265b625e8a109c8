"""Spreads by trading period, all thresholds at once, and hedges on several brands, with SQL."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quantweave.operators import hedges, spreadperiods, statemaps
from quantweave.sources import panels
from quantweave.sources.stored import stored

from .factors import _SPREAD, _spread_panel
from .registry import query
from .series import rounded

_TRAIN, _TEST, _WARM, _WINDOW, _LOOK_BACKS = 104, 52, 60, 26, [13, 26]
_Z_PAIRS = [(e, x) for e in (1.0, 1.5, 2.0, 2.5) for x in (0.0, 0.5, 1.0) if x < e]
_S_PAIRS = [(e, x) for e in (0.75, 1.25, 1.75) for x in (0.25, 0.5, 0.75) if x < e]

_ROWS = f"""{_SPREAD}, last AS (SELECT max(t_idx) AS last FROM cal),
pd AS (SELECT k::INT AS period, {_TRAIN} + {_TEST} * k AS a FROM last, LATERAL (SELECT unnest(range(0, (last - {_TRAIN} + {_WARM}) // {_TEST} + 1)) AS k)),
sw AS (SELECT asset, t_idx, y, x FROM sp WHERE y IS NOT NULL),
fit AS (SELECT period, asset, sum(x * y) / sum(x * x) AS gamma, (count(*) * sum(x * y) - sum(x) * sum(y)) / (count(*) * sum(x * x) - sum(x) * sum(x)) AS slope, sum(x) AS sx, sum(y) AS sy, count(*) AS n
  FROM sw JOIN pd ON t_idx >= a - {_TRAIN} AND t_idx < a GROUP BY 1, 2),
ext AS (SELECT sw.*, period, t_idx >= a AS own, gamma, slope, (sy - slope * sx) / n AS level, row_number() OVER (PARTITION BY asset, period ORDER BY t_idx) AS k,
    CASE WHEN count(*) OVER f = {_WINDOW} THEN sum(x * y) OVER f / sum(x * x) OVER f END AS rolling
  FROM sw JOIN pd ON t_idx >= a - {_WARM} AND t_idx < a + {_TEST} JOIN fit USING (asset, period) WINDOW f AS (PARTITION BY asset, period ORDER BY t_idx ROWS BETWEEN {_WINDOW} PRECEDING AND 1 PRECEDING)),
k0 AS (SELECT *, 2e-4::DOUBLE AS pa, 0.0::DOUBLE AS pb, 2e-4::DOUBLE AS pc, slope AS g0, level AS m0 FROM ext WHERE k = 1),
kal AS (SELECT asset, period, k, pa - (pa * x + pb) ** 2 / sz AS a, pb - (pa * x + pb) * (pb * x + pc) / sz AS b, pc - (pb * x + pc) ** 2 / sz AS c,
    g0 + (pa * x + pb) / sz * (y - x * g0 - m0) AS g, m0 + (pb * x + pc) / sz * (y - x * g0 - m0) AS m
  FROM (SELECT *, pa * x * x + 2 * pb * x + pc + 1e-3 AS sz FROM k0)
  UNION ALL SELECT asset, period, k, pa - (pa * x + pb) ** 2 / sz, pb - (pa * x + pb) * (pb * x + pc) / sz, pc - (pb * x + pc) ** 2 / sz, g0 + (pa * x + pb) / sz * (y - x * g0 - m0), m0 + (pb * x + pc) / sz * (y - x * g0 - m0)
  FROM (SELECT *, pa * x * x + 2 * pb * x + pc + 1e-3 AS sz FROM (SELECT e.asset, e.period, e.k, e.x, e.y, kal.a + 1e-4 AS pa, kal.b AS pb, kal.c + 1e-4 AS pc, kal.g AS g0, kal.m AS m0 FROM kal JOIN ext e ON e.asset = kal.asset AND e.period = kal.period AND e.k = kal.k + 1))),
three AS (SELECT e.asset, e.period, e.t_idx, e.own, u.kind, CASE u.kind WHEN 'constant' THEN y - gamma * x WHEN 'rolling' THEN y - rolling * x ELSE y - x * g - m END AS spread
  FROM ext e JOIN kal USING (asset, period, k) CROSS JOIN (VALUES ('constant'), ('rolling'), ('kalman')) u(kind)),
spr AS (SELECT * FROM three WHERE spread IS NOT NULL)"""


def _spreads(spark, sf):
    return spreadperiods.spreads(_spread_panel(spark, sf), _TRAIN, _TEST, _WARM, _WINDOW)


@query("period_spreads", f"WITH RECURSIVE {_ROWS} SELECT asset, kind, t_idx, period, round(spread, 6) AS spread FROM spr WHERE own", ("ret",))
def period_spreads(spark, sf):
    """Three hedged spreads of each brand, refitted by year; the years' own rows one after another."""
    return rounded(_spreads(spark, sf).where("own"), "asset", "kind", "t_idx", "period", spread="spread")


def _score_sql() -> str:
    out = []
    for n in _LOOK_BACKS:
        z, f = f"(PARTITION BY asset, kind, period ORDER BY t_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)", f"(PARTITION BY asset, kind, period ORDER BY t_idx ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        out.append(f"CASE WHEN count(*) OVER {z} = {n} THEN (spread - avg(spread) OVER {z}) / nullif(stddev_samp(spread) OVER {z}, 0) END AS z_{n}")
        out += [f"count(d * l) OVER {f} AS n_{n}"] + [f"regr_{k}(d, l) OVER {f} AS {k}_{n}" for k in ("slope", "intercept", "sxx", "syy", "sxy")]
    return ", ".join(out)


_OU = "CASE WHEN n_{n} = {n} AND sxx_{n} * {n} >= 1e-10 AND slope_{n} < 0 AND slope_{n} > -2 AND syy_{n} - slope_{n} * sxy_{n} > 0 THEN (spread + intercept_{n} / slope_{n}) / sqrt((syy_{n} - slope_{n} * sxy_{n}) / ({n} - 2) / (-2 * slope_{n})) END AS s_{n}"
_SCORED = f"""{_ROWS}, dl AS (SELECT *, spread - lag(spread) OVER w AS d, lag(spread) OVER w AS l, row_number() OVER w AS k, CASE WHEN own THEN lead(spread) OVER w - spread END AS gain FROM spr WINDOW w AS (PARTITION BY asset, kind, period ORDER BY t_idx)),
mo AS (SELECT *, {_score_sql()} FROM dl), sc AS MATERIALIZED (SELECT *, {", ".join(_OU.format(n=n) for n in _LOOK_BACKS)} FROM mo)"""
_STEP = "CASE WHEN r.v IS NULL THEN st.s WHEN st.s = 0 THEN CASE WHEN r.v > st.e THEN -1 WHEN r.v < -st.e THEN 1 ELSE 0 END WHEN st.s = 1 AND r.v > -st.x THEN 0 WHEN st.s = -1 AND r.v < st.x THEN 0 ELSE st.s END"
_GRID = " UNION ALL ".join(f"SELECT '{k}_{n}' AS score, {e}::DOUBLE AS e, {x}::DOUBLE AS x" for k, pairs in (("z", _Z_PAIRS), ("s", _S_PAIRS)) for n in _LOOK_BACKS for e, x in pairs)
_SWEPT = f"""{_SCORED}, gp AS ({_GRID}), lv AS MATERIALIZED (SELECT asset, kind, period, t_idx, own, gain, k, u.score, CASE u.score {" ".join(f"WHEN '{c}_{n}' THEN {c}_{n}" for c in "zs" for n in _LOOK_BACKS)} END AS v FROM sc CROSS JOIN (VALUES {", ".join(f"('{c}_{n}')" for c in "zs" for n in _LOOK_BACKS)}) u(score)),
st AS (SELECT asset, kind, period, r.score, e, x, k, t_idx, own, gain, r.v IS NULL AS gap, CASE WHEN r.v > e THEN -1 WHEN r.v < -e THEN 1 ELSE 0 END AS s FROM lv r JOIN gp USING (score) WHERE k = 1
  UNION ALL SELECT r.asset, r.kind, r.period, r.score, st.e, st.x, r.k, r.t_idx, r.own, r.gain, r.v IS NULL, {_STEP} FROM st JOIN lv r ON r.asset = st.asset AND r.kind = st.kind AND r.period = st.period AND r.score = st.score AND r.k = st.k + 1),
ps AS (SELECT *, CASE WHEN gap THEN 0 ELSE s END AS pos, coalesce(CASE WHEN gap THEN 0 ELSE s END * gain, 0) AS pnl FROM st WHERE own),
rn AS (SELECT *, sum(pnl) OVER w AS c, CASE WHEN pos <> lag(pos) OVER w THEN 1 ELSE 0 END AS moved FROM ps WINDOW w AS (PARTITION BY asset, kind, score, e, x ORDER BY t_idx ROWS UNBOUNDED PRECEDING)),
dp AS (SELECT *, c - max(c) OVER (PARTITION BY asset, kind, score, e, x ORDER BY t_idx ROWS UNBOUNDED PRECEDING) AS dip FROM rn),
mt AS (SELECT asset, kind, score, e AS enter, x AS leave, count(*) AS n, CASE WHEN var_samp(pnl) > 1e-18 THEN avg(pnl) / stddev_samp(pnl) * sqrt(52) END AS sharpe,
    CASE WHEN var_samp(pnl) > 1e-18 AND exp(min(dip)) - 1 < -1e-6 THEN (exp(sum(pnl) / (count(*) / 52.0)) - 1) / abs(exp(min(dip)) - 1) END AS calmar, avg(CASE WHEN pos <> 0 THEN 1.0 ELSE 0.0 END) AS on_share, sum(moved)::BIGINT AS trades FROM dp GROUP BY 1, 2, 3, 4, 5)"""


@query(
    "threshold_sweep",
    f"""WITH RECURSIVE {_SWEPT}, rk AS (SELECT *, row_number() OVER (PARTITION BY asset, kind ORDER BY round(sharpe, 6) DESC, score, enter, leave) AS rank FROM mt WHERE sharpe IS NOT NULL)
    SELECT asset, kind, rank, score, enter, leave, n, round(sharpe, 6) AS sharpe, round(calmar, 4) AS calmar, round(on_share, 6) AS on_share, trades FROM rk WHERE rank <= 10""",
    ("ret",),
)
def threshold_sweep(spark, sf):
    """The ten best of all scores, look-backs and thresholds for each brand and hedge, over all years."""
    rows = stored(spreadperiods.scored(_spreads(spark, sf), _LOOK_BACKS))
    scores = {f"z_{n}": _Z_PAIRS for n in _LOOK_BACKS} | {f"s_{n}": _S_PAIRS for n in _LOOK_BACKS}
    each = statemaps.metrics(statemaps.sweep(rows, scores, ["asset", "kind"], "period", "own", "gain"), 52).where("sharpe is not null").withColumn("sharpe", F.round("sharpe", 6))
    best = F.row_number().over(W.partitionBy("asset", "kind").orderBy(F.desc("sharpe"), "score", "enter", "leave"))
    return each.withColumn("rank", best).where("rank <= 10").select("asset", "kind", "rank", "score", "enter", "leave", "n", "sharpe", F.round("calmar", 4).alias("calmar"), F.round("on_share", 6).alias("on_share"), "trades")


# --- several brands at once ----------------------------------------------------------------------

_LEGS = ["Brand#11", "Brand#12", "Brand#13"]
_WIDE = """wd AS (SELECT asset, t_idx, ln(price) AS y FROM monthly WHERE price > 0), hg AS (SELECT w.asset, w.t_idx, w.y, a.y AS a, b.y AS b, c.y AS c FROM wd w LEFT JOIN wd a ON a.t_idx = w.t_idx AND a.asset = 'Brand#11' LEFT JOIN wd b ON b.t_idx = w.t_idx AND b.asset = 'Brand#12' LEFT JOIN wd c ON c.t_idx = w.t_idx AND c.asset = 'Brand#13'
  WHERE w.asset NOT IN ('Brand#11', 'Brand#12', 'Brand#13'))"""
_DET = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))"


def _cramer() -> list[str]:
    g = ["aa", "ab", "ac", "ab", "bb", "bc", "ac", "bc", "cc"]
    whole, out = _DET.format(*g), []
    for k in range(3):
        own = list(g)
        for i, r in enumerate(("ya", "yb", "yc")):
            own[3 * i + k] = r
        out.append(f"{_DET.format(*own)} / {whole}")
    return out


_SUMS = {"aa": "a * a", "ab": "a * b", "ac": "a * c", "bb": "b * b", "bc": "b * c", "cc": "c * c", "ya": "a * y", "yb": "b * y", "yc": "c * y"}
_WHOLE = "CASE WHEN a + b + c + y IS NOT NULL THEN {} END"


def _legs(spark, sf):
    """Log prices of the other brands, beside those of the three that hedge them."""
    rows = panels.monthly(spark, sf).where("price > 0").select("asset", "t_idx", F.log("price").alias("y"))
    wide = rows.where(~F.col("asset").isin(_LEGS))
    legs = rows.groupBy("t_idx").agg(*[F.max(F.when(F.col("asset") == b, F.col("y"))).alias(n) for b, n in zip(_LEGS, "abc", strict=True)])
    return wide.join(legs, "t_idx")


@query(
    "rolling_hedge_gammas",
    f"WITH {_WIDE}, sm AS (SELECT asset, t_idx, y, a, b, c, count({_WHOLE.format('1')}) OVER f AS n, {', '.join(f'sum({_WHOLE.format(v)}) OVER f AS {k}' for k, v in _SUMS.items())} FROM hg WINDOW f AS (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING)), gm AS (SELECT *, {', '.join(f'{e} AS g{i}' for i, e in enumerate(_cramer()))} FROM sm WHERE n = 36) SELECT asset, t_idx, round(g0, 4) AS gamma_a, round(g1, 4) AS gamma_b, round(g2, 4) AS gamma_c, round(y - g0 * a - g1 * b - g2 * c, 5) AS spread FROM gm",
    ("monthly",),
)
def rolling_hedge_gammas(spark, sf):
    """Each brand on three others by the 36 months before."""
    rows = hedges.rolling_hedge(_legs(spark, sf), "y", ["a", "b", "c"], 36).where("fitted")
    return rows.select("asset", "t_idx", *[F.round(f"gamma_{x}", 4).alias(f"gamma_{x}") for x in "abc"], F.round("spread", 5).alias("spread"))


@query(
    "constant_hedge_gammas",
    f"WITH {_WIDE}, sm AS (SELECT asset, {', '.join(f'sum({_WHOLE.format(v)}) AS {k}' for k, v in _SUMS.items())} FROM hg WHERE t_idx < 48 GROUP BY 1), gm AS (SELECT asset, {', '.join(f'{e} AS g{i}' for i, e in enumerate(_cramer()))} FROM sm) SELECT asset, t_idx, round(g0, 4) AS gamma_a, round(g1, 4) AS gamma_b, round(g2, 4) AS gamma_c, round(y - g0 * a - g1 * b - g2 * c, 5) AS spread FROM hg LEFT JOIN gm USING (asset)",
    ("monthly",),
)
def constant_hedge_gammas(spark, sf):
    """Each brand on three others by the first four years, and the spread in all."""
    rows = hedges.constant_hedge(_legs(spark, sf), "y", ["a", "b", "c"], F.col("t_idx") < 48)
    return rows.select("asset", "t_idx", *[F.round(f"gamma_{x}", 4).alias(f"gamma_{x}") for x in "abc"], F.round("spread", 5).alias("spread"))
