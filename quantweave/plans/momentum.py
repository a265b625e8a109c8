"""Walk-forward network momentum on months, step by step, with SQL for each step."""

from pyspark.sql import functions as F

from quantweave.operators import momentum as M
from quantweave.operators import walkforward
from quantweave.sources import panels
from quantweave.sources.stored import stored

from .registry import query
from .studies import _ALPHAS, _EWMAS

_HORIZONS, _SPEEDS, _WINDOWS = (1, 2, 3, 6, 12), [(2, 6), (4, 12), (8, 24)], [6, 12]
_NAMES = M.names(_HORIZONS, _SPEEDS)
_SIZE, _FIRST, _TEST, _EVERY, _HALFLIFE, _CLIP = len(_NAMES), 36, 12, 3, 12, 2.0


def _tensor(spark, sf):
    return M.tensor(panels.monthly(spark, sf), _HORIZONS, _SPEEDS, 12, 24, (12, 6), _HALFLIFE, _CLIP)


def _graphs(features):
    """The assets of each date, the graph in force, its versions, and the graphs."""
    there = stored(M.members(features, min(_WINDOWS)))
    plan = stored(M.schedule(there, _EVERY))
    return there, plan, M.versions(plan), stored(M.learnt(features, there, plan, _WINDOWS, 5))


def _network(features):
    there, _, held, edges = _graphs(features)
    return M.spread_over(features, there, held, edges, _SIZE)


# --- the same in SQL ----------------------------------------------------------------------------

_A = f"(1 - power(0.5, 1.0 / {_HALFLIFE}))"
_STEP = {
    "m": "CASE WHEN ew.m_{c} IS NULL THEN raw.{c} WHEN raw.{c} IS NULL THEN ew.m_{c} ELSE (1 - {a}) * ew.m_{c} + {a} * raw.{c} END",
    "q": "CASE WHEN ew.q_{c} IS NULL THEN raw.{c} * raw.{c} WHEN raw.{c} IS NULL THEN ew.q_{c} ELSE (1 - {a}) * ew.q_{c} + {a} * raw.{c} * raw.{c} END",
    "s": "CASE WHEN ew.s_{c} IS NULL THEN CASE WHEN raw.{c} IS NOT NULL THEN 1.0::DOUBLE END ELSE (1 - {a}) * (1 - {a}) * ew.s_{c} + {a} * {a} END",
    "n": "ew.n_{c} + (raw.{c} IS NOT NULL)::INT",
}
_START = {"m": "{c}", "q": "{c} * {c}", "s": "CASE WHEN {c} IS NOT NULL THEN 1.0::DOUBLE END", "n": "({c} IS NOT NULL)::INT"}
_each = lambda form, sep=", ": sep.join(form.format(c=c, a=_A) for c in _NAMES)
_CLIPPED = "CASE WHEN n_{c} >= 6 AND n_{c} > 1 AND s_{c} < 1 THEN least(greatest({c}, m_{c} - 2 * sqrt(greatest(q_{c} - m_{c} * m_{c}, 0) / (1 - s_{c}))), m_{c} + 2 * sqrt(greatest(q_{c} - m_{c} * m_{c}, 0) / (1 - s_{c}))) ELSE {c} END AS {c}"

_FEATURES = f"""fp AS (SELECT asset, t, t_idx, last_value(price IGNORE NULLS) OVER (PARTITION BY asset ORDER BY t_idx) AS price FROM monthly),
x AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t_idx) AS k FROM fp WHERE price IS NOT NULL),
fr AS (SELECT *, ln(price / lag(price) OVER (PARTITION BY asset ORDER BY t_idx)) AS r FROM x),
fv AS (SELECT *, CASE WHEN count(r) OVER f >= 6 THEN stddev_samp(r) OVER f END AS sd FROM fr WINDOW f AS (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
vs AS (SELECT asset, t_idx, k, r, sd, lead(r / (sd + 1e-10)) OVER w AS y, {", ".join(f"ln(price / lag(price, {h}) OVER w) / (sd * sqrt({h}) + 1e-10) AS vsr_{h}" for h in _HORIZONS)} FROM fv WINDOW w AS (PARTITION BY asset ORDER BY t_idx)),
{_EWMAS.format(first=", ".join(f"price AS {n}" for n in _ALPHAS), next=", ".join(f"(1 - {a}) * en.{n} + {a} * x.price" for n, a in _ALPHAS.items()))},
d AS (SELECT *, CASE WHEN count(*) OVER p >= 6 THEN stddev_samp(price) OVER p END + 1e-10 AS pd FROM en WINDOW p AS (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
q AS (SELECT asset, t_idx, (e2 - e6) / pd AS a, (e4 - e12) / pd AS b, (e8 - e24) / pd AS c FROM d),
md AS (SELECT asset, t_idx, {", ".join(f"{x} / (CASE WHEN count({x}) OVER v >= 12 THEN stddev_samp({x}) OVER v END + 1e-10) AS macd_{a}" for x, (a, _) in zip("abc", _SPEEDS, strict=True))} FROM q WINDOW v AS (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
raw AS (SELECT vs.*, {", ".join(f"macd_{a}" for a, _ in _SPEEDS)} FROM vs JOIN md USING (asset, t_idx)),
ew AS (SELECT asset, k, {", ".join(_each(f"{v} AS {n}_{{c}}") for n, v in _START.items())} FROM raw WHERE k = 1
  UNION ALL SELECT raw.asset, raw.k, {", ".join(_each(v) for v in _STEP.values())} FROM ew JOIN raw ON raw.asset = ew.asset AND raw.k = ew.k + 1),
ft AS (SELECT asset, t_idx, r, sd, y, {_each(_CLIPPED)}, ({_each("{c}", " + ")}) IS NOT NULL AS ok FROM raw JOIN ew USING (asset, k))"""

_PLAN = f"""{_FEATURES},
seen AS (SELECT *, {", ".join(f"count(CASE WHEN ok THEN 1 END) OVER (PARTITION BY asset ORDER BY t_idx ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) = {w} AS w{w}" for w in _WINDOWS)} FROM ft),
mem AS (SELECT t_idx, asset FROM seen WHERE w6 AND t_idx IN (SELECT t_idx FROM seen WHERE w6 GROUP BY 1 HAVING count(*) >= 5)),
sets AS (SELECT t_idx, string_agg(asset, ',' ORDER BY asset) AS s FROM mem GROUP BY 1),
newer AS (SELECT *, CASE WHEN t_idx % {_EVERY} = 0 OR row_number() OVER (PARTITION BY s ORDER BY t_idx) = 1 THEN t_idx END AS f FROM sets),
plan AS (SELECT t_idx, last_value(f IGNORE NULLS) OVER (PARTITION BY s ORDER BY t_idx ROWS UNBOUNDED PRECEDING) AS fit_idx FROM newer)"""

_LEARNT = f"""{_PLAN},
stk AS (SELECT win, f.fit_idx AS t, s.asset, flatten(list([{", ".join(_NAMES)}] ORDER BY s.t_idx)) AS v
  FROM (SELECT DISTINCT fit_idx FROM plan) f, (SELECT unnest({_WINDOWS}) AS win) g JOIN ft s ON s.t_idx < f.fit_idx AND s.t_idx >= f.fit_idx - win AND ok
  WHERE (f.fit_idx, s.asset) IN (SELECT (t_idx, asset) FROM mem) GROUP BY 1, 2, 3 HAVING count(*) = win),
unit AS (SELECT win, t, asset, list_transform(v, lambda e: e / (sqrt(list_dot_product(v, v)) + 1e-10)) AS v FROM stk
  WHERE (win, t) IN (SELECT (win, t) FROM stk GROUP BY win, t HAVING count(*) >= 5)),
hf AS (SELECT a.win, a.t, a.asset AS i, b.asset AS j, round(list_dot_product(a.v, b.v), 12) AS s FROM unit a JOIN unit b ON a.win = b.win AND a.t = b.t AND a.asset < b.asset),
cs AS (SELECT * FROM hf UNION ALL SELECT win, t, j, i, s FROM hf),
cut AS (SELECT win, t, round(quantile_cont(s, 0.5), 12) AS c FROM cs WHERE s > 0 GROUP BY 1, 2),
gr AS (SELECT win, t, i, j, s - c AS w FROM cs JOIN cut USING (win, t) WHERE s > c),
en2 AS (SELECT t, i, j, sum(w) / (SELECT count(DISTINCT win) FROM gr h WHERE h.t = gr.t) AS w FROM gr GROUP BY 1, 2, 3),
dg AS (SELECT t, i, sum(w) AS d FROM en2 GROUP BY 1, 2),
edges AS (SELECT e.t AS fit_idx, e.i, e.j, e.w / sqrt(a.d * b.d) AS w FROM en2 e JOIN dg a ON a.t = e.t AND a.i = e.i JOIN dg b ON b.t = e.t AND b.i = e.j)"""

_SPREAD = f"""{_LEARNT},
sums AS (SELECT p.t_idx, e.i AS asset, {_each("sum(e.w * ft.{c}) AS {c}")} FROM plan p JOIN edges e USING (fit_idx) JOIN ft ON ft.t_idx = p.t_idx AND ft.asset = e.j GROUP BY 1, 2),
net AS (SELECT m.t_idx, m.asset, {_each("coalesce({c}, 0) AS {c}")} FROM mem m LEFT JOIN sums USING (t_idx, asset))"""

_TERMS = [*_NAMES, "1.0"]
_MATRIX = "[" + ", ".join("[" + ", ".join(f"sum({a} * {b})" + (" + 1e-4" if i == j and i < _SIZE else "") for j, b in enumerate(_TERMS)) + f", sum({a} * y)]" for i, a in enumerate(_TERMS)) + "]"
_SOLVED = f"""{_SPREAD},
last AS (SELECT max(t_idx) AS last FROM monthly),
spans AS (SELECT k AS period, {_FIRST} + {_TEST} * k AS test_from, least({_FIRST + _TEST} + {_TEST} * k, last + 1) AS test_to FROM last, LATERAL (SELECT unnest(range(0, (last - {_FIRST}) // {_TEST} + 1)) AS k)),
fitted AS (SELECT 'network' AS model, net.*, y FROM net JOIN ft USING (t_idx, asset) UNION ALL SELECT 'own', t_idx, asset, {_each("{c}")}, y FROM ft WHERE ok),
aug AS (SELECT model, period, {_MATRIX} AS m FROM fitted JOIN spans ON t_idx < test_from WHERE y IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3),
gj AS (SELECT model, period, 0 AS k, m FROM aug UNION ALL
  SELECT model, period, k + 1, list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(row, lambda e: e / row[k + 1]) ELSE list_transform(row, lambda e, c: e - row[k + 1] * m[k + 1][c] / m[k + 1][k + 1]) END) FROM gj WHERE k < {_SIZE + 1}),
coefs AS (SELECT model, period, {", ".join(f"m[{i + 1}][{_SIZE + 2}] AS c_{i}" for i in range(_SIZE + 1))} FROM gj WHERE k = {_SIZE + 1})"""


def _columns(df, *keys, vector="x"):
    return df.select(*keys, *[F.round(F.col(vector)[i], 5).alias(n) for i, n in enumerate(_NAMES)])


@query("momentum_tensor", f"WITH RECURSIVE {_FEATURES} SELECT t_idx, asset, round(y, 5) AS y, {_each('round({c}, 4) AS {c}')} FROM ft", ("monthly",))
def momentum_tensor(spark, sf):
    """Eight features a brand and month, clipped to two weighted deviations."""
    return _tensor(spark, sf).select("t_idx", "asset", F.round("y", 5).alias("y"), *[F.round(c, 4).alias(c) for c in _NAMES])


@query(
    "graph_versions",
    f"""WITH RECURSIVE {_LEARNT}, isl AS (SELECT *, sum(CASE WHEN t_idx = b + 1 AND fit_idx = g THEN 0 ELSE 1 END) OVER (ORDER BY t_idx) AS n FROM (SELECT *, lag(t_idx) OVER (ORDER BY t_idx) AS b, lag(fit_idx) OVER (ORDER BY t_idx) AS g FROM plan)),
    v AS (SELECT n, fit_idx, min(t_idx) AS valid_from, max(t_idx) AS valid_to FROM isl GROUP BY 1, 2)
    SELECT fit_idx, valid_from, valid_to, count(*) AS edges, round(sum(w), 4) AS weight FROM v JOIN edges USING (fit_idx) GROUP BY 1, 2, 3""",
    ("monthly",),
)
def graph_versions(spark, sf):
    """From when to when each learnt graph is in force, and its size."""
    _, _, held, edges = _graphs(stored(_tensor(spark, sf)))
    return held.join(edges, "fit_idx").groupBy("fit_idx", "valid_from", "valid_to").agg(F.count("*").alias("edges"), F.round(F.sum("w"), 4).alias("weight"))


@query("network_tensor", f"WITH RECURSIVE {_SPREAD} SELECT t_idx, asset, {_each('round({c}, 5) AS {c}')} FROM net", ("monthly",))
def network_tensor(spark, sf):
    """Every brand's features as its neighbours have them, by the graph in force."""
    return _columns(_network(stored(_tensor(spark, sf))), "t_idx", "asset")


@query("network_ridge", f"WITH RECURSIVE {_SOLVED} SELECT model, period::INT AS period, {', '.join(f'round(c_{i}, 4) AS c_{i}' for i in range(_SIZE + 1))} FROM coefs", ("monthly",))
def network_ridge(spark, sf):
    """Pooled ridge on eight features and an intercept, own and the neighbours', from all months before each test."""
    features = stored(_tensor(spark, sf))
    last = features.agg(F.max("t_idx")).first()[0]  # one number
    tests = 0 if last is None or last < _FIRST else (last - _FIRST) // _TEST + 1
    y = features.select("t_idx", "asset", "y")
    made = None
    for model, rows in (("network", _network(features)), ("own", features.select("t_idx", "asset", F.col("u").alias("x")))):
        fit = M.block_ridge(rows.join(y, ["t_idx", "asset"]), _SIZE, _FIRST, _TEST).where(F.col("period") < tests)
        fit = fit.select(F.lit(model).alias("model"), "period", *[F.round(F.col("coefs")[i], 4).alias(f"c_{i}") for i in range(_SIZE + 1)])
        made = fit if made is None else made.union(fit)
    return made


@query(
    "graph_walk_forward",
    f"""WITH RECURSIVE {_SOLVED},
    pred AS (SELECT model, f.t_idx, f.asset, sign({" + ".join(f"c_{i} * {c}" for i, c in enumerate(_NAMES))} + c_{_SIZE}) AS p FROM fitted f JOIN spans s ON f.t_idx >= test_from AND f.t_idx < test_to JOIN coefs USING (model, period)),
    days AS (SELECT ft.t_idx, ft.asset, sd, {" + ".join(f"coalesce(macd_{a}, 0) * exp(-(coalesce(macd_{a}, 0) ** 2) / 4) / 0.89" for a, _ in _SPEEDS)} AS m FROM ft JOIN spans ON ft.t_idx >= test_from AND ft.t_idx < test_to),
    pos AS (SELECT d.t_idx, d.asset, d.sd, k.strategy, CASE k.strategy WHEN 'network' THEN coalesce(a.p, 0) WHEN 'own' THEN coalesce(b.p, 0) WHEN 'macd' THEN m / 3 ELSE 1 END AS x
      FROM days d CROSS JOIN (VALUES ('network'), ('own'), ('macd'), ('long')) k(strategy) LEFT JOIN pred a ON a.model = 'network' AND a.t_idx = d.t_idx AND a.asset = d.asset LEFT JOIN pred b ON b.model = 'own' AND b.t_idx = d.t_idx AND b.asset = d.asset),
    ah AS (SELECT t_idx, asset, lead(sd, 2) OVER w AS s2, lead(r, 2) OVER w AS r2 FROM ft WINDOW w AS (PARTITION BY asset ORDER BY t_idx)),
    mv AS (SELECT *, x * 0.1 / (s2 * sqrt(12) + 1e-10) * r2 AS paid, abs(x - coalesce(lag(x) OVER (PARTITION BY strategy, asset ORDER BY t_idx), 0)) * 0.1 / (sd * sqrt(12) + 1e-10) AS moved FROM pos JOIN ah USING (t_idx, asset))
    SELECT t_idx, strategy, round(avg(paid), 6) AS r, round(avg(moved), 5) AS turnover, count(paid) AS n FROM mv GROUP BY 1, 2 HAVING count(paid) > 0""",
    ("monthly",),
)
def graph_walk_forward(spark, sf):
    """Four strategies out of sample: graphs relearnt every three months, coefficients every year, profits two months on."""
    panel = panels.monthly(spark, sf)
    features = stored(_tensor(spark, sf))
    spans = walkforward.periods(panel, _FIRST, _TEST)
    positions = M.strategies(features, stored(_network(features)), spans, _FIRST, _TEST, _SPEEDS, _SIZE)
    out = M.portfolio(positions, features, periods_a_year=12)
    return out.select("t_idx", "strategy", F.round("r", 6).alias("r"), F.round("turnover", 5).alias("turnover"), "n")


