"""Queries of strategies that are refitted in every sample of a bootstrap."""

from quantweave.operators import refits, resampling

from .network import _FEAT, _features
from .periods import _cramer
from .registry import query
from .series import rounded

_BLOCK, _SAMPLES, _WARM = 6, 100, 4
# a = 1, b = z1, c = z12; the ridge's penalty of 1 stands on b and c
_MOMENTS = f"""pm AS (SELECT row_number() OVER (ORDER BY t_idx) - 1 AS k, count(*) AS n, sum(z1) AS ab, sum(z12) AS ac, sum(z1 * z1) AS bb, sum(z1 * z12) AS bc, sum(z12 * z12) AS cc, sum(ret_fwd) AS ya, sum(z1 * ret_fwd) AS yb, sum(z12 * ret_fwd) AS yc
      FROM ft WHERE ret_fwd IS NOT NULL GROUP BY t_idx),
    nn AS (SELECT count(*) AS m FROM pm), ix AS (SELECT s AS sample, p // {_BLOCK} AS block, ((('0x' || substr(md5('42-' || s || '-' || (p // {_BLOCK})), 1, 12))::BIGINT % m) + p % {_BLOCK}) % m AS k FROM nn, LATERAL (SELECT unnest(range({_SAMPLES})) AS s), LATERAL (SELECT unnest(range(m)) AS p)),
    dr AS (SELECT sample, block, pm.* FROM ix JOIN pm USING (k)),
    tr AS (SELECT q.sample, q.block, sum(n) AS aa, sum(ab) AS ab, sum(ac) AS ac, sum(bb) + 1 AS bb, sum(bc) AS bc, sum(cc) + 1 AS cc, sum(ya) AS ya, sum(yb) AS yb, sum(yc) AS yc
      FROM (SELECT DISTINCT sample, block FROM ix WHERE block >= {_WARM}) q JOIN dr ON dr.sample = q.sample AND dr.block < q.block GROUP BY 1, 2),
    ge AS (SELECT *, {', '.join(f'{e} AS g{i}' for i, e in enumerate(_cramer()))} FROM tr),
    fi AS (SELECT sample, block, g0, g1, g2, sqrt((g0 * g0 * aa + g1 * g1 * (bb - 1) + g2 * g2 * (cc - 1) + 2 * (g0 * g1 * ab + g0 * g2 * ac + g1 * g2 * bc)) / aa) AS w FROM ge),
    pn AS (SELECT sample, s.strategy, s.r FROM dr JOIN fi USING (sample, block), LATERAL (VALUES ('refit', (g0 * ya + g1 * yb + g2 * yc) / w / n), ('hold', ya / n), ('z1', yb / n), ('z12', yc / n)) s(strategy, r)),
    bs AS (SELECT sample, strategy, CASE WHEN stddev_samp(r) > 1e-12 THEN avg(r) / stddev_samp(r) * sqrt(12) ELSE 0 END AS sharpe FROM pn GROUP BY 1, 2)"""


def _sharpes(spark, sf):
    return refits.bootstrap(_features(spark, sf), "ret_fwd", ["z1", "z12"], _BLOCK, _SAMPLES, _WARM, penalty=1.0)


@query("bootstrap_refits", f"WITH {_FEAT}, {_MOMENTS} SELECT sample, strategy, round(sharpe, 6) AS sharpe FROM bs", ("mret",))
def bootstrap_refits(spark, sf):
    """Sharpe ratios of a ridge on two momenta, refitted every half year, beside each alone and equal weights, in 100 samples."""
    return rounded(_sharpes(spark, sf), "sample", "strategy", sharpe="sharpe")


@query(
    "refit_significance",
    f"""WITH {_FEAT}, {_MOMENTS}, p AS (SELECT a.strategy, a.sharpe, b.sharpe AS base FROM bs a JOIN bs b ON b.sample = a.sample AND b.strategy = 'z12' WHERE a.strategy <> 'z12'),
    d AS (SELECT strategy, sharpe - base AS d FROM p WHERE sharpe <> base), rk AS (SELECT *, rank() OVER (PARTITION BY strategy ORDER BY abs(d)) + (count(*) OVER (PARTITION BY strategy, abs(d)) - 1) / 2.0 AS k FROM d), w AS (SELECT strategy, sum(CASE WHEN d > 0 THEN k ELSE 0 END) AS w_stat FROM rk GROUP BY 1)
    SELECT strategy, round(avg(sharpe), 6) AS mean, round(avg(base), 6) AS base_mean, round(any_value(w_stat), 6) AS w_stat FROM p JOIN w USING (strategy) GROUP BY 1""",
    ("mret",),
)
def refit_significance(spark, sf):
    """Signed ranks of each strategy's ratio against momentum's over the samples."""
    return rounded(resampling.significance(_sharpes(spark, sf), "z12"), "strategy", mean="mean", base_mean="base_mean", w_stat="w_stat")
