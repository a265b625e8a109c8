"""Hedges of one series on several: normal equations from sums of cross products, solved in column expressions.

A window's or a group's Gram matrix is a handful of sums, so sliding windows cost one pass over the rows,
whatever their length, and the solution (a Cholesky factor, forward and back) stays in Catalyst.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def solved(gram: dict[tuple[int, int], Column], right: list[Column]) -> tuple[list[tuple[str, Column]], list[Column]]:
    """Steps (name, expression over earlier names and the inputs) and the solution of a symmetric positive
    definite system; null where a pivot is not above 1e-12 of its diagonal."""
    n, steps, low = len(right), [], {}
    at = lambda i, j: gram[min(i, j), max(i, j)]
    for j in range(n):
        pivot = at(j, j)
        for k in range(j):
            pivot = pivot - low[j, k] * low[j, k]
        steps.append((f"_l{j}_{j}", F.when(pivot > 1e-12 * at(j, j), F.sqrt(pivot))))
        low[j, j] = F.col(f"_l{j}_{j}")
        for i in range(j + 1, n):
            x = at(i, j)
            for k in range(j):
                x = x - low[i, k] * low[j, k]
            steps.append((f"_l{i}_{j}", x / low[j, j]))
            low[i, j] = F.col(f"_l{i}_{j}")
    for i in range(n):
        x = right[i]
        for k in range(i):
            x = x - low[i, k] * F.col(f"_f{k}")
        steps.append((f"_f{i}", x / low[i, i]))
    for i in reversed(range(n)):
        x = F.col(f"_f{i}")
        for k in range(i + 1, n):
            x = x - low[k, i] * F.col(f"_b{k}")
        steps.append((f"_b{i}", x / low[i, i]))
    return steps, [F.col(f"_b{i}") for i in range(n)]


def _products(y: str, xs: list[str]) -> dict[str, Column]:
    """Cross products of a row, null unless the row has y and all of xs."""
    whole = F.col(y).isNotNull()
    for x in xs:
        whole &= F.col(x).isNotNull()
    out = {f"_g{i}_{j}": F.when(whole, F.col(a) * F.col(xs[j])) for i, a in enumerate(xs) for j in range(i, len(xs))}
    return out | {f"_r{i}": F.when(whole, F.col(x) * F.col(y)) for i, x in enumerate(xs)} | {"_whole": F.when(whole, 1)}


def _with_solution(sums: DataFrame, n: int, out: list[str]) -> DataFrame:
    steps, solution = solved({(i, j): F.col(f"_g{i}_{j}") for i in range(n) for j in range(i, n)}, [F.col(f"_r{i}") for i in range(n)])
    for name, step in steps:
        sums = sums.withColumn(name, step)
    rows = sums.withColumns(dict(zip(out, solution, strict=True)))
    return rows.drop(*[name for name, _ in steps])


def rolling_hedge(panel: DataFrame, y: str, xs: list[str], window: int = 60, keys: tuple[str, ...] = ("asset",), prefix: str = "gamma_") -> DataFrame:
    """`panel` with gamma_<x> for each x, by least squares without an intercept over the `window` rows before, and
    `spread`, y less its hedge. `fitted` says whether all those rows are whole; if not, gammas are null, as they
    are where regressors depend on each other. Choose rows by `fitted`: a filter on a gamma would be pushed down
    with the whole solution written out in it."""
    frame = W.partitionBy(*keys).orderBy("t_idx").rowsBetween(-window, -1)
    products = _products(y, xs)
    rows = panel.withColumns(products)
    sums = rows.withColumns({"fitted": F.count("_whole").over(frame) == window} | {k: F.sum(k).over(frame) for k in products if k != "_whole"})
    sums = sums.withColumns({k: F.when(F.col("fitted"), F.col(k)) for k in products if k != "_whole"})
    return _with_spread(_with_solution(sums, len(xs), [prefix + x for x in xs]).drop(*products), y, xs, prefix)


def constant_hedge(panel: DataFrame, y: str, xs: list[str], fit: Column | None = None, keys: tuple[str, ...] = ("asset",), prefix: str = "gamma_") -> DataFrame:
    """`rolling_hedge` with one fit a key, from its whole rows that `fit` accepts (all, if not given)."""
    products = _products(y, xs)
    rows = (panel if fit is None else panel.where(fit)).withColumns(products)
    sums = rows.groupBy(*keys).agg(*[F.sum(k).alias(k) for k in products if k != "_whole"])
    gammas = _with_solution(sums, len(xs), [prefix + x for x in xs]).select(*keys, *[prefix + x for x in xs])
    return _with_spread(panel.join(gammas, list(keys), "left"), y, xs, prefix)


def _with_spread(rows: DataFrame, y: str, xs: list[str], prefix: str) -> DataFrame:
    spread = F.col(y)
    for x in xs:
        spread = spread - F.col(prefix + x) * F.col(x)
    return rows.withColumn("spread", spread)
