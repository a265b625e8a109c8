"""Bootstrap of strategies that are refitted as they go, from moments instead of rows.

A fit needs the sums of cross products of its rows, and the return of a portfolio whose weights are linear in the
regressors needs those of one period. So the panel is read once, into one row a period; each circular block's sums
are formed once from these; and every sample's fits and returns are combinations of drawn blocks. Nothing grows
with samples times assets.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quantweave.operators import hedges, resampling
from quantweave.sources.stored import stored


def period_moments(panel: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(t_idx, n, g<i>_<j>, r<i>, _t): sums of cross products of (1, xs) and with y over a period's rows without nulls;
    t_idx counts the periods that have rows from 0, `_t` is theirs in the panel."""
    terms = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    products = {f"g{i}_{j}": terms[i] * terms[j] for i in range(len(terms)) for j in range(i, len(terms))}
    products |= {f"r{i}": x * F.col(y) for i, x in enumerate(terms)}
    sums = panel.dropna(subset=["t_idx", y, *xs]).groupBy(F.col("t_idx").alias("_t")).agg(F.count("*").alias("n"), *[F.sum(v).alias(k) for k, v in products.items()])
    # one row a period
    return sums.withColumn("t_idx", (F.row_number().over(W.orderBy("_t")) - 1).cast("long"))


def block_moments(moments: DataFrame, block: int) -> DataFrame:
    """(start, sums) of the `block` periods from each start on, past the last one from the first again."""
    names = [c for c in moments.columns if c not in ("t_idx", "_t")]
    # one row a period, `block` times
    at = moments.select(F.col("t_idx").alias("start"), F.count("*").over(W.partitionBy()).alias("_n"))
    at = at.select("start", "_n", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("_o"))  # counted before it repeats
    at = at.select("start", ((F.col("start") + F.col("_o")) % F.col("_n")).alias("t_idx"))
    return at.join(moments.drop("_t"), "t_idx").groupBy("start").agg(*[F.sum(c).alias(c) for c in names])


def refitted(moments: DataFrame, index: DataFrame, terms: int, block: int, warm: int, penalty: float) -> DataFrame:
    """(sample, block, c0, ...): for each block of a sample from number `warm` on, a ridge fit on all its blocks before, the
    constant not penalised, scaled so that its signal's mean square over them is 1; null where the sums are singular."""
    pairs = [(i, j) for i in range(terms) for j in range(i, terms)]
    names = [c for c in moments.columns if c not in ("t_idx", "_t")]
    drawn = index.where(F.col("pos") % block == 0).select("sample", F.floor(F.col("pos") / block).alias("block"), F.col("t_idx").alias("start"))
    before = W.partitionBy("sample").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    rows = drawn.join(block_moments(moments, block), "start").select("sample", "block", *[F.sum(c).over(before).alias(c) for c in names])
    rows = rows.where(F.col("block") >= warm)
    gram = {(i, j): F.col(f"g{i}_{j}") + (penalty if i == j and i else 0.0) for i, j in pairs}
    steps, solution = hedges.solved(gram, [F.col(f"r{i}") for i in range(terms)])
    for name, step in steps:
        rows = rows.withColumn(name, step)
    square = sum((F.col(f"g{i}_{j}") * solution[i] * solution[j] * (1 if i == j else 2) for i, j in pairs), F.lit(0.0)) / F.col("n")
    scale = F.when(square > 0, F.sqrt(square))
    return rows.select("sample", "block", *[(c / scale).alias(f"c{i}") for i, c in enumerate(solution)])


def bootstrap(panel: DataFrame, y: str, xs: list[str], block: int = 22, samples: int = 100, warm: int = 4, penalty: float = 1e-4, periods_a_year: float = 12, seed: int = 42) -> DataFrame:
    """(sample, strategy, sharpe) of `refit` (weights by the fit of y on xs), each of xs alone as weights, and `hold`
    (equal weights), over the periods of each sample's blocks from number `warm` on.

    `panel`: t_idx, y, xs, where y is what a row earns from t_idx on. A drawn period brings its regressors with what
    they earned; they are not formed anew across the joints of blocks. Rows with nulls are left out; a sample without
    two periods after its warm-up has no row or a ratio of 0. A regressor may not be called refit or hold.
    """
    if {"refit", "hold"} & set(xs) or not xs or block < 1 or samples < 1 or warm < 1:
        raise ValueError("a bootstrap needs regressors not called refit or hold, blocks, samples and a warm-up of a block")
    moments = stored(period_moments(panel, y, xs))
    index = resampling.block_index(moments, block, samples, seed).withColumn("block", F.floor(F.col("pos") / block))
    fits = refitted(moments, index, len(xs) + 1, block, warm, penalty)
    own = sum((F.col(f"c{i}") * F.col(f"r{i}") for i in range(1, len(xs) + 1)), F.col("c0") * F.col("r0"))
    earned = {"refit": own, "hold": F.col("r0")} | {x: F.col(f"r{i + 1}") for i, x in enumerate(xs)}
    kinds = F.array(*[F.struct(F.lit(k).alias("strategy"), (v / F.col("n")).alias("r")) for k, v in earned.items()])
    rows = index.join(moments, "t_idx").join(fits, ["sample", "block"]).select("sample", F.explode(kinds).alias("k")).select("sample", "k.*")
    return resampling.compare(rows, periods=periods_a_year)
