"""Made-up panels with known structure, drawn by seeded hashes: the same on every cluster."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantweave.operators.recursive import _numbers, ewma, fold


def normal(*parts) -> Column:
    """A standard normal variable for each value of the parts."""
    u = lambda k: (F.shiftrightunsigned(F.xxhash64(F.lit(k), *[F.lit(p) if isinstance(p, int | str) and not isinstance(p, Column) else p for p in parts]), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * 3.141592653589793 * u(2))


def weekly_panel(spark: SparkSession, weeks: int = 1664, assets: int = 26, slope: float = 0.4, carry: float = 0.05, seed: int = 42) -> DataFrame:
    """t_idx, asset, r, q, residual, basis: r is slope q and an autoregressive residual; the
    basis follows the flow's exponential average."""
    cells = spark.range(assets).select(F.col("id").alias("a")).select("a", F.format_string("C%02d", F.col("a") + 1).alias("asset"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(weeks - 1).cast("long"))).alias("t_idx"))
    cells = cells.withColumns({"_e": normal(F.lit(seed), F.lit("residual"), F.col("a"), F.col("t_idx")) * 0.02, "q": normal(F.lit(seed), F.lit("flow"), F.col("a"), F.col("t_idx")) * 0.03, "_b": normal(F.lit(seed), F.lit("basis"), F.col("a"), F.col("t_idx")) * 0.01})

    def states(rows):
        e, q = _numbers(rows["_e"]), _numbers(rows["q"])
        residual = e.copy()
        for k in range(1, len(e)):
            residual[k] = carry * residual[k - 1] + e[k]
        return {"residual": residual, "_p": ewma(q, 0.1)}

    made = fold(cells, states, {"residual": "double", "_p": "double"})
    return made.select("t_idx", "asset", (slope * F.col("q") + F.col("residual")).alias("r"), "q", "residual", (F.col("_p") + F.col("_b")).alias("basis"))


def lead_lag_market(spark: SparkSession, days: int = 1800, assets: int = 80, leaders: int = 12, seed: int = 7) -> DataFrame:
    """t_idx, asset, r, leader, market_cap, turnover: the first assets lead, each other follows
    one of them a day later through a bent response."""
    cells = spark.range(assets).select(F.col("id").cast("int").alias("a")).select("a", F.format_string("S%03d", F.col("a") + 1).alias("asset"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(days - 1).cast("long"))).alias("t_idx"))
    cells = cells.withColumns({"e": normal(F.lit(seed), F.col("a"), F.col("t_idx")) * 0.01, "leader": (F.col("a") < leaders)})
    lead = cells.where("leader").select(F.col("a").alias("_l"), (F.col("t_idx") + 1).alias("t_idx"), F.col("e").alias("_s"))
    rows = cells.withColumn("_l", F.when(~F.col("leader"), F.col("a") % leaders)).join(F.broadcast(lead) if leaders * days < 1 << 20 else lead, ["_l", "t_idx"], "left")
    bent = F.coalesce(0.5 * F.signum("_s") * F.sqrt(F.abs("_s")) * 0.1 + 0.3 * F.col("_s"), F.lit(0.0))
    cap = F.exp(8 + normal(F.lit(seed), F.lit("cap"), F.col("a")))
    return rows.select("t_idx", "asset", (F.col("e") + bent).alias("r"), "leader", cap.alias("market_cap"), F.exp(normal(F.lit(seed), F.lit("turnover"), F.col("a"), F.col("t_idx")) * 0.2).alias("turnover"))
