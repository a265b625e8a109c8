"""Intraday bars: sessions, panels, profiles, reconciliation of two sources, bar factors.

Bars are (ticker, ts, open, high, low, close, volume) with ts in local time.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

OPEN_HOUR, BREAK_HOUR, BARS, MINUTES = 18, 17, 276, 5


def local(ts: Column | str, zone: str) -> Column:
    """Wall-clock time of an instant in a zone."""
    return F.from_utc_timestamp(ts, zone).cast("timestamp_ntz")


def trade_date(ts: Column | str = "ts") -> Column:
    """From 18:00 on a bar belongs to the next day."""
    return F.to_date(F.col(ts) + F.expr(f"INTERVAL {24 - OPEN_HOUR} HOURS") if isinstance(ts, str) else ts + F.expr(f"INTERVAL {24 - OPEN_HOUR} HOURS"))


def hhmm(ts: str = "ts") -> Column:
    return F.hour(ts) * 100 + F.minute(ts)


def keep_session(bars: DataFrame, first: int = 930, last: int = 1600) -> DataFrame:
    """Bars between two times of day, both included."""
    return bars.where(hhmm().between(first, last))


def standardise_session(bars: DataFrame) -> DataFrame:
    """Every bar of each session with a bar, from 18:00 of the day before for 276 five-minute steps.

    The break is dropped; a gap has the last close of the session as all its
    prices and no volume; bars before a session's first price are left out."""
    rows = bars.where((F.hour("ts") < BREAK_HOUR) | (F.hour("ts") >= OPEN_HOUR)).withColumn("trade_date", trade_date())
    start = F.col("trade_date").cast("timestamp_ntz") - F.expr(f"INTERVAL {24 - OPEN_HOUR} HOURS")
    stop = start + F.expr(f"INTERVAL {(BARS - 1) * MINUTES} MINUTES")
    grid = rows.select("ticker", "trade_date").distinct().select("ticker", "trade_date", F.explode(F.sequence(start, stop, F.expr(f"INTERVAL {MINUTES} MINUTES"))).alias("ts"))
    full = grid.join(rows, ["ticker", "trade_date", "ts"], "left")
    carried = F.last("close", ignorenulls=True).over(W.partitionBy("ticker", "trade_date").orderBy("ts"))
    full = full.withColumn("close", carried).where("close is not null")
    return full.select("ticker", "trade_date", "ts", *[F.coalesce(c, "close").alias(c) for c in ("open", "high", "low")], "close", F.coalesce("volume", F.lit(0.0)).alias("volume"))


def bar_panel(bars: DataFrame, floor: float = -20.0) -> DataFrame:
    """trade_date, interval (HHMM), bar_idx, log_r2 (floored), log_vol, bar_ret of each bar."""
    import math

    ret = F.try_divide(F.col("close") - F.col("open"), F.col("open"))
    rows = bars.withColumns({"trade_date": trade_date(), "interval": hhmm(), "bar_ret": ret})
    rows = rows.withColumn("bar_idx", F.row_number().over(W.partitionBy("ticker", "trade_date").orderBy("ts")) - 1)
    log_r2 = F.log(F.greatest(F.col("bar_ret") * F.col("bar_ret"), F.lit(math.exp(floor))))
    return rows.where("bar_ret is not null and volume is not null").select("ticker", "ts", "trade_date", "interval", "bar_idx", log_r2.alias("log_r2"), F.log(F.greatest("volume", F.lit(1.0))).alias("log_vol"), "bar_ret")


def volume_deviation(panel: DataFrame) -> DataFrame:
    """vol_dev: log volume standardised within the time of day; a deviation of 0 counts as 1."""
    own = W.partitionBy("ticker", "interval")
    std = F.coalesce(F.nullif(F.stddev_samp("log_vol").over(own), F.lit(0.0)), F.lit(1.0))
    return panel.withColumn("vol_dev", (F.col("log_vol") - F.avg("log_vol").over(own)) / std)


def train_volume_deviation(panel: DataFrame, share: float = 0.7) -> DataFrame:
    """The same with means and deviations of the first share of dates only, applied to all; `train` tells them apart."""
    days = panel.select("ticker", "trade_date").distinct()
    by = W.partitionBy("ticker")
    days = days.withColumn("train", F.row_number().over(by.orderBy("trade_date")) <= F.floor(share * F.count("*").over(by)))
    rows = panel.join(days, ["ticker", "trade_date"])
    stats = rows.where("train").groupBy("ticker", "interval").agg(F.avg("log_vol").alias("mu"), F.greatest(F.coalesce(F.stddev_samp("log_vol"), F.lit(1.0)), F.lit(1e-8)).alias("sd"))
    return rows.join(stats, ["ticker", "interval"], "left").withColumn("vol_dev", (F.col("log_vol") - F.col("mu")) / F.col("sd")).drop("mu", "sd")


def daily_returns(bars: DataFrame) -> DataFrame:
    """First open to last close of each trade date with a positive open."""
    day = bars.withColumn("trade_date", trade_date()).groupBy("ticker", "trade_date").agg(F.min_by("open", "ts").alias("o"), F.max_by("close", "ts").alias("c"))
    return day.where("o > 0").select("ticker", "trade_date", ((F.col("c") - F.col("o")) / F.col("o")).alias("daily_ret"))


def resample(bars: DataFrame, minutes: int) -> DataFrame:
    """Longer bars labelled by their ends; a bar holds what lies after the last end up to its own."""
    step = minutes * 60
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    end = F.timestamp_seconds(F.ceil(seconds / step) * step).cast("timestamp_ntz")
    return bars.groupBy("ticker", end.alias("ts_end")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str]) -> DataFrame:
    """The latest values of `right` at or before each row of `left`: one window over the union, no band join."""
    kinds = {f.name: f.dataType for f in right.schema.fields}
    a = left.select("*", F.col(left_ts).alias("_at"), F.lit(1).alias("_side"), *[F.lit(None).cast(kinds[v]).alias(f"_{v}") for v in values])
    b = right.select(*keys, F.col(right_ts).alias("_at"), F.lit(0).alias("_side"), *[F.col(v).alias(f"_{v}") for v in values])
    rows = a.unionByName(b, allowMissingColumns=True)
    run = W.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    for v in values:
        rows = rows.withColumn(v, F.last(f"_{v}", ignorenulls=True).over(run))
    return rows.where("_side = 1").select(*left.columns, *values)


def coverage(bars: DataFrame) -> DataFrame:
    """Rows, dates, span, bars a date and share without volume of each ticker."""
    day = bars.withColumn("d", F.to_date("ts")).groupBy("ticker", "d").agg(F.count("*").alias("n"), F.count_if(F.col("volume") == 0).alias("z"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return day.groupBy("ticker").agg(
        F.sum("n").alias("bars"), F.count("*").alias("dates"), F.min("a").alias("first_ts"), F.max("b").alias("last_ts"), F.min("n").alias("min_bars"), F.percentile("n", 0.5).alias("median_bars"), F.max("n").alias("max_bars"), (F.sum("z") / F.sum("n")).alias("zero_volume")
    )


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bars that both sources have, with differences of closes in value, bps and sign of return."""
    one, two = (df.select("ticker", "ts", *[F.col(c).alias(f"{c}_{s}") for c in ("open", "close", "volume")]) for df, s in ((a, "a"), (b, "b")))
    rows = one.join(two, ["ticker", "ts"])
    diff = F.col("close_a") - F.col("close_b")
    sign = F.signum(F.col("close_a") - F.col("open_a")) == F.signum(F.col("close_b") - F.col("open_b"))
    return rows.withColumns({"diff": diff, "abs_diff": F.abs(diff), "bps": F.try_divide(F.abs(diff), F.abs("close_b")) * 1e4, "volume_ratio": F.try_divide("volume_a", "volume_b"), "same_sign": sign})


def reconciliation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts of both sources, of the overlap and of either alone, with quantiles of the difference."""
    both = align(a, b).groupBy("ticker").agg(F.count("*").alias("matched"), F.percentile("bps", 0.5).alias("median_bps"), F.percentile("bps", 0.95).alias("p95_bps"), F.max("bps").alias("max_bps"), F.avg(F.col("same_sign").cast("double")).alias("sign_share"))
    count = lambda df, c: df.groupBy("ticker").agg(F.count("*").alias(c))
    out = count(a, "n_a").join(count(b, "n_b"), "ticker", "full").join(both, "ticker", "left").na.fill(0, ["n_a", "n_b", "matched"])
    return out.withColumns({"only_a": F.col("n_a") - F.col("matched"), "only_b": F.col("n_b") - F.col("matched")})


def daily_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bars by date of source a, source b and both, absent dates as 0."""
    count = lambda df, c: df.groupBy("ticker", F.to_date("ts").alias("d")).agg(F.count("*").alias(c))
    both = a.select("ticker", "ts").join(b.select("ticker", "ts"), ["ticker", "ts"], "left_semi")
    return count(a, "n_a").join(count(b, "n_b"), ["ticker", "d"], "full").join(count(both, "n_both"), ["ticker", "d"], "full").na.fill(0)


def profile(bars: DataFrame, by: Column, name: str) -> DataFrame:
    """Bars, mean return and mean volume by a part of the time."""
    ret = F.try_divide(F.col("close"), F.col("open")) - 1
    return bars.groupBy("ticker", by.alias(name)).agg(F.count("*").alias("n"), F.avg(ret).alias("mean_ret"), F.avg("volume").alias("mean_volume"))


def body_ratio(window: int = 1, order: str = "ts") -> Column:
    """(close - open) over (high - low), each summed over `window` bars; null where nothing moved."""
    frame = W.partitionBy("ticker").orderBy(order).rowsBetween(-(window - 1), 0)
    body, room = F.col("close") - F.col("open"), F.col("high") - F.col("low")
    if window == 1:
        return F.try_divide(body, F.nullif(room, F.lit(0.0)))
    return F.when(F.count(body).over(frame) == window, F.try_divide(F.sum(body).over(frame), F.nullif(F.sum(room).over(frame), F.lit(0.0))))


def vote(factors: list[Column], least: int) -> Column:
    """+1 or -1 when `least` of the factors' signs agree, else 0."""
    total = sum((F.coalesce(F.signum(f), F.lit(0.0)) for f in factors), F.lit(0.0))
    return F.when(total >= least, 1).when(total <= -least, -1).otherwise(0)


def vol_target(sigma: Column, target: float = 0.1, bars: int = 276) -> Column:
    """target over annual volatility, the latter within 1 % to 500 %, the position within 0 to 3."""
    annual = F.least(F.greatest(sigma * (252 * bars) ** 0.5, F.lit(0.01)), F.lit(5.0))
    return F.least(F.greatest(target / annual, F.lit(0.0)), F.lit(3.0))


def volatility_fit(panel: DataFrame) -> DataFrame:
    """Log variance by time of day and lagged volume, within the sample; `fit_and_predict` looks ahead.

    Time-of-day effects are means of log_r2; the rest is regressed on the volume
    deviation of the bar before, with a slope of its own for each time of day."""
    run = W.partitionBy("ticker").orderBy("ts")
    rows = panel.withColumn("v1", F.coalesce(F.lag("vol_dev").over(run), F.lit(0.0))).withColumn("tod", F.avg("log_r2").over(W.partitionBy("ticker", "interval")))
    rows = rows.withColumn("rest", F.col("log_r2") - F.col("tod"))
    own = W.partitionBy("ticker", "interval")
    rows = rows.withColumn("beta", F.coalesce(F.try_divide(F.sum(F.col("v1") * F.col("rest")).over(own), F.nullif(F.sum(F.col("v1") * F.col("v1")).over(own), F.lit(0.0))), F.lit(0.0)))
    return rows.withColumns({"fitted": F.col("tod") + F.col("beta") * F.col("v1")}).withColumn("residual", F.col("log_r2") - F.col("fitted"))


def matched_averages(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by, field, n, mean_a, mean_b) over the bars that both sources have, a row a field.

    `by` names columns of the matched bars: ticker, or ticker and hhmm."""
    fields = ("open", "high", "low", "close", "volume")
    both = a.select("ticker", "ts", *[F.col(f).alias(f"a_{f}") for f in fields]).join(b.select("ticker", "ts", *[F.col(f).alias(f"b_{f}") for f in fields]), ["ticker", "ts"]).withColumn("hhmm", hhmm())
    long = both.select(*by, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("a"), F.col(f"b_{f}").alias("b")) for f in fields])).alias("x"))
    return long.groupBy(*by, "x.field").agg(F.count("*").alias("n"), F.avg("x.a").alias("mean_a"), F.avg("x.b").alias("mean_b"))


def rolling_difference(aligned: DataFrame, value: str = "abs_diff", most: int = 78) -> DataFrame:
    """`smooth`: mean of the last min(most, max(5, n / 10)) values by ticker, n being its bars."""
    n = aligned.groupBy("ticker").agg(F.count("*").alias("_n"))
    rows = aligned.join(F.broadcast(n), "ticker").withColumn("_w", F.least(F.lit(most), F.greatest(F.lit(5), F.floor(F.col("_n") / 10))))
    run = W.partitionBy("ticker").orderBy("ts")
    # the widest frame, of which the last _w values count
    seen = F.collect_list(value).over(run.rowsBetween(-(most - 1), 0))
    rows = rows.withColumn("_v", F.slice(seen, -F.least(F.col("_w"), F.size(seen)).cast("int"), F.least(F.col("_w"), F.size(seen)).cast("int")))
    return rows.withColumn("smooth", F.aggregate("_v", F.lit(0.0), lambda s, x: s + x) / F.size("_v")).drop("_n", "_w", "_v")


def largest(rows: DataFrame, value: str, many: int = 15, ties: tuple[str, ...] = ("ticker", "ts")) -> DataFrame:
    """The `many` rows of the greatest values, as a report."""
    return rows.where(F.col(value).isNotNull()).orderBy(F.desc(value), *ties).limit(many)


def sample_dates(bars: DataFrame) -> DataFrame:
    """(ticker, place, trade_date): the first, middle and last trade date of each ticker."""
    days = bars.select("ticker", trade_date().alias("trade_date")).distinct()
    own = W.partitionBy("ticker")
    days = days.withColumns({"k": F.row_number().over(own.orderBy("trade_date")) - 1, "n": F.count("*").over(own)})
    place = F.array_compact(F.array(F.when(F.col("k") == 0, F.lit("first")), F.when(F.col("k") == F.floor(F.col("n") / 2), F.lit("middle")), F.when(F.col("k") == F.col("n") - 1, F.lit("last"))))
    return days.select("ticker", F.explode(place).alias("place"), "trade_date")


def fit_and_predict(panel: DataFrame, train_end, smoothing: float = 0.94) -> DataFrame:
    """Bars after trade date `train_end` with tod, tod_v, x_t and h_pred; nothing of them enters the fit. All four are
    null in a bar whose ticker or time of day the training never saw; the bars around it are predicted as if it were not there.

    Trained: volume means and deviations, time-of-day means of log_r2 and slopes on the
    lagged volume deviation, each by time of day. x_t is the exponential average of what
    was left of the bar before, its prediction included: x' = s x + (1 - s) (log_r2 - h)."""
    from .recursive import _numbers, fold

    early = F.col("trade_date") <= F.lit(train_end)
    volume = panel.where(early).groupBy("ticker", "interval").agg(F.avg("log_vol").alias("_m"), F.greatest(F.coalesce(F.stddev_samp("log_vol"), F.lit(0.0)), F.lit(1e-8)).alias("_s"), F.avg("log_r2").alias("tod"))
    rows = panel.join(volume, ["ticker", "interval"]).withColumn("vol_dev", (F.col("log_vol") - F.col("_m")) / F.col("_s"))
    # the bar before, within the training or the predicted bars
    run = W.partitionBy("ticker", early).orderBy("ts")
    rows = rows.withColumn("v1", F.coalesce(F.lag("vol_dev").over(run), F.lit(0.0)))
    slope = rows.where(early).groupBy("ticker", "interval").agg(F.coalesce(F.try_divide(F.sum(F.col("v1") * (F.col("log_r2") - F.col("tod"))), F.sum(F.col("v1") * F.col("v1"))), F.lit(0.0)).alias("beta"))
    late = rows.where(~early).join(slope, ["ticker", "interval"]).withColumn("tod_v", F.col("beta") * F.col("v1")).withColumn("_rest", F.col("log_r2") - F.col("tod") - F.col("tod_v"))

    def smooth(rows):
        rest, x = _numbers(rows["_rest"]), [0.0] * len(rows)
        for k in range(1, len(x)):
            x[k] = smoothing * x[k - 1] + (1 - smoothing) * (rest[k - 1] - x[k - 1])
        return {"x_t": x}

    made = fold(late, smooth, {"x_t": "double"}, ("ticker",), "ts")
    made = made.withColumn("h_pred", F.col("tod") + F.col("tod_v") + F.col("x_t")).drop("_m", "_s", "_rest", "beta")
    unseen = panel.where(~early).join(volume.select("ticker", "interval"), ["ticker", "interval"], "left_anti")
    return made.unionByName(unseen, allowMissingColumns=True)


def managed_strategies(bars: DataFrame, window: int, bars_a_day: int, cost_bps: float = 1.0, delay: int = 2) -> DataFrame:
    """(ticker, ts, strategy, r): buy and hold, the position of a constant volatility, of the
    rolling one and of the last day's, net of cost on position changes; traded `delay` bars late."""
    run = W.partitionBy("ticker").orderBy("ts")
    rows = bars.withColumn("r", F.col("close") / F.lag("close").over(run) - 1)
    square = F.avg(F.col("r") * F.col("r"))

    def sigma(frame, least):
        return F.when(F.count("r").over(frame) >= least, F.sqrt(square.over(frame)))

    all_before, rolling, day = run.rowsBetween(W.unboundedPreceding, 0), run.rowsBetween(-(window - 1), 0), run.rowsBetween(-(bars_a_day - 1), 0)
    least = max(window // 4, 2)
    positions = {"hold": F.lit(1.0), "constant": vol_target(sigma(all_before, least), 0.1, bars_a_day), "rolling": vol_target(sigma(rolling, least), 0.1, bars_a_day), "daily": vol_target(sigma(day, min(least, bars_a_day)), 0.1, bars_a_day)}
    rows = rows.withColumns({f"_{n}": p if n == "hold" else F.when(sigma(all_before, least).isNotNull(), p) for n, p in positions.items()})
    rows = rows.withColumns({f"_{n}": F.lag(f"_{n}", delay).over(run) for n in positions})
    moved = lambda n: F.abs(F.col(f"_{n}") - F.coalesce(F.lag(f"_{n}").over(run), F.lit(0.0)))
    rows = rows.withColumns({f"r_{n}": F.col(f"_{n}") * F.col("r") - cost_bps / 1e4 * moved(n) for n in positions})
    long = rows.select("ticker", "ts", F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(f"r_{n}").alias("r")) for n in positions])).alias("x"))
    return long.select("ticker", "ts", "x.strategy", "x.r").where("r is not null")


def factor_statistics(rows: DataFrame, factor: str, forward: str, cost_bps: float = 1.0, bars_a_year: float = 252 * 24) -> DataFrame:
    """(ticker, n, ic, direction, gross, net, turnover): correlation of the factor with the return
    ahead, the sign that makes the gross Sharpe ratio positive, and both ratios in that direction."""
    run = W.partitionBy("ticker").orderBy("ts")
    rows = rows.where(F.col(factor).isNotNull() & F.col(forward).isNotNull()).withColumn("_g", F.col(factor) * F.col(forward)).withColumn("_d", F.abs(F.col(factor) - F.lag(factor, 1, 0.0).over(run)))
    cost = cost_bps / 1e4 * F.col("_d")
    root = bars_a_year**0.5
    agg = rows.groupBy("ticker").agg(
        F.count("*").alias("n"), F.corr(factor, forward).alias("ic"), F.try_divide(F.avg("_g"), F.stddev_samp("_g")).alias("_q"), F.avg("_d").alias("turnover"),
        F.try_divide(F.avg(F.col("_g") - cost), F.stddev_samp(F.col("_g") - cost)).alias("_up"), F.try_divide(F.avg(-F.col("_g") - cost), F.stddev_samp(-F.col("_g") - cost)).alias("_down"),
    )
    up = F.col("_q") >= 0
    return agg.select("ticker", "n", "ic", F.when(up, 1).otherwise(-1).alias("direction"), (F.abs("_q") * root).alias("gross"), (F.when(up, F.col("_up")).otherwise(F.col("_down")) * root).alias("net"), "turnover")
