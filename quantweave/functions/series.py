"""Column builders for series of dense panels.

A frame counts rows of the panel; nulls take part in none of the values but
hold their places. Every function returns a Column.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PANEL = ("asset",)


def by(*keys: str, order: str = "t_idx"):
    return W.partitionBy(*(keys or PANEL)).orderBy(order)


def rolling(agg, value: Column | str, window: int, least: int | None = None, keys=PANEL, start: int | None = None, end: int = 0, order: str = "t_idx") -> Column:
    """`agg` of the `window` rows up to `end`, null with fewer than `least` values (all, if not given)."""
    value = F.col(value) if isinstance(value, str) else value
    first = end - window + 1 if start is None else start
    frame = by(*keys, order=order).rowsBetween(first, end)
    return F.when(F.count(value).over(frame) >= (end - first + 1 if least is None else least), agg(value).over(frame))


def change(value: str, k: int = 1, keys=PANEL) -> Column:
    return F.col(value) - F.lag(value, k).over(by(*keys))


def log_return(price: str = "price", k: int = 1, keys=PANEL) -> Column:
    last = F.lag(price, k).over(by(*keys))
    return F.when((F.col(price) > 0) & (last > 0), F.log(F.col(price) / last))


def fill_forward(value: str, limit: int | None = None, keys=PANEL) -> Column:
    return F.last(value, ignorenulls=True).over(by(*keys).rowsBetween(W.unboundedPreceding if limit is None else -limit, 0))


def clip(value: Column | str, low, high) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high))


def average_rank(value: str, *keys: str) -> Column:
    """Rank from 1 among the group's values that are not null; equal values share the mean of their ranks."""
    all_, same = W.partitionBy(*keys), W.partitionBy(*keys, value)
    rank = F.rank().over(all_.orderBy(F.col(value).asc_nulls_last()))
    return F.when(F.col(value).isNotNull(), rank + (F.count("*").over(same) - 1) / 2)


def quantile_bucket(value: str, groups: int, *keys: str) -> Column:
    """Bucket from 0 by the group's interpolated quantiles: right-closed, the lowest included, equal edges once."""
    edges = F.array_distinct(F.percentile(value, F.array(*[F.lit(i / groups) for i in range(groups + 1)])).over(W.partitionBy(*keys)))
    below = F.size(F.filter(edges, lambda e: e < F.col(value))) - 1
    return F.when(F.col(value).isNotNull(), F.greatest(below, F.lit(0)))


def response(value: Column | str) -> Column:
    """x exp(-x^2 / 4) / 0.89, which fades out extreme trends."""
    value = F.col(value) if isinstance(value, str) else value
    return value * F.exp(-value * value / 4) / 0.89


def cumulative(value: Column | str, keys=PANEL, order: str = "t_idx") -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.sum(value).over(by(*keys, order=order).rowsBetween(W.unboundedPreceding, 0))


def hysteresis(z: str, enter: float, leave: float, keys=PANEL) -> Column:
    """+1 or -1 from |z| >= enter on until |z| < leave; 0 where z is null, which changes no state."""
    event = F.when(F.col(z) >= enter, 1).when(F.col(z) <= -enter, -1).when(F.abs(z) < leave, 0)
    state = F.last(event, ignorenulls=True).over(by(*keys).rowsBetween(W.unboundedPreceding, 0))
    return F.when(F.col(z).isNull(), 0).otherwise(F.coalesce(state, F.lit(0)))
