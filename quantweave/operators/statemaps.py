"""All threshold pairs of a trading rule in one pass: a step is a map of three states to three.

The two-threshold rule takes a state (flat, long, short) and a score to the next state. Which map a score is
depends on the thresholds, but maps compose, and composing is associative. So a series is cut into blocks;
each block is worked on once, for all pairs and for each state that it could begin in, and gives its map and
its profits from each of them. Walking over the blocks' maps then tells the state that each really began in,
and the block's profits from that state are merged. No row is repeated for a pair of thresholds, and no block
waits for the one before.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States, and the position of each.
FLAT, LONG, SHORT = 0, 1, 2
POSITION = np.array([0, 1, -1])
#: What is known of a stretch of a series from each state: see `_stretch`.
PARTS = ("n", "total", "square", "on", "moved", "first", "last", "peak", "low", "dip")


def step_maps(z: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """[row, pair, state] -> state. A null score changes nothing."""
    z = z[:, None]
    maps = np.empty((len(z), len(enter), 3), np.int8)
    maps[:, :, FLAT] = np.where(z > enter, SHORT, np.where(z < -enter, LONG, FLAT))
    maps[:, :, LONG] = np.where(z > -leave, FLAT, LONG)
    maps[:, :, SHORT] = np.where(z < leave, FLAT, SHORT)
    maps[np.isnan(z[:, 0])] = (FLAT, LONG, SHORT)
    return maps


def composed(maps: np.ndarray) -> np.ndarray:
    """Of each row the map of all rows up to it, by doubling: log2(rows) steps over whole arrays."""
    out, reach = maps.copy(), 1
    while reach < len(out):
        out[reach:] = np.take_along_axis(out[reach:], out[:-reach].astype(np.int64), axis=2)
        reach *= 2
    return out


def _stretch(states: np.ndarray, gap: np.ndarray, owned: np.ndarray, gain: np.ndarray) -> dict[str, np.ndarray]:
    """[pair, state] sums over the owned rows: their number, profits and squares, rows with a position, changes
    of position within, the first and last position; of the running sum of profits the greatest (peak) and
    least (low) value and the deepest fall below the greatest before (dip)."""
    position = POSITION[states]
    position[gap] = 0  # without a score there is no position, whatever the state
    position, gain = position[owned], np.nan_to_num(gain[owned])
    n = len(position)
    if not n:
        none = np.zeros(states.shape[1:])
        return {k: none for k in PARTS} | {"peak": none - np.inf, "low": none + np.inf}
    profit = position * gain[:, None, None]
    run = np.cumsum(profit, axis=0)
    return {
        "n": np.full(states.shape[1:], float(n)),
        "total": run[-1],
        "square": (profit * profit).sum(axis=0),
        "on": (position != 0).sum(axis=0).astype(float),
        "moved": (np.diff(position, axis=0) != 0).sum(axis=0).astype(float),
        "first": position[0].astype(float),
        "last": position[-1].astype(float),
        "peak": run.max(axis=0),
        "low": run.min(axis=0),
        "dip": (run - np.maximum.accumulate(run, axis=0)).min(axis=0),
    }


def merged(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """`_stretch` of two stretches in a row from those of each."""
    both = (a["n"] > 0) & (b["n"] > 0)
    out = {k: a[k] + b[k] for k in ("n", "total", "square", "on")}
    out["moved"] = a["moved"] + b["moved"] + (both & (a["last"] != b["first"]))
    out["first"], out["last"] = np.where(a["n"] > 0, a["first"], b["first"]), np.where(b["n"] > 0, b["last"], a["last"])
    out["peak"], out["low"] = np.maximum(a["peak"], a["total"] + b["peak"]), np.minimum(a["low"], a["total"] + b["low"])
    out["dip"] = np.minimum(np.minimum(a["dip"], b["dip"]), np.where(both, a["total"] + b["low"] - a["peak"], 0.0))
    return out


def sweep(rows: DataFrame, scores: dict[str, list[tuple[float, float]]], series: list[str], restart: str, keep: str, gain: str, block: int = 4096, order: str = "t_idx") -> DataFrame:
    """(series, score, enter, leave, n, total, square, on, moved, dip) for every score column and each of its
    (enter, leave) pairs.

    `rows`: `series` (names of key columns), `restart` (an integer: with each new value a series begins anew,
    flat), t_idx, the scores, `keep` (whether the row counts; others only carry the state) and `gain` (what
    position 1 of this row earns; null is 0). Of each series the restarts follow one another in one record:
    `moved` counts changes of position across them too; `dip` is the deepest fall of
    the summed profits. Rows of one series and restart at one t_idx are taken in any order. Null scores give
    position 0 and keep the state. Empty tables give an empty result.
    """
    columns = list(scores)
    pairs = [np.array(scores[c], float).reshape(-1, 2).T for c in columns]
    keys = [*series, restart]
    key_types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def block_task(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        owned = table.column("_keep").to_numpy().astype(bool)
        earned = table.column("_gain").to_numpy().astype(float)
        maps, sums = [], {k: [] for k in PARTS}
        for c, (enter, leave) in zip(columns, pairs, strict=True):
            z = table.column(c).to_numpy().astype(float)
            states = composed(step_maps(z, enter, leave))
            maps.append(states[-1].astype(np.int32).ravel())
            for k, v in _stretch(states, np.isnan(z), owned, earned).items():
                sums[k].append(v.ravel())
        out = {k: pa.array([v.as_py()], table.schema.field(k).type) for k, v in zip([*keys, "_block"], key, strict=True)}
        out["_maps"] = pa.array([np.concatenate(maps)], pa.list_(pa.int32()))
        return pa.table(out | {f"_{k}": pa.array([np.concatenate(sums[k])], pa.list_(pa.float64())) for k in PARTS})

    # rows of a block lie together in time; a series of any length is dealt out by blocks
    dealt = rows.select(*keys, order, F.floor(F.col(order) / block).cast("long").alias("_block"), F.coalesce(F.col(keep), F.lit(False)).alias("_keep"), F.coalesce(F.col(gain).cast("double"), F.lit(0.0)).alias("_gain"), *[F.col(c).cast("double").alias(c) for c in columns])
    fields = ", ".join(f"_{k} array<double>" for k in PARTS)
    blocks = dealt.groupBy(*keys, "_block").applyInArrow(block_task, f"{key_types}, _block long, _maps array<int>, {fields}")

    def series_task(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """A row a block: their number is that of the calendar over `block`."""
        table = table.sort_by([(restart, "ascending"), ("_block", "ascending")])
        total = sum(len(p[0]) for p in pairs)
        at, found, last = np.arange(total), None, None
        for i in range(len(table)):
            r = table.column(restart)[i].as_py()
            if i == 0 or r != last:
                state, last = np.zeros(total, np.int64), r
            own = {k: table.column(f"_{k}")[i].values.to_numpy().reshape(total, 3)[at, state] for k in PARTS}
            state = table.column("_maps")[i].values.to_numpy().reshape(total, 3)[at, state].astype(np.int64)
            found = own if found is None else merged(found, own)
        out = {k: pa.array([v.as_py()] * total, table.schema.field(k).type) for k, v in zip(series, key, strict=True)}
        out["score"] = pa.array([c for c, p in zip(columns, pairs, strict=True) for _ in p[0]])
        out["enter"], out["leave"] = (pa.array(np.concatenate([p[i] for p in pairs])) for i in (0, 1))
        return pa.table(out | {k: pa.array(found[k].astype(np.int64)) if k in ("n", "on", "moved") else pa.array(found[k]) for k in ("n", "total", "square", "on", "moved", "dip")})

    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in series)
    return blocks.groupBy(*series).applyInArrow(series_task, f"{types}, score string, enter double, leave double, n long, total double, square double, on long, moved long, dip double")


def metrics(swept: DataFrame, periods: float = 252) -> DataFrame:
    """`sweep`'s keys with sharpe, calmar, on_share, n and trades; sharpe and calmar are null for profits that
    never change, calmar where nothing was lost."""
    n, mean = F.col("n"), F.col("total") / F.col("n")
    variance = (F.col("square") - F.col("total") * mean) / (n - 1)
    moves = F.when((n > 1) & (variance > 1e-18), True).otherwise(False)
    yearly, fall = F.expm1(F.col("total") / (n / periods)), F.expm1("dip")
    keys = [c for c in swept.columns if c not in ("total", "square", "on", "moved", "dip", "n")]
    return swept.select(*keys, "n", F.when(moves, mean / F.sqrt(variance) * periods**0.5).alias("sharpe"), F.when(moves & (fall < -1e-6), yearly / F.abs(fall)).alias("calmar"), (F.col("on") / n).alias("on_share"), F.col("moved").alias("trades"))
