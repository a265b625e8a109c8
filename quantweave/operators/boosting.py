"""Boosted trees for many classes, grown level by level from sums over binned features.

Rows never move. A pass over them leaves, from each task, sums of the softmax's gradients by tree, node, feature
and bin; one shuffle adds these up, and one row a node, its best cut, comes to the driver. What a task holds and
what is shuffled is bounded by trees x nodes x features x bins, whatever the rows. The trees of all classes, runs
and walk-forward starts grow in the same passes. Sums are whole numbers, so neither the layout of the rows nor the
order of the tasks changes a tree; only the bins' edges are quantiles, exact up to 10,000 rows and approximate
beyond. Each round's margins are written to the shared folder: a lost executor costs its running tasks.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quantweave.sources.stored import stored

SCALE = float(2**20)  # parts of a gradient's unit that sums count
_SAMPLE, _HELD = 1, 2


@dataclass(frozen=True)
class Boosted:
    """Trees as heaps (children of n: 2n + 1 and 2n + 2). Tree (start * runs + run) * classes + class of a round."""

    features: list[str]
    edges: list[np.ndarray]  # by feature; bin = number of edges below the value
    starts: list[int] | None
    runs: int
    classes: int
    base: np.ndarray  # (trees) margins before the first round
    feature: np.ndarray  # (rounds, trees, nodes), -1 for a leaf
    cut: np.ndarray  # bins up to it go left
    value: np.ndarray
    used: np.ndarray  # (starts * runs) rounds that count: those up to the least held-out loss
    losses: np.ndarray  # (rounds + 1, starts * runs) mean held-out loss after each round, nan without such rows


def _binned(edges: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Rows by features; a null or NaN is below every value."""
    out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.int64)
    for i, x in enumerate(columns):
        x = np.asarray(x, float)
        out[:, i] = np.where(np.isnan(x), 0, np.searchsorted(edges[i], x, side="left"))
    return out


def _leaves(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row after at most `depth` steps down one tree."""
    node, at = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        f = feature[node]
        right = bins[at, np.maximum(f, 0)] > cut[node]
        node = np.where(f >= 0, 2 * node + 1 + right, node)
    return node


def _chance(ids: np.ndarray, *parts: int) -> np.ndarray:
    """Numbers in [0, 1) from the rows' ids and the parts, the same on every machine."""
    x = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            x = x + np.uint64((p + 1) * 0x9E3779B97F4A7C15 % 2**64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(float) / 2.0**53


def _softmax(margins: np.ndarray) -> np.ndarray:
    """Over the last axis."""
    e = np.exp(margins - margins.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _matrix(column: pd.Series, width: int, kind) -> np.ndarray:
    return np.array(column.tolist(), kind).reshape(len(column), width)


def best_cuts(sums: DataFrame, bins: int, penalty: float, least: float) -> DataFrame:
    """(tree, node, feature, bin, gain, gl, hl, gr, hr): each node's best cut from sums (tree, node, feature, bin, g, h) in
    parts of a unit; ties to the smallest feature, then bin. A side needs a curvature of `least`; a gain is above 0."""
    of = W.partitionBy("tree", "node", "feature")
    run = sums.withColumns({"_l": F.sum("g").over(of.orderBy("bin")), "_m": F.sum("h").over(of.orderBy("bin")), "_g": F.sum("g").over(of), "_h": F.sum("h").over(of)})
    rows = run.select("tree", "node", "feature", "bin", *[(x / SCALE).alias(n) for n, x in (("gl", F.col("_l")), ("hl", F.col("_m")), ("gr", F.col("_g") - F.col("_l")), ("hr", F.col("_h") - F.col("_m")))])
    part = lambda g, h: F.col(g) * F.col(g) / (F.col(h) + penalty)
    whole = (F.col("gl") + F.col("gr")) * (F.col("gl") + F.col("gr")) / (F.col("hl") + F.col("hr") + penalty)
    rows = rows.withColumn("gain", part("gl", "hl") + part("gr", "hr") - whole)
    rows = rows.where((F.col("bin") < bins - 1) & (F.col("hl") >= least) & (F.col("hr") >= least) & (F.col("gain") > 1e-9))
    best = rows.groupBy("tree", "node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "gl", "hl", "gr", "hr")).alias("x"))
    return best.select("tree", "node", (-F.col("x.f")).alias("feature"), (-F.col("x.b")).alias("bin"), *[f"x.{c}" for c in ("gain", "gl", "hl", "gr", "hr")])


def fit(
    train: DataFrame,
    features: list[str],
    label: str = "cls",
    classes: int = 10,
    starts: list[int] | None = None,
    gap: int = 1,
    when: str = "t_idx",
    runs: int = 1,
    rounds: int = 100,
    depth: int = 6,
    bins: int = 64,
    rate: float = 0.1,
    penalty: float = 1.0,
    least: float = 1.0,
    sample: float = 0.8,
    columns: float = 0.8,
    held: float = 0.2,
    patience: int = 20,
    seed: int = 0,
    keys: tuple[str, ...] = ("t", "asset"),
) -> Boosted:
    """`runs` boosters of `classes` trees a round, for each start of a walk-forward from the rows with `when` < start - gap
    (all rows without `starts`).

    A run holds out the share `held` of its rows, drawn by a hash of `keys`, and counts its rounds up to the least loss
    there; the fit ends when no run has improved for `patience` rounds. Each round a run's trees see the share
    `sample` of its other rows, each tree the share `columns` of the features. Rows without a label in 0 to classes - 1
    are left out; without any row the trees are empty and the probabilities equal. Edges come from the rows of the
    first start, so nothing later than a start enters its trees. A row carries starts x runs x classes margins.
    """
    if not features or classes < 2 or bins < 2 or depth < 1 or (starts is not None and not starts):
        raise ValueError("boosting needs a feature, two classes, two bins, a level and, if given, a start")
    limits = None if starts is None else np.array([s - gap for s in starts])
    groups = 1 if starts is None else len(starts)
    models, width = groups * runs, len(features)
    trees, nodes = models * classes, 2 ** (depth + 1) - 1
    known = train.where(F.col(label).between(0, classes - 1))
    if starts is not None:
        known = known.where(F.col(when) < int(limits.max()))
    time = F.lit(0).cast("long") if starts is None else F.col(when).cast("long")
    rows = known.select(F.xxhash64(*keys).alias("id"), time.alias("at"), F.col(label).cast("int").alias("y"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])

    first = rows if starts is None else rows.where(F.col("at") < int(limits.min()))
    inner = [i / bins for i in range(1, bins)]
    cuts = first.agg(*[F.percentile_approx(F.when(~F.isnan(f"x{i}"), F.col(f"x{i}")), inner, 10000).alias(f"e{i}") for i in range(width)]).first()  # one row
    edges = [np.unique(np.array(e, float)) if e else np.zeros(0) for e in cuts]
    in_start = [F.lit(True)] if starts is None else [F.col("at") < int(x) for x in limits]
    tally = rows.agg(*[F.count_if(c & (F.col("y") == k)).alias(f"c{s}_{k}") for s, c in enumerate(in_start) for k in range(classes)]).first()  # one row
    prior = np.array(tally, float).reshape(groups, classes) + 1
    base = np.repeat(np.log(prior / prior.sum(axis=1, keepdims=True)), runs, axis=0).ravel()

    def roles(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows by models: whether a model knows the row, and whether it holds it out."""
        inside = np.ones((len(ids), models), bool) if limits is None else np.repeat(at[:, None] < limits[None, :], runs, axis=1)
        out = np.stack([_chance(ids, seed, m % runs, _HELD) < held for m in range(models)], axis=1)
        return inside & ~out, inside & out

    def losses(margins: np.ndarray, y: np.ndarray, out: np.ndarray) -> np.ndarray:
        p = _softmax(margins.reshape(len(y), models, classes))[np.arange(len(y)), :, y]
        return np.where(out, np.rint(-np.log(np.maximum(p, 1e-15)) * SCALE), 0).astype(np.int64)

    state = "id long, at long, y int, b array<smallint>, m array<double>, loss array<bigint>, out array<boolean>"

    def begin(batches):
        for df in batches:
            b = _binned(edges, [df[f"x{i}"].to_numpy(float, na_value=np.nan) for i in range(width)])
            m, y = np.tile(base, (len(df), 1)), df["y"].to_numpy()
            out = roles(df["id"].to_numpy(), df["at"].to_numpy())[1]
            yield pd.DataFrame({"id": df["id"], "at": df["at"], "y": df["y"], "b": list(b), "m": list(m), "loss": list(losses(m, y, out)), "out": list(out)})

    def totals(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        row = df.agg(*[F.coalesce(F.sum(F.col("loss")[m]), F.lit(0)) for m in range(models)], *[F.count_if(F.col("out")[m]) for m in range(models)]).first()  # one row
        return np.array(row[:models], float) / SCALE, np.array(row[models:], float)

    now = stored(rows.mapInPandas(begin, state))
    found = []
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def note() -> np.ndarray:
        loss, n = totals(now)
        found.append(np.where(n > 0, loss / np.maximum(n, 1), np.nan))
        return np.array(found)

    curve = note()
    for turn in range(rounds):
        feature, cut, value = np.full((trees, nodes), -1), np.zeros((trees, nodes), int), np.zeros((trees, nodes))
        draws = np.random.default_rng([seed, turn])
        allowed = draws.random((trees, width)).argsort(axis=1) < max(1, round(columns * width))
        for level in range(depth):
            low, count = 2**level - 1, 2**level
            if level and not (feature[:, (low - 1) // 2 : low] >= 0).any():
                break

            def histogram(batches, feature=feature, cut=cut, low=low, count=count, level=level, turn=turn, allowed=allowed):
                g, h = np.zeros((trees, count * width * bins)), np.zeros((trees, count * width * bins))
                for df in batches:
                    ids, y = df["id"].to_numpy(), df["y"].to_numpy()
                    b, m = _matrix(df["b"], width, np.int64), _matrix(df["m"], trees, float)
                    p = _softmax(m.reshape(-1, models, classes)).reshape(-1, trees)
                    mine = roles(ids, df["at"].to_numpy())[0]
                    for model in range(models):
                        take = mine[:, model] & (_chance(ids, seed, model % runs, _SAMPLE, turn) < sample)
                        bt, yt = b[take], y[take]
                        for k in range(classes):
                            tree = model * classes + k
                            node = _leaves(bt, feature[tree], cut[tree], level) - low
                            here = node >= 0
                            pt = p[take, tree][here]
                            place = ((node[here, None] * width + np.arange(width)) * bins + bt[here]).ravel()
                            for sums, x in ((g, pt - (yt[here] == k)), (h, pt * (1 - pt))):
                                sums[tree] += np.bincount(place, np.repeat(np.rint(x * SCALE), width), count * width * bins)
                tree, place = np.nonzero((g != 0) | (h != 0))
                f = place // bins % width
                some = allowed[tree, f]
                tree, place, f = tree[some], place[some], f[some]
                yield pd.DataFrame({"tree": tree, "node": place // (bins * width) + low, "feature": f, "bin": place % bins, "g": g[tree, place].astype(np.int64), "h": h[tree, place].astype(np.int64)})

            sums = now.select("id", "at", "y", "b", "m").mapInPandas(histogram, "tree int, node int, feature int, bin int, g long, h long")
            cuts = best_cuts(sums.groupBy("tree", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")), bins, penalty, least)
            for r in cuts.toLocalIterator():  # a row a node at most
                feature[r.tree, r.node], cut[r.tree, r.node] = r.feature, r.bin
                value[r.tree, 2 * r.node + 1] = -rate * r.gl / (r.hl + penalty)
                value[r.tree, 2 * r.node + 2] = -rate * r.gr / (r.hr + penalty)
        if not (feature >= 0).any():
            break

        def advance(batches, feature=feature, cut=cut, value=value):
            for df in batches:
                b, m = _matrix(df["b"], width, np.int64), _matrix(df["m"], trees, float)
                for tree in range(trees):
                    m[:, tree] += value[tree][_leaves(b, feature[tree], cut[tree], depth)]
                out = _matrix(df["out"], models, bool)
                yield df.assign(m=list(m), loss=list(losses(m, df["y"].to_numpy(), out)))

        now = stored(now.mapInPandas(advance, state))
        kept.append((feature, cut, value))
        curve = note()
        best = np.where(np.isnan(curve), 0, curve).argmin(axis=0)
        if not np.isnan(curve).all() and (len(kept) - best >= patience).all():
            break
    used = np.where(np.isnan(curve).all(axis=0), len(kept), np.where(np.isnan(curve), 0, curve).argmin(axis=0))
    stack = [np.array([x[i] for x in kept]).reshape(len(kept), trees, nodes) for i in range(3)]
    return Boosted(list(features), edges, starts, runs, classes, base, stack[0].astype(np.int32), stack[1].astype(np.int32), stack[2], used, curve)


def probabilities(model: Boosted, ask: DataFrame, keys: tuple[str, ...] = ("t", "asset"), when: str = "t_idx", every: int | None = None) -> DataFrame:
    """(keys, cls, p): mean over runs of the classes' probabilities. With starts, a row is asked of the latest start at
    or before its `when`, of rows up to `every` periods from it; earlier rows and those between have no result."""
    starts, runs, classes = model.starts, model.runs, model.classes
    depth = int(np.log2(model.feature.shape[2] + 1)) - 1 if model.feature.size else 0
    rows = ask.withColumn("_s", F.lit(0))
    if starts is not None:
        order = sorted(range(len(starts)), key=lambda i: starts[i])
        which = F.lit(None).cast("int")
        for i in order:
            near = F.col(when) < starts[i] + every if every else F.lit(True)
            which = F.when(F.col(when) >= starts[i], F.when(near, F.lit(i))).otherwise(which)
        rows = ask.withColumn("_s", which).where("_s IS NOT NULL")
    rows = rows.select(*keys, "_s", *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(model.features)])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)

    def task(batches):
        for df in batches:
            b = _binned(model.edges, [df[f"_x{i}"].to_numpy(float, na_value=np.nan) for i in range(len(model.features))])
            p = np.zeros((len(df), classes))
            for s in np.unique(df["_s"]):
                mine = (df["_s"] == s).to_numpy()
                for run in range(runs):
                    of = int(s) * runs + run
                    m = np.tile(model.base[of * classes : (of + 1) * classes], (mine.sum(), 1))
                    for turn in range(int(model.used[of])):
                        for k in range(classes):
                            tree = of * classes + k
                            m[:, k] += model.value[turn, tree][_leaves(b[mine], model.feature[turn, tree], model.cut[turn, tree], depth)]
                    p[mine] += _softmax(m) / runs
            yield df[list(keys)].assign(p=list(p))

    return rows.mapInPandas(task, f"{fields}, p array<double>").select(*keys, F.posexplode("p").alias("cls", "p"))
