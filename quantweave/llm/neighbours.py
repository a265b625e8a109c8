"""Nearest vectors by stable projections, a kd-tree and a chi-square stopping test.

Unit vectors are projected on a few Gaussian directions. The squared distance of
two projections over the squared distance of the vectors has a chi-square
distribution with as many degrees as there are directions, whatever the data. A
query walks the kd-tree of the projections leaf by leaf in order of distance and
verifies what it meets by the exact cosine; it may stop as soon as a vector
nearer than its k-th best would, by that distribution, almost surely have been
met already.

Equal vectors are one point: of each only as many smallest ids are kept as a
query can need. Points are dealt by the leaves of a kd-tree over a bounded
sample, a crowded leaf in parts by a hash. A query first asks the leaf that it
lies in, then, in rounds, ever more of the next nearest leaves, until the
stopping test holds for all that is left. Within a leaf's part a smaller
kd-tree leads the way.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import saved

DIRECTIONS = 8
LEAF = 256
#: Chance that a nearer vector is still out when a query stops.
MISS = 0.02
#: Points and queries of a task, and points that a leaf of the dealing tree should hold.
POINTS, QUERIES, CELL = 20_000, 2_000, 4_096
#: Vectors that the dealing tree is fitted on (about), and its most leaves; every vector is dealt by it.
SAMPLE, CELLS = 1 << 16, 1 << 12
#: Each round asks so many times more leaves than the one before.
WIDEN = 8


def chi_square_quantile(p: float, degrees: int) -> float:
    """x with P(chi-square with an even number of degrees <= x) = p."""
    half = degrees // 2
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(half))
        low, high = (x, high) if 1 - tail < p else (low, x)
    return (low + high) / 2


def directions(size: int, many: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, many))


class KdTree:
    """Leaves of a kd-tree: the order of the points, bounds of leaves in it, and their boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        cuts, stack = [], [(0, len(points))]
        while stack:
            a, b = stack.pop()
            if b - a <= leaf:
                cuts.append((a, b))
                continue
            some = points[self.order[a:b]]
            axis = int(np.argmax(np.ptp(some, axis=0)))
            half = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(some[:, axis], half)]
            stack += [(a + half, b), (a, a + half)]
        self.cuts = sorted(cuts)
        own = points[self.order]
        self.low = np.array([own[a:b].min(0) for a, b in self.cuts])
        self.high = np.array([own[a:b].max(0) for a, b in self.cuts])

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """Squared distances of all queries from all leaves' boxes."""
        out = np.zeros((len(queries), len(self.cuts)))
        for j in range(queries.shape[1]):
            x = queries[:, j : j + 1]
            gap = np.maximum(np.maximum(self.low[:, j] - x, x - self.high[:, j]), 0)
            out += gap * gap
        return out


class Cells:
    """Leaves that split the whole space at the planes of a kd-tree over a sample."""

    def __init__(self, points: np.ndarray, cells: int):
        size = points.shape[1]
        boxes = [(np.full(size, -np.inf), np.full(size, np.inf), np.arange(len(points)))]
        while len(boxes) < cells:
            at = max(range(len(boxes)), key=lambda i: len(boxes[i][2]))
            low, high, own = boxes[at]
            some = points[own]
            axis = int(np.argmax(np.ptp(some, axis=0))) if len(own) else 0
            cut = float(np.median(some[:, axis])) if len(own) else 0.0
            left = some[:, axis] < cut if len(own) else np.zeros(0, bool)
            if not left.any():
                break  # all that is left lies in one place
            below, above = high.copy(), low.copy()
            below[axis] = above[axis] = cut
            boxes[at : at + 1] = [(low, below, own[left]), (above, high, own[~left])]
        self.low, self.high = (np.array([b[i] for b in boxes]) for i in (0, 1))

    def gaps(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros((len(points), len(self.low)))
        for j in range(points.shape[1]):
            x = points[:, j : j + 1]
            gap = np.maximum(np.maximum(self.low[:, j] - x, x - self.high[:, j]), 0)
            out += gap * gap
        return out

    def of(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point; on a plane the upper one."""
        out = np.zeros(len(points), np.int64)
        for a in range(0, len(points), 256):
            x = points[a : a + 256, None, :]
            out[a : a + 256] = ((x >= self.low) & (x < self.high)).all(2).argmax(1)
        return out


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: exact, and no norm overflows."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def projected(v: np.ndarray, many: int = DIRECTIONS) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1)[:, None] @ directions(v.shape[1], many)


def search(points: np.ndarray, queries: np.ndarray, k: int, miss: float = MISS, many: int = DIRECTIONS, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions of queries, of points, best): all verified pairs not farther than the
    query's k-th best, ties included, and each query's k least squared distances of unit
    vectors, those of `known` among them. Rows are finite and not zero."""
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    asked = queries / np.linalg.norm(queries, axis=1)[:, None]
    lines = directions(points.shape[1], many)
    tree = KdTree(unit @ lines)
    unit, place = unit[tree.order], tree.order
    stop = chi_square_quantile(1 - miss, many)
    gaps = tree.distances(asked @ lines)
    way = np.argsort(gaps, axis=1, kind="stable")
    best = np.full((len(queries), k), 4.0) if known is None else known.copy()
    found = []
    # leaf by leaf in the order of each query; the projected distance of anything
    # nearer than its k-th best lies below `stop` times that with probability 1 - miss
    active = np.arange(len(queries))
    for turn in range(way.shape[1]):
        leaf = way[active, turn]
        go = gaps[active, leaf] <= stop * best[active, -1]
        active, leaf = active[go], leaf[go]
        if not len(active):
            break
        order = np.argsort(leaf, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
            a, b = tree.cuts[leaf[own[0]]]
            q = active[own]
            far = np.maximum(2 - 2 * (asked[q] @ unit[a:b].T), 0)
            both = np.concatenate([best[q], far], axis=1)
            best[q] = np.sort(np.partition(both, k - 1, axis=1)[:, :k], axis=1)
            i, j = np.nonzero(far <= best[q, -1:] + 1e-9)
            found.append((q[i], place[a + j], far[i, j]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, best
    q, p, far = (np.concatenate(x) for x in zip(*found, strict=True))
    near = far <= best[q, -1] + 1e-9
    return q[near], p[near], best


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of both, each computed alone."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def nearest(vectors: DataFrame, is_query, k: int = 5, miss: float = MISS, points: int = POINTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors of every query found.

    `is_query` is a condition on vec_id; candidates are all rows but the query's
    own. The score is the cosine of the original vectors in double precision,
    ties go to smaller vec_ids; with fewer than k candidates all are returned.
    Null, empty and zero vectors and such with null or non-finite components
    take no part, nor do rows without an id; vectors are compared with those of
    their own length. Rows equal in id and vector count once; a query's own rows
    are known by its id, and queries that share an id get one list. Other
    columns are not read.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    rows = rows.withColumn("same", F.xxhash64(F.transform("v", lambda x: x + F.lit(0.0))))

    # the dealing tree of each length of vectors that the sample holds
    count = vectors.count()
    some = rows.where(F.pmod("same", F.lit(max(1, count // SAMPLE))) == 0).select("same", "v").dropDuplicates(["same"]).limit(4 * SAMPLE).mapInArrow(_projections, "size int, flat array<double>").toArrow()
    sizes, flat = some.column("size").to_numpy(), some.column("flat").combine_chunks().flatten().to_numpy().reshape(-1, DIRECTIONS)
    trees, first, cells = {}, {}, 0
    for size in np.unique(sizes):
        own = flat[sizes == size]
        trees[int(size)] = Cells(own, min(CELLS, len(own), max(1, round(len(own) / len(flat) * count / CELL))))
        first[int(size)], cells = cells, cells + len(trees[int(size)].low)

    def cell(size: int, flat: np.ndarray) -> np.ndarray:
        """Numbers of cells; a length that the sample lacks has one of 1,024 others."""
        return first[size] + trees[size].of(flat) if size in trees else np.full(len(flat), -1 - size % 1024)

    def deal(batches):
        for batch in batches:
            out = np.zeros(len(batch), np.int64)
            for at, size, grid in _grids(batch):
                out[at] = cell(size, projected(scaled(grid)))
            yield batch.append_column("cell", pa.array(out))

    # k + 1 smallest ids of equal vectors: a query can need no more. The rank is
    # cut before the rows are dealt, so many copies are no burden to one task
    ranked = rows.withColumn("nth", F.dense_rank().over(W.partitionBy("same").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    single = ranked.groupBy("same").agg(F.first("v").alias("v"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
    held = saved(single.mapInArrow(deal, "same long, v array<double>, ids array<long>, cell long"))
    # CELLS and 1,024 rows at most for each length
    parts = {r["cell"]: math.ceil(r["count"] / points) for r in held.groupBy("cell").count().collect()}
    asking = saved(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "same", "v").dropDuplicates(["query_id", "same"]))
    stop = chi_square_quantile(1 - miss, DIRECTIONS)
    spark = vectors.sparkSession

    def route(low: int, high: int):
        """Cells `low` to `high` in the order of distance that the stopping test still asks for."""

        def task(batches):
            for batch in batches:
                row, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                bound = np.array([x[-1] if x else 4.0 for x in batch.column("best").to_pylist()])
                for at, size, grid in _grids(batch):
                    if size not in trees:
                        if low == 0:
                            row.append(at)
                            to.append(np.full(len(at), -1 - size % 1024))
                        continue
                    for a in range(0, len(at), 256):
                        gaps = trees[size].gaps(projected(scaled(grid[a : a + 256])))
                        way = np.argsort(gaps, axis=1, kind="stable")[:, low:high]
                        i, j = np.nonzero(np.take_along_axis(gaps, way, 1) <= stop * bound[at[a : a + 256], None])
                        row.append(at[a + i])
                        to.append(first[size] + way[i, j])
                row, to = np.concatenate(row), np.concatenate(to)
                for a in range(0, len(row), 1 << 13):
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row[a : a + (1 << 13)])) for c in ("query_id", "same", "v", "best")), pa.array(to[a : a + (1 << 13)])], names=["query_id", "same", "v", "best", "cell"])

        return task

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "same": [], "best": [], "ids": [], "scores": []}
        for at, size, ask in _grids(right):
            own = [g for g in _grids(left) if g[1] == size]
            if not own:
                continue
            mine, p, q = own[0][0], scaled(own[0][2]), scaled(ask)
            known = np.array([x or [4.0] * (k + 1) for x in right.column("best").take(pa.array(at)).to_pylist()])
            which, point, best = search(p, q, k + 1, miss, known=known)
            score = np.concatenate([[0.0][:0], *(_cosines(q[which[a : a + 4096]], p[point[a : a + 4096]]) for a in range(0, len(which), 4096))])
            order = np.lexsort((-score, which))
            which, point, score = which[order], point[order], score[order]
            bounds = np.searchsorted(which, np.arange(len(at) + 1))
            ids = left.column("ids").take(pa.array(mine[point])).to_pylist()
            queries, same = right.column("query_id").to_pylist(), right.column("same").to_pylist()
            for i, row in enumerate(at.tolist()):
                a, b = bounds[i], bounds[i + 1]
                hits = sorted((-s, x) for s, own in zip(score[a:b].tolist(), ids[a:b], strict=True) for x in own if x != queries[row])[:k]
                out["query_id"].append(queries[row])
                out["same"].append(same[row])
                out["best"].append(best[i].tolist())
                out["ids"].append([x for _, x in hits])
                out["scores"].append([-s for s, _ in hits])
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
        return pa.table({n: pa.array(x, t) for (n, x), t in zip(out.items(), kinds, strict=True)})

    made, low, high = [], 0, 1
    state = asking.withColumn("best", F.array().cast("array<double>"))
    while True:
        asked = state.mapInArrow(route(low, high), "query_id long, same long, v array<double>, best array<double>, cell long")
        asked = saved(asked) if low else asked
        load = {r["cell"]: math.ceil(r["count"] / QUERIES) for r in asked.groupBy("cell").count().collect()}
        meets = [(c, parts[c], n) for c, n in load.items() if c in parts]
        if not meets:
            break
        sizes = F.broadcast(spark.createDataFrame(meets, "cell long, parts int, groups int"))
        # every part of a cell's points meets every group of its queries
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = held.join(sizes, "cell").select("cell", "v", "ids", F.pmod("same", F.col("parts")).cast("int").alias("part"), upto("groups").alias("group"))
        right = asked.join(sizes, "cell").select("cell", "query_id", "same", "v", "best", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int").alias("group"), upto("parts").alias("part"))
        keys = ("cell", "part", "group")
        made.append(saved(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, same long, best array<double>, ids array<long>, scores array<double>")))
        if high >= max((len(t.low) for t in trees.values()), default=0):
            break
        # what a part found holds what its query had known: the least of each place is enough
        nearer = made[-1].groupBy("query_id", "same").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k + 1).alias("best"))
        # equal distances of one point seen by several parts count once, of several points too: the bound only grows by it
        nearer = nearer.withColumn("best", F.when(F.size("best") > k, F.col("best")))
        state = asking.join(nearer, ["query_id", "same"], "left").withColumn("best", F.coalesce("best", F.array().cast("array<double>")))
        low, high = high, high + high * WIDEN
    hits = made[0] if made else spark.createDataFrame([], "query_id long, same long, best array<double>, ids array<long>, scores array<double>")
    for more in made[1:]:
        hits = hits.union(more)
    each = hits.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("h")).groupBy("query_id", F.col("h.ids").alias("vec_id")).agg(F.max("h.scores").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _grids(batch):
    """(places, length, matrix) of the rows of each length of v."""
    length = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
    for size in np.unique(length):
        at = np.flatnonzero(length == size)
        some = batch.column("v").take(pa.array(at))
        some = some.combine_chunks() if isinstance(some, pa.ChunkedArray) else some
        yield at, int(size), some.flatten().to_numpy().reshape(-1, size)


def _projections(batches):
    for batch in batches:
        for _, size, grid in _grids(batch):
            flat = projected(scaled(grid))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), size), pa.int32()), lists], names=["size", "flat"])
