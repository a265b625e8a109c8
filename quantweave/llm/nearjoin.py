"""Documents linked by the Jaccard similarity of their word n-grams.

1. A text becomes its set of shingle hashes; equal sets are one node. Tasks also
   count, in a table of fixed size, how many sets have a shingle.
2. Prefixes without loss. All shingles are put in one order, the rare first by
   those counts. Sets of n elements that reach the similarity t share one of
   their first n - ceil(t n) + 1 elements, whatever the order: so these are a
   set's keys, and passages that many texts share are rarely among them.
3. Up to `SMALL` nodes of a key are pairs to check, first by small bitmaps of
   the sets. In a crowd, more nodes with one key, a signature tree over the
   bitmaps joins those that may be similar into candidate groups; a crowd of
   more than `CROWD` nodes is a group as a whole.
4. Signature trees find the links inside each group; groups too large for one
   task are split into blocks by size, and pairs of blocks of near size are
   searched like groups.
5. Components of the links give each document its class.
"""

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .components import components
from .shared import saved
from .signature_tree import links, overlap, possible_links, similar
from .words import Words, mix, shingles, slices

SMALL, CROWD = 32, 1 << 14
PAIR, MEMBER, STAR = 0, 1, 2
#: Counters of shingles. A task reports those that stand out from its mean.
COUNTERS = 1 << 20
STANDS_OUT = 8
#: Shingles that one task's block holds, about.
BLOCK = 1 << 21
_SLOTS = 1 << 23
_U = np.uint64


def prefix_keys(elements: np.ndarray, rank: np.ndarray, least: Fraction) -> np.ndarray:
    """Keys of a set without repeats; `rank`: a class of commonness for each counter."""
    n = len(elements)
    many = n - -(-n * least.numerator // least.denominator) + 1
    order = rank[(elements >> _U(44)).astype(np.int64)].astype(np.uint64) << _U(56) | elements >> _U(8)
    return order if many >= n else np.partition(order, many - 1)[:many]


def shingle_sets(batches, k: int):
    """(slice of the batch, list of its rows' sorted distinct shingles)."""
    for batch in batches:
        for part in slices(batch):
            value, bounds = shingles(Words(part.column("text")), k)
            yield part, [np.unique(value[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _name(mixed: np.ndarray) -> int:
    """A set's node: a hash of its contents and size, as a signed number."""
    return int(mix(np.array([mixed.sum(dtype=np.uint64) + _U(len(mixed))], np.uint64)).view(np.int64)[0])


def bitmap(elements: np.ndarray) -> bytes:
    """A bit for each element's hash, two to four times as many bits as elements."""
    bits = np.zeros(1 << max(6, (2 * len(elements) - 1).bit_length()), bool)
    bits[(elements & _U(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def overlap_bound(a: bytes, b: bytes, n: int, m: int) -> int:
    """No less than the common elements of sets of n and m elements with these bitmaps."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    count = lambda z: int(np.bitwise_count(z).sum())
    return count(x & y) + min(n - count(x), m - count(y))


def nodes_of(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, node, bits for every row; node and bits are null for a text
    without words. Further rows with n = -1 hold a task's counters in bits."""

    def row(doc_id, n, node, bits):
        return pa.RecordBatch.from_arrays([doc_id, pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bits, pa.binary())], names=["doc_id", "n", "node", "bits"])

    def task(batches):
        counts = np.zeros(COUNTERS, np.int64)
        for part, sets in shingle_sets(batches, k):
            node = [_name(mix(s)) if len(s) else None for s in sets]
            if sets:
                counts += np.bincount((np.concatenate(sets) >> _U(44)).astype(np.int64), minlength=COUNTERS)
            yield row(part.column("doc_id"), [len(s) for s in sets], node, [bitmap(s) if len(s) else None for s in sets])
        high = np.flatnonzero(counts >= STANDS_OUT + 4 * counts.mean())
        if len(high):
            yield row(pa.nulls(1, pa.int64()), [-1], [None], [np.stack([high, counts[high]]).tobytes()])

    return docs.mapInArrow(task, "doc_id long, n long, node long, bits binary")


def ranks(nodes: DataFrame) -> np.ndarray:
    """For each counter the binary logarithm of its sum over all tasks' reports."""

    def task(batches):
        for batch in batches:
            for x in batch.column("bits"):
                at, n = np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n)], names=["at", "n"])

    # COUNTERS rows at most
    got = nodes.where("n = -1").select("bits").mapInArrow(task, "at int, n long").groupBy("at").agg(F.floor(F.log2(F.sum("n"))).cast("byte").alias("rank")).toArrow()
    rank = np.zeros(COUNTERS, np.uint8)
    rank[got.column("at").to_numpy()] = got.column("rank").to_numpy()
    return rank


def agreements(docs: DataFrame, k: int, least: Fraction, rank: np.ndarray) -> DataFrame:
    """(a, b, kind) of nodes that share a key. PAIR: nodes to check; MEMBER: a key
    that more nodes have, and one of them; STAR: two nodes of a yet larger one."""
    held = docs.sparkSession.sparkContext.broadcast(rank)

    def keys(batches):
        rank = held.value
        for _, sets in shingle_sets(batches, k):
            found, node, seen = [], [], set()
            for s in sets:
                if len(s) and (name := _name(mix(s))) not in seen:
                    seen.add(name)
                    found.append(prefix_keys(s, rank, least))
                    node.append(np.full(len(found[-1]), name, np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(node))], names=["key", "node"])

    def runs(batches):
        """Sorted by key and node. The last run of a batch waits for the next; of
        a run beyond CROWD only the first node."""
        key, node, large = np.zeros(0, np.int64), np.zeros(0, np.int64), False

        def edges(key, node, large):
            new = np.concatenate([[True], (key[1:] != key[:-1])])
            keep = new | np.concatenate([[True], node[1:] != node[:-1]])
            key, node, new = key[keep], node[keep], new[keep]
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(key)))
            kind = np.where(count > CROWD, STAR, np.where(count > SMALL, MEMBER, PAIR))
            if large:
                kind[0] = STAR
            head, of = np.repeat(node[first], count), np.repeat(kind, count)
            star, member = (of == STAR) & ~new, of == MEMBER
            a, b = [head[star], key[member]], [node[star], node[member]]
            for i in np.flatnonzero((kind == PAIR) & (count > 1)):
                x, y = np.triu_indices(count[i], 1)
                a.append(node[first[i] + x])
                b.append(node[first[i] + y])
            many = [len(a[0]), len(a[1]), sum(map(len, a[2:]))]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.repeat([STAR, MEMBER, PAIR], many), pa.int32())], names=["a", "b", "kind"])

        for batch in batches:
            if not len(batch):
                continue
            key = np.concatenate([key, batch.column("key").to_numpy()])
            node = np.concatenate([node, batch.column("node").to_numpy()])
            last = int(np.searchsorted(key == key[-1], True)) if key[0] != key[-1] else 0
            if last:
                yield edges(key[:last], node[:last], large)
                key, node, large = key[last:], node[last:], False
            if len(key) > CROWD:
                # the nodes are in order: an exact copy's rows are one
                keep = np.concatenate([[True], node[1:] != node[:-1]])
                key, node = key[keep], node[keep]
                if large or len(key) > CROWD:
                    large = True
                    yield edges(key, node, True)
                    key, node = key[:1], node[:1]
        if len(key):
            yield edges(key, node, large)

    dealt = docs.mapInArrow(keys, "key long, node long").repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(runs, "a long, b long, kind int")


def _crowd_links(crowds: DataFrame, least: Fraction) -> DataFrame:
    """Edges that join the nodes of each key (key, node, n, bits) that may be similar."""

    def fold(bits: bytes, words: int) -> np.ndarray:
        return np.bitwise_or.reduce(np.frombuffer(bits, np.uint64).reshape(-1, words), axis=0)

    def task(table: pa.Table) -> pa.Table:
        node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        bits = table.column("bits").to_pylist()
        words = np.array([len(x) // 8 for x in bits])
        a, b = [], []
        # similar sets have bitmaps of one size, or one has twice the other's
        for w in np.unique(words):
            own, twice = np.flatnonzero(words == w), np.flatnonzero(words == 2 * w)
            for some, side in ((own, None), (np.concatenate([own, twice]), np.repeat([0, 1], [len(own), len(twice)]))):
                if len(some) > 1 and (side is None or len(twice)):
                    maps = np.stack([fold(bits[i], int(w)) for i in some])
                    for x, y in possible_links(n[some], maps, least, side):
                        a.append(int(node[some[x]]))
                        b.append(int(node[some[y]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return crowds.groupBy("key").applyInArrow(task, "a long, b long")


def _wanted(nodes: DataFrame) -> DataFrame:
    """One row a node: n, its bitmap and the smallest doc_id that has it."""
    return nodes.where("node is not null").groupBy("node").agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id"), F.first("bits").alias("bits"))


def _sets(docs: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """(node, elements) of the chosen nodes' documents, and perhaps a few more.

    Texts of other documents are passed over by a bitmap of `_SLOTS` bits over
    hashed doc_ids, whose size does not depend on the data."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(_SLOTS))
    # Spark's bitmap functions count values from 1
    bits = chosen.select((slot + 1).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    flags = np.zeros(_SLOTS // 8 + 8192, np.uint8)
    for part, some in bits.collect():
        at = (part - 1) * 4096
        flags[at : at + len(some)] = np.frombuffer(bytes(some), np.uint8)
    flags = docs.sparkSession.sparkContext.broadcast(flags)

    def task(batches):
        mask = flags.value
        for batch in batches:
            at = batch.column("slot").to_numpy()
            some = batch.filter(pa.array(mask[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1))
            for _, sets in shingle_sets([some], k):
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_name(mix(s)) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "elements"])

    return docs.select("text", slot.cast("long").alias("slot")).mapInArrow(task, "node long, elements binary")


def _group_links(groups: DataFrame, least: Fraction) -> DataFrame:
    """Links in groups (g, label, side, node, elements); rows of one label are searched together."""

    def task(table: pa.Table) -> pa.Table:
        label, side, node = (table.column(c).to_numpy() for c in ("label", "side", "node"))
        elements = table.column("elements").combine_chunks()
        a, b = [], []
        order = np.lexsort((node, label))
        cuts = np.flatnonzero(np.diff(label[order])) + 1
        for run in np.split(order, cuts):
            run = run[np.concatenate([[True], np.diff(node[run]) != 0])]  # equal documents
            if len(run) < 2:
                continue
            sets = [np.frombuffer(elements[int(i)].as_buffer(), np.uint64) for i in run]
            sides = side[run]
            for x, y in links(sets, least, sides if sides.any() and not sides.all() else None):
                a.append(int(node[run[x]]))
                b.append(int(node[run[y]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return groups.groupBy("g").applyInArrow(task, "a long, b long")


def _deal(members: DataFrame, least: Fraction, block: int) -> DataFrame:
    """(node, label, side, g): the groups in which a member is searched.

    A candidate group of up to `block` shingles is searched in one task, with
    others of a hashed bin. A larger one is cut into blocks by fine bands of
    set size and a hash; every pair of blocks whose sizes may be similar has a
    task, and so has every block.
    """
    total = members.groupBy("label").agg(F.sum("n").alias("total"), F.count("*").alias("m")).where("m > 1")
    known = saved(members.join(total, "label"))
    bins = max(1, int((known.agg(F.sum("n")).first()[0] or 0) // block))
    small = known.where(F.col("total") <= block).select("node", "label", F.lit(0).alias("side"), F.concat(F.lit("bin "), F.pmod(F.xxhash64("label"), F.lit(bins))).alias("g"))
    fine = float(np.log(1 / float(least)) / 4)
    large = known.where(F.col("total") > block).withColumn("band", F.floor(F.log("n") / fine).cast("int"))
    # neighbouring bands share a block as long as they fit; a band too large for one has several
    bands = large.groupBy("label", "band").agg(F.sum("n").alias("size"))
    before = F.sum("size").over(W.partitionBy("label").orderBy("band").rowsBetween(W.unboundedPreceding, -1))
    bands = bands.withColumns({"block": F.floor(F.coalesce(before, F.lit(0)) / block).cast("int"), "salts": F.ceil(F.col("size") / block).cast("int")}).drop("size")
    placed = large.join(bands, ["label", "band"]).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    blocks = bands.groupBy("label", "block").agg(F.min("band").alias("low"), F.max("band").alias("high"), F.max("salts").alias("salts")).select("label", "block", "low", "high", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    other = blocks.select("label", F.col("block").alias("block2"), F.col("low").alias("low2"), F.col("salt").alias("salt2"))
    # similar sizes lie 4 fine bands apart at most, and one more for rounding
    near = blocks.join(other, "label").where("(block2 > block and low2 <= high + 5) or (block2 = block and salt2 >= salt)")
    name = F.concat_ws(" ", F.lit("blocks"), "label", "block", "salt", "block2", "salt2").alias("g")
    same = (F.col("block") == F.col("block2")) & (F.col("salt") == F.col("salt2"))
    ends = F.array(F.struct("block", "salt", F.lit(0).alias("side")), F.struct(F.col("block2").alias("block"), F.col("salt2").alias("salt"), F.when(same, 0).otherwise(1).alias("side")))
    both = near.select("label", name, F.explode(F.array_distinct(ends)).alias("x"))
    dealt = placed.join(both.select("label", "g", "x.*"), ["label", "block", "salt"]).select("node", "label", "side", "g")
    return small.union(dealt)


#: Rows of one key from which they are not shuffled together, and the most keys that can have
#: so many: with more rows than HOT * HOTS the bound on rows grows instead.
HOT, HOTS = 1 << 10, 1 << 20


def link_components(docs: DataFrame, k: int = 4, least: Fraction = Fraction(85, 100), block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`.

    Words are runs of other than ASCII white space, A-Z lower-cased; a text of
    1 to k-1 words has its whole sequence as its one shingle. Documents link
    when the Jaccard similarity of their sets is `least` or more, and
    component_id is the smallest doc_id reachable by links. Null, empty and
    blank texts link with nothing and are their own component. Rows that share
    a doc_id or a text are kept, each with its row; a null doc_id takes part
    and has a null id unless linked. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = saved(nodes_of(rows, k))
    nodes = made.where("n >= 0")
    edges = saved(agreements(rows, k, least, ranks(made)))
    one = saved(_wanted(nodes))
    crowds = edges.where(F.col("kind") == MEMBER).select(F.col("a").alias("key"), F.col("b").alias("node")).join(one.select("node", "n", "bits"), "node")
    # edges are stored before the components: so no task holds two Python workers
    label = saved(components(saved(edges.where(F.col("kind") == STAR).select("a", "b").union(_crowd_links(crowds, least)))))
    named = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}"))
    check = edges.where(F.col("kind") == PAIR).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(named("a"), "a", "left").join(named("b"), "b", "left")
    check = check.where("of_a is null or of_b is null or of_a <> of_b").select("a", "b")
    part = lambda c, of: one.select(F.col("node").alias(c), F.col(of).alias(f"{of}_{c}"))
    # sizes first: they leave few pairs that need the bitmaps
    check = check.join(part("a", "n"), "a").join(part("b", "n"), "b").where(similar(F.least("n_a", "n_b"), F.col("n_a"), F.col("n_b"), least))

    def possible(batches):
        for batch in batches:
            keep = [bool(similar(overlap_bound(x, y, n, m), n, m, least)) for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    check = saved(check.join(part("a", "bits"), "a").join(part("b", "bits"), "b").mapInArrow(possible, "a long, b long"))
    members = label.join(one.select("node", "n"), "node")
    dealt = saved(_deal(members, least, block))
    found = _group_links(dealt.join(_sets(rows, one.join(dealt, "node", "left_semi"), k).groupBy("node").agg(F.first("elements").alias("elements")), "node"), least)
    ends = check.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = saved(_sets(rows, one.join(ends, "node", "left_semi"), k).join(ends, "node", "left_semi").groupBy("node").agg(F.first("elements").alias("elements")))

    def verify(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = []
            for i in range(len(batch)):
                s, t = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                keep.append(bool(similar(min(len(s), len(t)), len(s), len(t), least)) and bool(similar(overlap(s, t), len(s), len(t), least)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = check.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")
    final = saved(components(saved(found.union(pairs.mapInArrow(verify, "a long, b long")))))
    # a class: the label of linked nodes, else the node itself, else the document
    many = max(HOT, made.count() // HOTS)
    texts = saved(nodes.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).join(final, "node", "left"))
    first = saved(texts.where("label is not null").groupBy("label").agg(F.min("least").alias("first"), F.count("*").alias("nodes")))
    linked = _joined(texts.where("label is not null"), first, "label", F.col("nodes") > many).select("node", "copies", "first")
    alone = texts.where("label is null").select("node", "copies", F.col("least").alias("first"))
    known = saved(linked.union(alone))
    out = _joined(nodes.select("doc_id", "n", "node"), known, "node", F.col("copies") > many)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))


def _joined(rows: DataFrame, values: DataFrame, key: str, crowded) -> DataFrame:
    """`rows` left-joined with `values` (one row a key): crowded keys, HOTS at most, by
    broadcast, so that no task holds all rows of one, all others by a shuffle."""
    hot = values.where(crowded)
    few = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(values.where(~crowded), key, "left")
    return rows.join(F.broadcast(hot), key).unionByName(few)
