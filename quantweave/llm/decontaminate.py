"""Passages of benchmark items in documents, by SimHash of item-sized windows.

1. Every word position of a text begins a window of each size, in words, that an
   item has. A window can only reach the similarity asked for if most of its
   shingles occur in items of its size; bitmaps of fixed size over those
   shingles leave the few windows of which this may hold.
2. A window's 128-bit SimHash and an item's are cut into 8 blocks. If they
   differ in `RADIUS` bits or fewer, some block differs in RADIUS // 8 or fewer:
   items are listed under all such neighbours of their blocks, windows look up
   their blocks, so no fingerprint within the radius is missed.
3. Candidates within the radius are verified by their exact weighted
   similarity: shingles count as often as they occur, the common counts over
   the joint ones.
"""

from fractions import Fraction
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved
from .words import Words, mix, shingles, slices

BITS, BLOCKS = 128, 8
WIDTH = BITS // BLOCKS
#: Vectors at the cosine of two equal-sized bags with similarity 0.8 differ in 19
#: bits on average, and in more than 31 once in three hundred times.
RADIUS = 31
FLAGS = 1 << 25
#: Words of a text whose windows are hashed at a time, and bytes of windows that are held.
STRETCH, FLUSH = 1 << 13, 1 << 22
_U = np.uint64
_NEIGHBOURS = np.array([sum(1 << i for i in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(WIDTH), r)], np.uint16)


def _sized(value: np.ndarray, size: int) -> np.ndarray:
    return mix(value ^ _U(size << 1))


def _flag(value: np.ndarray) -> np.ndarray:
    return (value >> _U(64 - 25)).astype(np.int64)


def _signs(value: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of a shingle's bits."""
    two = np.stack([mix(value ^ _U(0xA5A5)), mix(value ^ _U(0x5A5A5A))], axis=1)
    return np.unpackbits(two.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def _prints(value: np.ndarray, starts: np.ndarray, many: int) -> np.ndarray:
    """Fingerprints, 8 blocks each, of `many` shingles from each start on."""
    sums = np.zeros((len(value) + 1, BITS), np.int32)
    np.cumsum(_signs(value), axis=0, out=sums[1:])
    return np.packbits(sums[starts + many] > sums[starts], axis=1).view(np.uint16)


def _keys(size: int, blocks: np.ndarray) -> np.ndarray:
    """Keys of blocks (n, 8) or (n, 8, neighbours)."""
    shape = (1, BLOCKS) + (1,) * (blocks.ndim - 2)
    place = (_U(size) << _U(24)) + (np.arange(BLOCKS, dtype=np.uint64) << _U(16)).reshape(shape)
    return mix(blocks.astype(np.uint64) + place).view(np.int64)


def _items(benchmark: DataFrame, k: int) -> DataFrame:
    """item_id, size, print, grams of every item that has words; stored."""

    def task(batches):
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                value, bounds = shingles(words, k)
                rows = [i for i in range(len(part)) if bounds[i + 1] > bounds[i]]
                grams = [value[bounds[i] : bounds[i + 1]] for i in rows]
                size = np.diff(words.bounds)[rows]
                prints = [_prints(g, np.zeros(1, np.int64), len(g)).tobytes() for g in grams]
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id").take(pa.array(rows, pa.int64())), pa.array(size, pa.int32()), pa.array(prints, pa.binary()), pa.array([g.tobytes() for g in grams], pa.binary())], names=["item_id", "size", "print", "grams"]
                )

    return saved(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text")).mapInArrow(task, "item_id long, size int, print binary, grams binary"))


def bitmap(values: DataFrame) -> np.ndarray:
    """One bit for each `at` of the rows: 4 MB, whatever their number."""
    # Spark's bitmap functions count values from 1
    at = values.select((F.col("at") + 1).alias("at"))
    bits = at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    flags = np.zeros(FLAGS // 8, np.uint8)
    for part, some in bits.collect():
        flags[(part - 1) * 4096 : (part - 1) * 4096 + len(some)] = np.frombuffer(bytes(some), np.uint8)
    return flags


def _set(flags: np.ndarray, value: np.ndarray) -> np.ndarray:
    at = _flag(value)
    return flags[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def _windows(docs: DataFrame, items: DataFrame, k: int, least: Fraction) -> DataFrame:
    """doc_id, start, size (of items), content, print, grams: windows that may be similar; stored."""

    def flags(sized: bool):
        def task(batches):
            for batch in batches:
                at = [np.zeros(0, np.int64)]
                for size, grams in zip(batch.column("size").to_pylist(), batch.column("grams"), strict=True):
                    g = np.frombuffer(grams.as_buffer(), np.uint64)
                    at.append(_flag(_sized(g, size) if sized else g))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at))], names=["at"])

        return bitmap(items.select("size", "grams").mapInArrow(task, "at long"))

    sizes = sorted(r[0] for r in items.select("size").distinct().collect())
    held = docs.sparkSession.sparkContext.broadcast((flags(False), flags(True), sizes))

    def row_windows(value, hit, n, k, sizes, exact):
        """(start, size, shingles of a window) in a row of n words, `value` its shingles, `hit` those that items have."""
        for size in sizes:
            if (size < k or n < k) and size != n and k > size:
                continue
            many = max(size - k + 1, 1)
            need = ceil(least * many)
            width = min(many, len(value))
            if width < need:
                continue
            own = np.zeros(len(value), np.int64)
            own[hit] = _set(exact, _sized(value[hit], size))
            total = np.concatenate([[0], np.cumsum(own)])
            starts = np.flatnonzero(total[width:] - total[:-width] >= need)
            if len(starts):
                yield starts, size, width

    def task(batches):
        some, exact, sizes = held.value
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                n = np.diff(words.bounds)
                short = [s for s in sizes if s < k]
                # items of fewer than k words are runs of their own length
                for length, its in [(k, [s for s in sizes if s >= k])] + [(s, [s]) for s in short]:
                    value, bounds = shingles(words, length, k - length)  # hashed as the items' are
                    hit = _set(some, value)
                    count = np.concatenate([[0], np.cumsum(hit)])
                    per = count[bounds[1:]] - count[bounds[:-1]]
                    out, held_bytes = [], 0
                    for i in np.flatnonzero(per) if its else []:
                        if n[i] < length:
                            continue
                        v, h = value[bounds[i] : bounds[i + 1]], np.flatnonzero(hit[bounds[i] : bounds[i + 1]])
                        for starts, size, width in row_windows(v, h, n[i], length, its, exact):
                            if len(h) < ceil(least * width):
                                continue
                            # stretch by stretch, however long the text
                            for some_starts in np.split(starts, np.flatnonzero(np.diff(starts // STRETCH)) + 1):
                                lo = int(some_starts[0])
                                prints = _prints(v[lo : int(some_starts[-1]) + width], some_starts - lo, width)
                                for s, p in zip(some_starts.tolist(), prints, strict=True):
                                    grams = v[s : s + width]
                                    out.append((i, s, size, int(mix(np.sort(grams).cumsum(dtype=np.uint64)[-1:] ^ _U(size)).view(np.int64)[0]), p.tobytes(), grams.tobytes()))
                                    held_bytes += 8 * width
                                    if held_bytes > FLUSH:
                                        yield rows_of(part, out)
                                        out, held_bytes = [], 0
                    if out:
                        yield rows_of(part, out)

    def rows_of(part, out):
        row, start, size, content, prints, grams = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array(content, pa.int64()), pa.array(prints, pa.binary()), pa.array(grams, pa.binary())],
            names=["doc_id", "start", "size", "content", "print", "grams"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    return saved(rows.mapInArrow(task, "doc_id long, start long, size int, content long, print binary, grams binary"))


def _weighted(a: np.ndarray, b: np.ndarray) -> float:
    """Common over joint counts of two bags."""
    both, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x = np.bincount(place[: len(a)], minlength=len(both))
    y = np.bincount(place[len(a) :], minlength=len(both))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def matches(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, item_id, similarity, start, n_words: one row for every document and
    item of which the document holds a window of similarity `least` or more; the
    most similar window, the first of equals, from word `start` on.

    Words are runs of other than ASCII white space, lower-cased. A document
    shorter than an item is one window. Items of fewer than k words match their
    exact sequence; null, empty and blank items and texts match nothing. Rows
    that share a doc_id or an item_id count as one document or item. Other
    columns are not read.
    """
    items = _items(benchmark, k)
    windows = _windows(docs, items, k, least)

    def listed(near: bool):
        def task(batches):
            for batch in batches:
                for i, (size, p) in enumerate(zip(batch.column("size").to_pylist(), batch.column("print"), strict=True)):
                    blocks = np.frombuffer(p.as_buffer(), np.uint16)[None]
                    keys = np.unique(_keys(size, blocks[:, :, None] ^ _NEIGHBOURS[None, None] if near else blocks))
                    yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array([c[i].as_py()] * len(keys), c.type) for c in batch.columns)], names=["key", *batch.schema.names])

        return task

    # windows with the same contents are looked up and verified once
    distinct = windows.groupBy("content", "size").agg(F.first("print").alias("print"), F.first("grams").alias("grams"))
    looked = distinct.select("content", "size", "print").mapInArrow(listed(False), "key long, content long, size int, print binary")
    under = items.select("item_id", "size", F.col("print").alias("item_print")).mapInArrow(
        lambda b: listed(True)(x.rename_columns(["item_id", "size", "print"]) for x in b), "key long, item_id long, size int, item_print binary"
    )

    def near(batches):
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, 2) for c in ("print", "item_print"))
                yield batch.select(["content", "size", "item_id"]).filter(pa.array(np.bitwise_count(a ^ b).sum(1) <= RADIUS))

    # an item has thousands of keys: far more than Spark, which sees the items, would guess
    close = looked.join(under.withColumnRenamed("size", "item_size").hint("merge"), "key").where("size = item_size").select("content", "size", "item_id", "print", "item_print")
    close = close.mapInArrow(near, "content long, size int, item_id long").distinct()
    pairs = close.join(distinct.select("content", "size", "grams"), ["content", "size"]).join(items.select("item_id", "size", F.col("grams").alias("item_grams")), ["item_id", "size"])

    def verify(batches):
        for batch in batches:
            found = [_weighted(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)) for a, b in zip(batch.column("grams"), batch.column("item_grams"), strict=True)]
            kept = pa.array([x >= float(least) - 1e-12 for x in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.select(["content", "size", "item_id"]).columns, pa.array(found, pa.float64())], names=["content", "size", "item_id", "similarity"]).filter(kept)

    true = pairs.select("content", "size", "item_id", "grams", "item_grams").mapInArrow(verify, "content long, size int, item_id long, similarity double")
    best = windows.select("doc_id", "start", "content", "size").join(true, ["content", "size"])
    return best.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("similarity", "start", "size"), F.struct("similarity", -F.col("start"))).alias("b")).select("doc_id", "item_id", "b.similarity", "b.start", F.col("b.size").cast("long").alias("n_words"))
