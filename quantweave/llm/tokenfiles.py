"""Token ids as raw binary shards with a minimal perfect hash index by document.

A corpus is a folder that all executors share:

    ids-00012.bin    ids of a range of documents in ascending doc_id order,
                     little-endian, two or four bytes each, nothing else
    index-00003.mph  an .npz archive: the hash's bit arrays, level by level, and
                     for each slot a fingerprint and a run of records
                     (shard, first id within it, number of ids)
    manifest.json    id width, end id, number of index files, ids by shard

A key's slot is the rank of its bit in the first level where it has one alone,
so a look-up costs a few probes whatever the corpus, and the fingerprint (32
bits of another hash) turns away keys that were never put in.
"""

import io
import json
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ids import encoded
from .packing import tokenizer_path
from .shared import saved, shared_dir
from .words import mix

#: Keys of an index file, about.
BUCKET = 1 << 16
_GAMMA, _LEVELS = 1.5, 40
_U = np.uint64
#: Bytes of payload of an output batch; one longer document goes alone.
PAYLOAD = 1 << 23
ENTRY = "doc_id long, shard int, at long, n long"


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)


def _put(uri: str, name: str, data: bytes) -> None:
    """Appears whole or not at all; a task that runs twice writes the same bytes twice."""
    store, root = _store(uri)
    store.create_dir(root, recursive=True)
    own = f"{root}/_{name}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 'driver'}"
    with store.open_output_stream(own) as out:
        out.write(data)
    store.move(own, f"{root}/{name}")


def _get(uri: str, name: str) -> bytes:
    store, root = _store(uri)
    with store.open_input_stream(f"{root}/{name}") as f:
        return f.read()


# --- minimal perfect hash -------------------------------------------------------------------


def _spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + _U(0x632BE59BD9B4E019 * (level + 1) % 2**64)) % _U(size)).astype(np.int64)


def build_hash(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Bits of each level for distinct 64-bit keys; keys left after all levels are listed."""
    sizes, bits, rest = [], [], keys
    while len(rest) and len(sizes) < _LEVELS:
        size = max(64, math.ceil(_GAMMA * len(rest) / 64) * 64)
        spot = _spot(rest, len(sizes), size)
        alone = np.bincount(spot, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        rest = rest[~alone[spot]]
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    return {"sizes": np.array(sizes, np.int64), "bits": np.packbits(flat), "rest": np.sort(rest)}


class Slots:
    """Slots 0 to n-1 of n keys; another key gets -1 or any slot."""

    def __init__(self, parts):
        self.sizes, self.rest = parts["sizes"], parts["rest"]
        total = int(self.sizes.sum())
        self.bits = np.unpackbits(parts["bits"], count=total).astype(bool)
        self.rank = np.cumsum(self.bits, dtype=np.int64) - 1

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = base + _spot(keys[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left, base = left[~hit], base + size
        if len(self.rest) and len(left):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            hit = self.rest[at] == keys[left]
            out[left[hit]] = (self.rank[-1] + 1 if len(self.rank) else 0) + at[hit]
        return out


def _keys(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bijection of the id, and a fingerprint that is another function of it."""
    x = ids.view(np.uint64)
    return mix(x ^ _U(0xA0761D6478BD642F)), (mix(x ^ _U(0xE7037ED1A0B428DB)) >> _U(32)).astype(np.uint32)


def _index(entries: pa.Table) -> dict[str, np.ndarray]:
    ids = _ids(entries)
    shard, at, n = (entries.column(c).to_numpy() for c in ("shard", "at", "n"))
    order = np.lexsort((at, shard, ids))
    ids, shard, at, n = ids[order], shard[order], at[order], n[order]
    unique, first, many = np.unique(ids, return_index=True, return_counts=True)
    keys, prints = _keys(unique)
    parts = build_hash(keys)
    slot = Slots(parts).of(keys)
    by_slot = np.argsort(slot)
    many = many[by_slot]
    runs = np.concatenate([[0], np.cumsum(many)])
    take = np.arange(runs[-1]) + np.repeat(first[by_slot] - runs[:-1], many)
    return parts | {"print": prints[by_slot], "runs": runs, "shard": shard[take], "at": at[take], "n": n[take]}


# --- writing --------------------------------------------------------------------------------


def _bucket(buckets: int) -> Column:
    """Rows without an id have an index file of their own, the last one."""
    return F.when(F.col("doc_id").isNull(), buckets).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).cast("int").alias("bucket")


def _ids(rows: pa.Table) -> np.ndarray:
    """Ids of an index file: of the one for rows without an id, all the same."""
    return pc.fill_null(rows.column("doc_id"), 0).to_numpy()


def write(docs: DataFrame, uri: str, path: str | None = None, end: int = 2) -> None:
    """Writes the corpus of `docs` below `uri`, a new folder.

    Null and empty texts are the end id alone. Documents that share a doc_id
    follow one another by a hash of their texts, and the index leads to all of
    them. Other columns are not read. An empty table gives a manifest without
    shards.
    """
    path = path or tokenizer_path()

    def shard(batches):
        task, at, width = TaskContext.get(), 0, 2
        store, root = _store(uri)
        store.create_dir(root, recursive=True)
        name = f"ids-{task.partitionId():05d}.bin"
        own = f"{root}/_{name}.{task.taskAttemptId()}"
        with store.open_output_stream(own) as out:
            for batch, ids, bounds in encoded(batches, path, end):
                width = ids.dtype.itemsize
                out.write(ids.tobytes())
                n = len(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.full(n, task.partitionId()), pa.int32()), pa.array(at + bounds[:-1], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(np.full(n, width), pa.int32())],
                    names=["doc_id", "shard", "at", "n", "width"],
                )
                at += int(bounds[-1])
        if at:
            store.move(own, f"{root}/{name}")
        else:
            store.delete_file(own)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows that share an id may fill several shards
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    entries = saved(ordered.mapInArrow(shard, ENTRY + ", width int"))
    # one row a shard
    totals = sorted(map(tuple, entries.groupBy("shard").agg(F.sum("n"), F.count("*"), F.max("width")).collect()))
    buckets = max(1, math.ceil(sum(t[2] for t in totals) / BUCKET))

    def index(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        data = io.BytesIO()
        np.savez(data, **_index(rows))
        _put(uri, f"index-{key[0].as_py():05d}.mph", data.getvalue())
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(rows)], pa.int64())})

    made = entries.select("doc_id", "shard", "at", "n", _bucket(buckets)).groupBy("bucket").applyInArrow(index, "bucket int, n long")
    files = sorted(r.bucket for r in made.select("bucket").collect())  # one number for about BUCKET documents
    _put(uri, "manifest.json", json.dumps({"width": max((t[3] for t in totals), default=2), "end": end, "buckets": buckets, "files": files, "shards": [[s, n] for s, n, *_ in totals]}).encode())


# --- reading --------------------------------------------------------------------------------


def lookup(keys: DataFrame, uri: str) -> DataFrame:
    """doc_id, shard, at, n, start for every document that has one of the keys (a
    `doc_id` column; repeated keys count once, unknown ones give nothing, null leads to
    the documents without an id)."""
    manifest = json.loads(_get(uri, "manifest.json"))
    shards = np.array([s for s, _ in manifest["shards"]], np.int64)
    sums = np.array([n for _, n in manifest["shards"]], np.int64)
    starts, files = np.cumsum(sums) - sums, set(manifest["files"])

    def find(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ids = _ids(rows)
        if key[0].as_py() not in files:
            which = np.zeros(0, np.int64)
            shard, at, n = (np.zeros(0, np.int64),) * 3
        else:  # an index file that is gone is an error, not an empty result
            parts = np.load(io.BytesIO(_get(uri, f"index-{key[0].as_py():05d}.mph")))
            hashed, prints = _keys(ids)
            slot = Slots(parts).of(hashed)
            runs, stored = parts["runs"], parts["print"]
            here = (slot >= 0) & (stored[np.maximum(slot, 0)] == prints)
            slot, which = slot[here], np.flatnonzero(here)
            many = runs[slot + 1] - runs[slot]
            ends = np.cumsum(many)
            take = np.arange(many.sum()) + np.repeat(runs[slot] - (ends - many), many)
            which = np.repeat(which, many)
            shard, at, n = parts["shard"][take], parts["at"][take], parts["n"][take]
        start = at + (starts[np.searchsorted(shards, shard)] if len(shard) else 0)
        return pa.table({"doc_id": rows.column("doc_id").take(pa.array(which)), "shard": pa.array(shard, pa.int32()), "at": pa.array(at, pa.int64()), "n": pa.array(n, pa.int64()), "start": pa.array(start, pa.int64())})

    rows = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return rows.select("doc_id", _bucket(manifest["buckets"])).groupBy("bucket").applyInArrow(find, ENTRY + ", start long")


def read(places: DataFrame, uri: str) -> DataFrame:
    """`lookup`'s rows with `ids`: each document's payload, as stored."""
    width = json.loads(_get(uri, "manifest.json"))["width"]

    def task(batches):
        store, root = _store(uri)
        opened, file = None, None
        for batch in batches:
            blobs, first, size = [], 0, 0

            def done(to):
                some = batch.slice(first, to - first)
                return pa.RecordBatch.from_arrays([*some.columns, pa.array(blobs, pa.binary()), pa.array([width] * len(blobs), pa.int32())], names=[*batch.schema.names, "ids", "width"])

            for i, (shard, at, n) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("at").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                if shard != opened:
                    if file:
                        file.close()
                    opened, file = shard, store.open_input_file(f"{root}/ids-{shard:05d}.bin")
                blobs.append(file.read_at(n * width, at * width))
                size += n * width
                if size >= PAYLOAD:
                    yield done(i + 1)
                    blobs, first, size = [], i + 1, 0
            if blobs:
                yield done(len(batch))
        if file:
            file.close()

    ordered = places.repartition("shard").sortWithinPartitions("shard", "at")
    return ordered.mapInArrow(task, ENTRY + ", start long, ids binary, width int")


def digests(corpus: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of `read`'s rows."""

    def task(batches):
        for batch in batches:
            sums = [zlib.crc32(np.frombuffer(x.as_buffer(), f"<u{w}").astype("<u4").tobytes()) for x, w in zip(batch.column("ids"), batch.column("width").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return corpus.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """Writes `docs` into the shared folder, looks every document up and digests what is read."""
    uri = shared_dir(spark)
    write(docs, uri)
    return digests(read(lookup(docs.select("doc_id"), uri), uri))
