"""Concatenate and cut: all documents' ids in a row, cut every `length` ids.

First pass: each partition encodes its documents and stores them with the ids
before each within the partition. Its token totals, one number a partition,
give global offsets by a prefix sum. Second pass: every document's stretch of
the row is cut where a multiple of `length` falls into it.
"""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ids import encoded
from .shared import saved

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id, ids (little-endian, two bytes each where the vocabulary allows),
    n, part, before (ids of the partition before this document); stored."""

    def task(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch, ids, bounds in encoded(batches, path, end):
            width = ids.dtype.itemsize
            n = np.diff(bounds)
            blob = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((bounds * width).astype(np.int64)), pa.py_buffer(ids.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), blob, pa.array(n, pa.int64()), pa.array(np.full(len(n), part), pa.int32()), pa.array(before + bounds[:-1], pa.int64()), pa.array(np.full(len(n), width), pa.int32())],
                names=["doc_id", "ids", "n", "part", "before", "width"],
            )
            before += int(bounds[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return saved(rows.mapInArrow(task, "doc_id long, ids binary, n long, part int, before long, width int"))


def pack(docs: DataFrame, length: int = 2048, path: str | None = None, end: int = 1) -> DataFrame:
    """One row per piece of a document in a sequence of `length` ids.

    Null and empty texts are the end id alone. Every id lies in one piece, all
    sequences but the last are full, and pieces follow without gaps. Repeated
    rows are packed as often as they come; a null doc_id stays null. Columns
    other than doc_id and text are not read. An empty table has no pieces.
    """
    stored = encode(docs, path or tokenizer_path(), end)
    # one row a partition, not a document
    totals = sorted((r.part, r.n) for r in stored.groupBy("part").agg(F.sum("n").alias("n")).collect())
    parts = np.array([p for p, _ in totals], np.int64)
    sums = np.array([n for _, n in totals], np.int64)
    base = docs.sparkSession.sparkContext.broadcast((parts, np.cumsum(sums) - sums))

    def task(batches):
        parts, bases = base.value
        for batch in batches:
            out = [[] for _ in range(7)]
            n = batch.column("n").to_numpy()
            first = bases[np.searchsorted(parts, batch.column("part").to_numpy())] + batch.column("before").to_numpy()
            for doc, ids, width, many, at in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("width").to_pylist(), n.tolist(), first.tolist(), strict=True):
                data = memoryview(np.frombuffer(ids.as_buffer(), f"<u{width}").astype("<u4").tobytes())
                done = 0
                while done < many:
                    sequence, offset = divmod(at + done, length)
                    take = min(many - done, length - offset)
                    for column, value in zip(out, (doc, done, take, zlib.crc32(data[done * 4 : (done + take) * 4]), many, sequence, offset), strict=True):
                        column.append(value)
                    done += take
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return stored.select("doc_id", "ids", "n", "part", "before", "width").mapInArrow(task, PIECES)
