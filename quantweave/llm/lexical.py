"""Ranked lexical search: the best documents of each query by an integer form of BM25.

The queries' terms are the vocabulary. One pass over the texts keeps, for each
document, how often it holds each of them, next to its own length; sums over that
table give every term's weight. A second pass reads the table block by block of
documents, turns each block into lists by term, and ranks it for every query:

* short lists are added up at once into one list of documents with summed scores
  (term at a time);
* that list, bounded by its greatest sum, and the long lists, each bounded by its
  greatest share of a score, are then walked together by document. Lists whose
  bounds together stay below the score to beat propose no documents; they are only
  looked up for what the others propose, and only while a document can still win.

The score to beat is kept from block to block within a task. Each task gives its
best documents of each query, and these are merged in two steps.
"""

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import saved
from .words import Words, slices

_U = np.uint64
#: Each byte, or a space for one that ends a term: ASCII but for digits and letters.
_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[[b for b in range(128) if not chr(b).isalnum()]] = 0x20
#: Queries of one pass over the documents: bounds what tasks get and hold of them.
QUERIES = 4096
#: Documents and postings of a block, and documents of a step of the walk.
BLOCK, POSTINGS, STEP = 1 << 13, 1 << 22, 1 << 10
#: A list is short if it holds at most one in so many of the block's documents.
SHORT = 32
#: Groups in which tasks' best documents are merged first.
_PARTS = 64
_NUMBERS = "doc_id long, n long, terms array<int>, counts array<int>"
_FOUND = "item int, item_id long, part int, doc_id long, score long"


def _terms(texts: pa.Array) -> Words:
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, bounds, data = texts.buffers()
    edges = np.frombuffer(bounds, np.int64, len(texts) + 1, texts.offset * 8)
    # a slice shares its batch's buffer: only its own bytes are looked at
    data = _SPACED[np.frombuffer(data, np.uint8)[edges[0] : edges[-1]]] if data is not None else np.zeros(0, np.uint8)
    return Words(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer((edges - edges[0]).tobytes()), pa.py_buffer(data.tobytes())]))


class Postings:
    """Documents by term in a block. `docs[at[t]:at[t + 1]]` are places, ascending, of the
    documents that hold term t, `gain` what it adds to each, `most` the greatest of these."""

    def __init__(self, size: int, terms: np.ndarray, docs: np.ndarray, gain: np.ndarray, vocabulary: int):
        order = np.lexsort((docs, terms))
        self.size, self.docs, self.gain = size, docs[order], gain[order]
        counts = np.bincount(terms, minlength=vocabulary)
        self.at = np.concatenate([[0], np.cumsum(counts)])
        self.most = np.zeros(vocabulary, np.int64)
        held = np.flatnonzero(counts)
        if len(held):
            self.most[held] = np.maximum.reduceat(self.gain, self.at[held])

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.at[term], self.at[term + 1]
        return self.docs[a:b], self.gain[a:b]


def _summed(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    docs, back = np.unique(np.concatenate([d for d, _ in lists]), return_inverse=True)
    sums = np.zeros(len(docs), np.int64)
    np.add.at(sums, back, np.concatenate([g for _, g in lists]))
    return docs, sums


class Best:
    """The k best that have been put: score, then smaller id, rows that lack an id last."""

    def __init__(self, k: int):
        self.k, self.ids, self.lacks, self.scores = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def beat(self) -> int:
        """A document below this score cannot be among the best."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def put(self, ids: np.ndarray, lacks: np.ndarray, scores: np.ndarray) -> None:
        ids, lacks, scores = (np.concatenate(x) for x in ((self.ids, ids), (self.lacks, lacks), (self.scores, scores)))
        order = np.lexsort((ids, lacks, -scores))[: self.k]
        self.ids, self.lacks, self.scores = ids[order], lacks[order], scores[order]


def rank(block: Postings, ids: np.ndarray, lacks: np.ndarray, query: np.ndarray, best: Best, short: int = SHORT, step: int = STEP) -> int:
    """Puts the block's best documents for a query (distinct terms) into `best`; `ids` and `lacks` are by place.
    Gives the number of documents whose score was completed."""
    lists = [(t, block.at[t + 1] - block.at[t]) for t in query.tolist()]
    long = [(int(block.most[t]), *block.of(t)) for t, n in lists if n * short > block.size]
    brief = [block.of(t) for t, n in lists if 0 < n * short <= block.size]
    if brief:
        docs, sums = _summed(brief)
        long.append((int(sums.max()), docs, sums))
    # least bound first; `reach[i]` is what the first i lists can give together
    long.sort(key=lambda x: x[0])
    reach = [0]
    for most, *_ in long:
        reach.append(reach[-1] + most)
    scored, start = 0, 0
    while start < block.size and reach[-1] >= best.beat:
        beat = best.beat
        lead = next(i for i in range(len(long)) if reach[i + 1] >= beat)  # lists before it propose nothing
        # the next documents that the leading lists propose: a stretch with about `step` of them
        ends = [d[a + step - 1] + 1 for _, d, _ in long[lead:] if (a := int(np.searchsorted(d, start))) + step <= len(d)]
        stop = int(min(ends, default=block.size))
        pieces = []
        for _, d, g in long[lead:]:
            a, b = np.searchsorted(d, (start, stop))
            if b > a:
                pieces.append((d[a:b], g[a:b]))
        start = stop
        if not pieces:
            continue
        docs, sums = _summed(pieces) if len(pieces) > 1 else pieces[0]
        for i in range(lead - 1, -1, -1):
            alive = sums + reach[i + 1] >= beat
            docs, sums = docs[alive], sums[alive].copy()
            if not len(docs):
                break
            _, d, g = long[i]
            at = np.minimum(np.searchsorted(d, docs), len(d) - 1)
            hit = d[at] == docs
            sums[hit] += g[at[hit]]
        scored += len(docs)
        won = sums >= beat
        if won.any():
            best.put(ids[docs[won]], lacks[docs[won]], sums[won])
    return scored


def gains(weights: np.ndarray, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What each posting adds to its document's score; sizes: terms in its document."""
    top = int(sizes.max(initial=0))
    if 90 * top * documents >= 2**63:
        size = np.array([100 - 90 + (90 * int(n) * documents) // length for n in sizes.tolist()], np.int64)
    else:
        size = 100 - 90 + (90 * sizes * documents) // length
    return weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * size))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows with at least one of the terms, in blocks."""
    held, rows, postings = [], 0, 0
    for batch in batches:
        sizes = np.diff(batch.column("terms").offsets.to_numpy())
        batch, sizes = batch.filter(pa.array(sizes > 0)), sizes[sizes > 0]
        ends, at = np.cumsum(sizes), 0
        while at < len(batch):
            base = ends[at - 1] if at else 0
            room = int(np.searchsorted(ends, base + POSTINGS - postings, "right")) - at
            take = max(min(len(batch) - at, BLOCK - rows, room), 0 if rows else 1)
            if take:
                held.append(batch.slice(at, take))
                rows, postings, at = rows + take, postings + int(ends[at + take - 1] - base), at + take
            if rows >= BLOCK or not take or postings >= POSTINGS:
                yield pa.Table.from_batches(held)
                held, rows, postings = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _count(known: np.ndarray):
    """A task that counts the known terms (hashes, ascending) in each text."""

    def task(batches):
        likely = np.zeros(1 << 20, bool)  # most words are turned away by one look
        likely[known & _U(len(likely) - 1)] = True
        for batch in batches:
            for part in slices(batch):
                words = _terms(part.column("text"))
                near = np.flatnonzero(likely[words.hash & _U(len(likely) - 1)])
                at = np.minimum(np.searchsorted(known, words.hash[near]), max(len(known) - 1, 0))
                hit = known[at] == words.hash[near] if len(known) else np.zeros(0, bool)
                pair, many = np.unique(words.row()[near[hit]] * max(len(known), 1) + at[hit], return_counts=True)
                row, term = np.divmod(pair, max(len(known), 1))
                bounds = pa.array(np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (term, many)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(words.bounds), pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return task


def _search(items: list[int | None], queries: list[np.ndarray], weights: np.ndarray, documents: int, length: int, k: int):
    """A task that gives its k best documents of each query."""

    def task(batches):
        found = [Best(k) for _ in queries]
        for table in _blocks(batches):
            table = table.combine_chunks().sort_by("doc_id")
            terms, counts = table.column("terms").combine_chunks(), table.column("counts").combine_chunks()
            term, many = terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64)
            place = np.repeat(np.arange(len(table)), np.diff(terms.offsets.to_numpy()))
            sizes = table.column("n").to_numpy()
            block = Postings(len(table), term, place, gains(weights, term, many, sizes[place], documents, length), len(weights))
            ids, lacks = pc.fill_null(table.column("doc_id"), 0).to_numpy(), pc.is_null(table.column("doc_id")).to_numpy()
            for query, best in zip(queries, found, strict=True):
                rank(block, ids, lacks, query, best)
        part = TaskContext.get().partitionId() % _PARTS
        for i, (item, best) in enumerate(zip(items, found, strict=True)):
            n = len(best.ids)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * n, pa.int32()), pa.array([item] * n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(best.ids, pa.int64(), mask=best.lacks), pa.array(best.scores, pa.int64())],
                    names=["item", "item_id", "part", "doc_id", "score"],
                )

    return task


def _one_pass(docs: DataFrame, queries: list[tuple[int | None, str | None]], k: int) -> DataFrame:
    """item_id, rank, doc_id, score of a block of queries."""
    words = _terms(pa.array([t for _, t in queries], pa.large_string()))
    known = np.unique(words.hash)
    terms = [np.unique(np.searchsorted(known, words.hash[a:b])) for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    numbers = saved(rows.mapInArrow(_count(known), _NUMBERS).where("n > 0"))
    documents, length = numbers.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = np.zeros(len(known), np.int64)
    for term, n in numbers.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term of the queries
        frequency[term] = n
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in frequency.tolist()], np.int64)
    held = numbers.where(F.size("terms") > 0)
    found = saved(held.mapInArrow(_search([i for i, _ in queries], terms, weights, documents, length, k), _FOUND))
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["item", "part"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= k)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each row of `queries`.

    `docs`: doc_id, text; `queries`: item_id, text; other columns are not read. Equal scores go by doc_id; rows
    that share an id are ranked each, rows without an id come last among equals. Null and empty texts have no
    terms: such documents do not count, such queries find nothing. Query rows that share an id are ranked each.
    Queries are taken in blocks of QUERIES rows, each of which reads the documents once; terms are told by
    64-bit hashes. Empty tables give an empty result.
    """
    rows = queries.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator()
    out = None
    while block := [tuple(r) for r in islice(rows, QUERIES)]:
        part = _one_pass(docs, block, k)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
