"""Toxicity by class-conditional Kneser-Ney models.

A word is read as a chain of ever longer prefixes: its first 3, 4, 5, 7 bytes
and itself. Both classes, toxic and ordinary, give each step of the chain the
absolutely discounted frequency of the longer after the shorter prefix, and
spread what the discount takes off by backoff counts that the classes share:
so inflected or new forms of an expression are judged by their stems. What both
classes together saw once is discounted whole: it counts as a form never seen.
Prefixes that one class lacks tell nothing beyond the step that led to them. A text is judged by its log-likelihood ratio over
its length, by the mean of its most telling words and by what clearly toxic
words exceed a margin, over the square root of the length: so a few toxic lines
in a long text show. A logistic curve fitted on labelled rows kept out of the
counts turns these into a probability.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved
from .words import Words, mix, slices

#: Labelled rows that a model is fitted on, at most: those of the least hashes.
SAMPLE = 20_000
#: Bytes of the prefixes of a word's chain.
CHAIN = (3, 4, 5, 7)
DISCOUNT = 0.75
#: Words that tell most; a clear word's ratio begins at MARGIN and counts up to MARGIN + CAP.
TOP, MARGIN, CAP = 3, 2.0, 4.0
_ROOT = np.uint64(0x7C0FFEE123456789)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(3) + mix(b))


def _chain(words: Words):
    """(words that take the step, shorter prefix, longer prefix) of each step."""
    shorter = np.full(len(words.hash), _ROOT)
    for k in (*CHAIN, None):
        longer = words.hash if k is None else words.prefix(k)
        at = np.flatnonzero(longer != shorter)
        yield at, shorter[at], longer[at]
        shorter = longer


def _count(labelled: DataFrame) -> DataFrame:
    """(u, w, n0, n1): how often prefix u goes on to w in ordinary and in toxic texts; stored."""

    def task(batches):
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), cut_tail=True)
                if not len(words.hash):
                    continue
                own = part.column("toxic").to_numpy()[words.row()]
                at, u, w = (np.concatenate(x) for x in zip(*_chain(words), strict=True))
                toxic = own[at]
                _, first, back = np.unique(_pair(u, w), return_index=True, return_inverse=True)
                n1 = np.bincount(back, weights=toxic, minlength=len(first)).astype(np.int64)
                n = np.bincount(back, minlength=len(first))
                yield pa.RecordBatch.from_arrays([pa.array(u[first].view(np.int64)), pa.array(w[first].view(np.int64)), pa.array(n - n1, pa.int64()), pa.array(n1, pa.int64())], names=["u", "w", "n0", "n1"])

    made = labelled.select("text", "toxic").mapInArrow(task, "u long, w long, n0 long, n1 long")
    return saved(made.groupBy("u", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


class _Table:
    """Rows of numbers by hash; zeros for what it lacks."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros((len(keys), self.values.shape[1]))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys)[:, None], self.values[at], 0.0)


@dataclass
class Model:
    contexts: _Table  # steps from it and different steps, of each class
    steps: _Table  # n0, n1
    curve: np.ndarray  # intercept, whole text, top words, excess

    def ratios(self, words: Words) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of every word."""
        out = np.zeros(len(words.hash))
        for at, u, w in _chain(words):
            con, two = self.contexts.of(u), self.steps.of(_pair(u, w))
            both = (con[:, 0] > 0) & (con[:, 1] > 0)  # else the step to u has told it
            shared = np.maximum(two.sum(1), 1.0) / np.maximum(con[:, 0] + con[:, 1], 1.0)
            logs = [np.log((np.maximum(two[:, c] - DISCOUNT, 0) + DISCOUNT * con[:, 2 + c] * shared) / np.maximum(con[:, c], 1) + 1e-300) for c in (0, 1)]
            out[at] += np.where(both, logs[1] - logs[0], 0.0)
        return out

    def features(self, words: Words) -> np.ndarray:
        """Of each row: mean ratio, mean of the TOP highest, excess; zeros for a row without words."""
        ratio, bounds = self.ratios(words), words.bounds
        sums = lambda x: (lambda t: t[bounds[1:]] - t[bounds[:-1]])(np.concatenate([[0.0], np.cumsum(x)]))
        n = np.diff(bounds)
        top = np.zeros(len(n))
        for i in np.flatnonzero(n):
            x = ratio[bounds[i] : bounds[i + 1]]
            top[i] = x.mean() if len(x) <= TOP else np.partition(x, len(x) - TOP)[-TOP:].mean()
        return np.column_stack([sums(ratio) / np.maximum(n, 1), top, sums(np.clip(ratio - MARGIN, 0, CAP)) / np.sqrt(n + 20)])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of an intercept and the columns, slightly drawn to 0, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + 1e-3 * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the texts of `docs` that `labels` (doc_id, toxic) marks; at most
    `sample` rows are used. One in five of them is kept for the curve."""
    one = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    # `sample` rows at most, whatever the table
    chosen = saved(one.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(sample))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).join(F.broadcast(chosen), "doc_id")
    side = F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(5))
    counts = _count(rows.where(side != 0))
    after = counts.groupBy("u").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count_if(F.expr("n0 > 0")).alias("k0"), F.count_if(F.expr("n1 > 0")).alias("k1"))

    def kept(df: DataFrame, by: list[str], values: list[str]) -> _Table:
        # the sample of labelled rows bounds them; no other cut
        got = df.select(*by, *values).toArrow()
        cols = [got.column(c).to_numpy().view(np.uint64) for c in by]
        return _Table(cols[0] if len(cols) == 1 else _pair(*cols), np.column_stack([got.column(c).to_numpy().astype(float) for c in values]))

    model = Model(kept(after.where("n0 > 0 and n1 > 0"), ["u"], ["n0", "n1", "k0", "k1"]), kept(counts.where("n0 + n1 > 1"), ["u", "w"], ["n0", "n1"]), np.zeros(4))
    # the curve's rows: a fifth of `sample` at most, three numbers each
    shown = features(rows.where(side == 0), model, ["toxic"]).toArrow()
    x = np.column_stack([shown.column(c).to_numpy() for c in ("whole", "top", "excess")]).reshape(-1, 3)
    y = shown.column("toxic").to_numpy().astype(float)
    model.curve = _logistic(x, y) if len(set(y.tolist())) == 2 else np.array([4.0 if y.any() else -4.0, 1.0, 1.0, 1.0])
    return model


def features(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep`, whole, top, excess and score of every row (text, ...)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def task(batches):
        model = held.value
        for batch in batches:
            for part in slices(batch):
                x = model.features(Words(part.column("text"), cut_tail=True))
                score = 1 / (1 + np.exp(-np.clip(model.curve[0] + x @ model.curve[1:], -30, 30)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(v) for v in x.T.copy()), pa.array(score)], names=[*keep, "whole", "top", "excess", "score"])

    return docs.select(*keep, "text").mapInArrow(task, f"{fields}, whole double, top double, excess double, score double")


def keep_ordinary(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` whose text is not predicted toxic, all columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        model = held.value
        for batch in batches:
            for part in slices(batch):
                x = model.features(Words(part.column("text"), cut_tail=True))
                yield part.filter(pa.array(model.curve[0] + x @ model.curve[1:] < 0))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(task, docs.schema)


def score(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= 0.5) of every row.

    Labels are learnt from rows of `labels` that meet `learn`, a condition on
    doc_id, `sample` at most; rows labelled twice count as toxic if one label
    says so. A score sees the text alone. Null and empty texts have the score
    of a text that says nothing. Without two classes to learn from, all scores
    lean to the one class there is, or to ordinary. Other columns are not read.
    """
    model = fit(docs, labels.where(learn), sample)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    made = features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text), model, ["doc_id"])
    return made.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
