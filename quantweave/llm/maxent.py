"""A hashed maximum-entropy language model with a class-factored softmax.

    P(w | h) = P(class(w) | h) * P(w | class(w))

Every frequent word (and a text's end) is a class of its own; all other words
are classed by their last two bytes, so words never seen have a class, too.
P(class | h) is a softmax over weights of hashed features of the history: the
word before, the one before that (a skip), the pair of the last two classes,
and the third last class with the nearest frequent word at any distance (a long
skip). A class's commonest words have a slot each, all its other words share
slot 0: P(slot | class, h) is a second softmax, over weights of the word
before and of the one before that, each hashed with the class. Within slot 0 a
word has its discounted relative frequency; what the discount leaves
goes to one symbol of the class for all words that training never met. Over the
words met and these symbols the probabilities sum to one.

Counts come from all training documents by grouped aggregation. Weights are
trained in rounds: in each, every partition takes gradient steps over its share
of that round's documents, and the partitions' weights are averaged.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved
from .words import Words, mix, slices

HEAD, TAIL = 24, 39
CLASSES = HEAD + TAIL + 1
END = CLASSES - 1
ROWS_LOG2 = 14
#: Slots of a tail class: its commonest words and, as slot 0, all others.
SLOTS = 32
#: Words whose counts every task holds; counts of all others are joined.
KEPT = 1 << 17
DISCOUNT = 0.6
BATCH = 1 << 12
_U = np.uint64
_START = _U(0x51ED270B0A1F39C1)
_END_HASH = _U(0x2545F4914F6CDD1D)


@dataclass
class Counts:
    """What tasks hold of the counts; its size has bounds that no corpus moves."""

    total: int
    distinct: int
    end: int
    head: np.ndarray  # hashes of the frequent words, by class
    words: np.ndarray  # hashes of KEPT words, sorted, and their counts
    n: np.ndarray
    slotted: np.ndarray  # hashes of the words with a slot of their own, sorted, and their slots
    slot: np.ndarray
    slot_n: np.ndarray  # tokens by class and slot
    rest_v: np.ndarray  # words in each class's slot 0


def _tail_class(words: Words) -> np.ndarray:
    last = words.data[words.end - 1].astype(np.uint64)
    second = np.where(words.end - words.start > 1, words.data[np.maximum(words.end - 2, 0)], 0).astype(np.uint64)
    return HEAD + (mix(last * _U(256) + second) % _U(TAIL)).astype(np.int64)


def count(docs: DataFrame) -> DataFrame:
    """(kind, word, tail_class, n) of the rows: kind 0 words, 1 texts; stored."""

    def rows(kind, word, cls, n):
        m = len(word)
        return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind), pa.int32()), pa.array(word, pa.int64()), pa.array(cls, pa.int32()), pa.array(n, pa.int64())], names=["kind", "word", "tail_class", "n"])

    def task(batches):
        texts = 0
        held: list[tuple] = []

        def merged():
            word, cls, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(word, kind="stable")
            word, cls, n = word[order], cls[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            return word[first], cls[first], np.add.reduceat(n, first)

        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                texts += len(part)
                if not len(words.hash):
                    continue
                word, first, n = np.unique(words.hash, return_index=True, return_counts=True)
                held.append((word, _tail_class(words)[first], n))
                if sum(len(x[0]) for x in held) > 1 << 21:
                    held[:] = [merged()]
                    if len(held[0][0]) > 1 << 20:
                        word, cls, n = held.pop()
                        yield rows(0, word.view(np.int64), cls, n)
        if held:
            word, cls, n = merged()
            yield rows(0, word.view(np.int64), cls, n)
        yield rows(1, [0], [0], [texts])

    made = docs.select("text").mapInArrow(task, "kind int, word long, tail_class int, n long")
    return saved(made.groupBy("kind", "word", "tail_class").agg(F.sum("n").alias("n")))


def summary(counts: DataFrame) -> Counts:
    words = counts.where("kind = 0")
    top = words.orderBy(F.desc("n"), "word").limit(KEPT).select("word", "tail_class", "n").toArrow()
    hashes, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    cls = top.column("tail_class").to_numpy()
    head = hashes[:HEAD]
    slot = np.zeros(len(hashes), np.int64)
    slot_n, rest_v = np.zeros((CLASSES, SLOTS), np.int64), np.zeros(CLASSES, np.int64)
    for c in range(HEAD, END):
        first = np.flatnonzero(cls[HEAD:] == c)[: SLOTS - 1] + HEAD
        slot[first] = np.arange(1, len(first) + 1)
        slot_n[c, 1 : len(first) + 1] = n[first]
    for c, tokens, kinds in words.where(~F.col("word").isin(head.view(np.int64).tolist())).groupBy("tail_class").agg(F.sum("n"), F.count("*")).collect():
        slot_n[c, 0] = tokens - slot_n[c].sum()
        rest_v[c] = kinds - np.count_nonzero(slot_n[c, 1:])
    end = counts.where("kind = 1").agg(F.sum("n")).first()[0] or 0
    tokens, kinds = words.agg(F.sum("n"), F.count("*")).first()
    order = np.argsort(hashes)
    own = order[slot[order] > 0]
    return Counts((tokens or 0) + end, kinds + (end > 0), end, head, hashes[order], n[order], hashes[own], slot[own], slot_n, rest_v)


@dataclass
class Model:
    """Weights and biases of the classes, and of the slots within them."""

    weights: np.ndarray
    bias: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray


def _rows(values, feature: int) -> np.ndarray:
    """The rows of weights that a feature's values hash to."""
    return (mix(values ^ mix(np.array([feature], np.uint64))) >> _U(64 - ROWS_LOG2)).astype(np.int64)


def _slots(hashes: np.ndarray, counts: Counts) -> np.ndarray:
    if not len(counts.slotted):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(counts.slotted, hashes), len(counts.slotted) - 1)
    return np.where(counts.slotted[at] == hashes, counts.slot[at], 0)


class Tokens:
    """Tokens of a slice's rows, each row's end included, with their features."""

    def __init__(self, words: Words, counts: Counts):
        head, rows = counts.head, len(words.bounds) - 1
        self.bounds = words.bounds + np.arange(rows + 1)
        size = int(self.bounds[-1])
        ends = self.bounds[1:] - 1
        inner = np.ones(size, bool)
        inner[ends] = False
        word = np.full(size, _END_HASH)
        word[inner] = words.hash
        cls = np.full(size, END)
        own = _tail_class(words) if len(words.hash) else np.zeros(0, np.int64)
        if len(head):
            order = np.argsort(head)
            at = np.minimum(np.searchsorted(head[order], words.hash), len(head) - 1)
            own = np.where(head[order][at] == words.hash, order[at], own)
        cls[inner] = own
        self.cls, self.word_cls = cls, own
        start = np.repeat(self.bounds[:-1], np.diff(self.bounds))
        at = np.arange(size)

        def back(values, k, none):
            return np.where(at - k >= start, values[np.maximum(at - k, 0)], none)

        near = np.maximum.accumulate(np.where(cls < HEAD, at, -1)) if size else at
        near = np.concatenate([[-1], near[:-1]]) if size else at
        near = np.where(near >= start, cls[np.maximum(near, 0)], CLASSES).astype(np.uint64)
        c1, c2, c3 = (back(cls, k, CLASSES).astype(np.uint64) for k in (1, 2, 3))
        before = (back(word, 1, _START), back(word, 2, _START))
        made = (*before, c1 * _U(1000) + c2, c3 * _U(1000) + near)
        self.features = [_rows(x, k + 1) for k, x in enumerate(made)]
        # the tokens of tail classes: their slots, and the features that tell slots
        self.tail = np.flatnonzero((cls >= HEAD) & (cls < END))
        self.slot = _slots(word[self.tail], counts)
        salt = mix(cls[self.tail].astype(np.uint64))
        self.slot_features = [_rows(x[self.tail] ^ salt, k + 11) for k, x in enumerate(before)]

    def batches(self):
        for a in range(0, len(self.cls), BATCH):
            yield self.cls[a : a + BATCH], [f[a : a + BATCH] for f in self.features]

    def slot_batches(self):
        for a in range(0, len(self.tail), BATCH):
            yield self.cls[self.tail[a : a + BATCH]], self.slot[a : a + BATCH], [f[a : a + BATCH] for f in self.slot_features]


def _masses(weights, bias, features):
    """exp of the cells' scores, and their sums."""
    out = weights.take(features[0], axis=0)
    for f in features[1:]:
        out += weights.take(f, axis=0)
    out += bias
    np.exp(np.minimum(out, 60, out=out), out=out)
    return out, out @ np.ones(out.shape[1], np.float32)


def _log_share(weights, bias, cell, features) -> np.ndarray:
    mass, total = _masses(weights, bias, features)
    return np.log10(np.maximum(mass[np.arange(len(cell)), cell], 1e-37)) - np.log10(total)


def _class_scores(model: Model, tokens: Tokens) -> np.ndarray:
    """log10 P(class | history) of every token."""
    found = [_log_share(model.weights, model.bias, cls, features) for cls, features in tokens.batches()]
    return np.concatenate([np.zeros(0), *found])


def _slot_scores(model: Model, tokens: Tokens) -> np.ndarray:
    """log10 P(slot | class, history) of every token; 0 where the class is one word."""
    out = np.zeros(len(tokens.cls))
    found = [_log_share(model.inner, model.inner_bias[cls], slot, features) for cls, slot, features in tokens.slot_batches()]
    out[tokens.tail] = np.concatenate([np.zeros(0), *found])
    return out


def _row_sums(p: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that a feature names, and the sums of p's rows by them.

    p's rows are sorted by the feature; within a run of equal ones each second
    row goes to the one before it, then each second of those left, and so on."""
    order = np.argsort(feature.astype(np.uint16), kind="stable")  # ROWS_LOG2 is below 16: a radix sort
    row, size = feature[order], len(feature)
    ends = np.append(np.flatnonzero(row[1:] != row[:-1]) + 1, size)
    many = np.diff(ends, prepend=0)
    first = ends - many
    place = np.arange(size) - np.repeat(first, many)
    left = np.repeat(many, many) - place
    own, k = p.take(order, axis=0), 1
    to = np.flatnonzero((place & 1 == 0) & (left > 1))
    while len(to):
        own[to] += own.take(to + k, axis=0)
        k *= 2
        to = to[(place[to] & (2 * k - 1) == 0) & (left[to] > k)]
    return row[first], own.take(first, axis=0)


def _step(weights, bias, seen, cell, features, rate: float) -> None:
    """A gradient step over a batch, in place; a feature's rate falls with the
    squared gradients that its row has seen."""
    width = weights.shape[1]
    p, total = _masses(weights, bias, features)
    p /= total[:, None]
    p[np.arange(len(cell)), cell] -= 1
    for f in features:
        at, slope = _row_sums(p, f)
        seen[at] += np.einsum("ij,ij->i", slope, slope) / width
        slope *= (rate / np.sqrt(seen[at]))[:, None]
        weights[at] -= slope


def _biases(counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Log frequencies of the classes, and of the slots of each class; a slot
    without a word has none."""
    freq = counts.slot_n.sum(axis=1).astype(float)
    at = np.searchsorted(counts.words, counts.head)
    freq[: len(counts.head)] = counts.n[at] if len(counts.head) else 0
    freq[END] = counts.end
    inner = counts.slot_n + 0.5
    inner[:, 1:][counts.slot_n[:, 1:] == 0] = 0
    with np.errstate(divide="ignore"):
        inner = np.log(inner / inner.sum(axis=1, keepdims=True))
    return np.log((freq + 0.5) / (freq + 0.5).sum()).astype(np.float32), inner.astype(np.float32)


def train(docs: DataFrame, counts: Counts, rounds: int = 2, rate: float = 0.15) -> Model:
    """Every row of `docs` (key, text) takes part in one round."""
    context = docs.sparkSession.sparkContext
    bias, inner_bias = _biases(counts)
    cut = CLASSES << ROWS_LOG2
    weights = np.zeros(cut + (SLOTS << ROWS_LOG2), np.float32)

    def tables(flat):
        return flat[:cut].reshape(-1, CLASSES), flat[cut:].reshape(-1, SLOTS)

    parts = 64
    schema = "part int, salt int, weights binary, tokens double"

    def average(table: pa.Table) -> pa.Table:
        total = sum(table.column("tokens").to_pylist())
        mean = sum(np.frombuffer(w.as_buffer(), np.float32) * np.float32(n / total) for w, n in zip(table.column("weights"), table.column("tokens").to_pylist(), strict=True))
        return pa.table({"part": table.column("part")[:1].cast(pa.int32()), "salt": pa.array([0], pa.int32()), "weights": pa.array([mean.tobytes()], pa.binary()), "tokens": pa.array([total])})

    for turn in range(rounds):
        start = context.broadcast(weights)

        def task(batches, start=start):
            own, n = start.value.copy(), 0
            classes, inner = tables(own)
            seen, inner_seen = np.ones(len(classes), np.float32), np.ones(len(inner), np.float32)
            for batch in batches:
                for part in slices(batch):
                    tokens = Tokens(Words(part.column("text")), counts)
                    n += len(tokens.cls)
                    for cls, features in tokens.batches():
                        _step(classes, bias, seen, cls, features, rate)
                    for cls, slot, features in tokens.slot_batches():
                        _step(inner, inner_bias[cls], inner_seen, slot, features, rate)
            if n:
                salt = TaskContext.get().partitionId() // 32
                pieces = [x.tobytes() for x in np.split(own, parts)]
                yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([salt] * parts, pa.int32()), pa.array(pieces, pa.binary()), pa.array([float(n)] * parts)], names=["part", "salt", "weights", "tokens"])

        share = docs.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == turn).select("text")
        some = share.mapInArrow(task, schema)
        # sums of 32 partitions each, then of those: no task sees many weights
        mean = some.groupBy("part", "salt").applyInArrow(average, schema).groupBy("part").applyInArrow(average, schema)
        got = {r.part: r.weights for r in mean.collect()}
        if got:
            weights = np.concatenate([np.frombuffer(got[p], np.float32) for p in range(parts)])
    classes, inner = tables(weights)
    return Model(classes, bias, inner, inner_bias)


def score(docs: DataFrame, training, rounds: int = 2) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score after doc_id for
    every row of `docs`; `training` is a condition on doc_id.

    Tokens are the words of the whole text, A-Z lower-cased, and one end; null
    and empty texts are the end alone. Rows that share a doc_id are scored each
    for itself. Other columns are not read. Without training rows all words are
    unseen.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    learn = rows.where(training)
    stored = count(learn)
    counts = summary(stored)
    model = docs.sparkSession.sparkContext.broadcast((train(learn.select("key", "text"), counts, rounds), counts))
    scale = np.log10(counts.total + counts.distinct + 1)

    def known(words: Words, counts: Counts) -> np.ndarray:
        """Counts of kept words, 0 for the rest."""
        if not len(counts.words):
            return np.zeros(len(words.hash), np.int64)
        at = np.minimum(np.searchsorted(counts.words, words.hash), len(counts.words) - 1)
        return np.where(counts.words[at] == words.hash, counts.n[at], 0)

    def sums(values, bounds):
        total = np.concatenate([[0], np.cumsum(values)])
        return total[bounds[1:]] - total[bounds[:-1]]

    def texts(batches):
        trained, counts = model.value
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                tokens = Tokens(words, counts)
                n = known(words, counts)
                rest = (tokens.word_cls >= HEAD) & (n > 0) & (_slots(words.hash, counts) == 0)
                word = np.where(rest, np.log10(np.maximum(n - DISCOUNT, 1e-9) / np.maximum(counts.slot_n[tokens.word_cls, 0], 1)), 0)
                base = np.where(n > 0, np.log10(n + 1) - scale, 0)
                end = np.log10(counts.end + 1) - scale
                score = sums(_class_scores(trained, tokens) + _slot_scores(trained, tokens), tokens.bounds) + sums(word, words.bounds)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("doc_id"), pa.array(np.diff(tokens.bounds), pa.int64()), pa.array(sums(n > 0, words.bounds) + (counts.end > 0), pa.int64()), pa.array(sums(base, words.bounds) + end), pa.array(score)],
                    names=["key", "doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    def rare(batches):
        counts = model.value[1]
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                left = np.flatnonzero(known(words, counts) == 0)
                if not len(left):
                    continue
                row, hashed = words.row()[left], words.hash[left]
                order = np.lexsort((hashed, row))
                row, hashed, left = row[order], hashed[order], left[order]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1])]))
                key = part.column("key").to_numpy()[row[first]]
                at = left[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array(hashed[first].view(np.int64)), pa.array(np.diff(np.append(first, len(row))), pa.int32()), pa.array(_tail_class(words)[at], pa.int32())],
                    names=["key", "word", "times", "tail_class"],
                )

    whole = rows.select("key", "doc_id", "text").mapInArrow(texts, "key long, doc_id long, n_tokens long, n_known long, base_score double, score double")
    seldom = rows.select("key", "text").mapInArrow(rare, "key long, word long, times int, tail_class int")
    mass = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("tail_class") + 1)
    rest_n = np.maximum(counts.slot_n[:, 0], 1)
    unseen = np.where(counts.rest_v > 0, np.log10(np.maximum(DISCOUNT * counts.rest_v, 1e-9) / rest_n), 0)
    met = F.col("n").isNotNull()
    priced = seldom.join(stored.where("kind = 0").select("word", "n"), "word", "left").select(
        "key",
        F.when(met, F.col("times")).otherwise(0).alias("known"),
        (F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 1) - F.lit(float(scale)))).alias("base"),
        (F.col("times") * F.when(met, F.log10(F.col("n") - DISCOUNT) - mass(np.log10(rest_n))).otherwise(mass(unseen))).alias("part"),
    )
    # rows equal in doc_id and text share a key, and each brings the same words
    rest = priced.groupBy("key").agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("part").alias("part"))
    times = rows.groupBy("key").agg(F.count("*").alias("rows"))
    rest = rest.join(times, "key")
    return whole.join(rest, "key", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce(F.col("known") / F.col("rows"), F.lit(0))).cast("long").alias("n_known"),
        F.lit(counts.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce(F.col("base") / F.col("rows"), F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce(F.col("part") / F.col("rows"), F.lit(0.0))).alias("score"),
    )
