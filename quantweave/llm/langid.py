"""Language by Bayesian fusion of text, markup, address and host.

The posterior of a row's language multiplies
- the likelihood of its text: byte trigrams of all labelled documents, hashed;
- P(language declared by the markup | language) and P(address suffix |
  language), from tables of how texts that read as a language are declared;
- the prior of its host, smoothed to its domain's, and that to all rows'.
Tables and priors come from one grouped aggregation over the rows themselves,
by the language their text alone suggests; a row is left out of its own prior.
Evidence that a row lacks counts nothing.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved
from .words import slices

BUCKETS = 1 << 16
#: Languages that are scored at a time, and blocks of them that a worker keeps ready.
TOGETHER, READY = 32, 8
#: Trigrams overlap and come in runs: a text's evidence weighs as this many at most.
WEIGHT = 80
#: Rows that a parent's prior is worth.
PRIOR = 5.0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_EDGE = np.uint8(32)
#: Prior odds that a text is in none of the languages.
OTHER = 1e-4


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams around each letter, their bytes (trigrams, 3), and their rows' bounds.

    What is no letter is a word edge, as are both ends of a text: each text with a letter has a trigram.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    edges = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[edges[0] : edges[-1]] if raw is not None else np.zeros(0, np.uint8)
    data, edges = _LOWER[data], edges - edges[0]
    data = np.where(_LETTER[data], data, _EDGE)
    # an edge before each text, and one after the last
    data = np.append(np.insert(data, edges[:-1], _EDGE), _EDGE)
    at = np.flatnonzero(data != _EDGE)
    parts = np.stack([data[at - 1], data[at], data[at + 1]], 1)
    wide = parts.astype(np.uint32)
    code = (wide[:, 0] << np.uint32(16)) | (wide[:, 1] << np.uint32(8)) | wide[:, 2]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64), parts, np.searchsorted(at, edges + np.arange(len(edges)))


@dataclass
class TextModel:
    """Trigram counts of every language, as they are met: one number for each trigram that a language has."""

    languages: list[str]
    language: np.ndarray  # of each count, ascending
    bucket: np.ndarray
    count: np.ndarray
    background: np.ndarray  # (256,) log P(byte), whatever the bytes beside it

    def __post_init__(self):
        self._ready: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"_ready": {}}

    def logs(self, first: int) -> np.ndarray:
        """(BUCKETS, languages) log P(trigram | language) of TOGETHER languages from `first` on."""
        if first not in self._ready:
            if len(self._ready) >= READY:
                self._ready.clear()
            a, b = np.searchsorted(self.language, (first, first + TOGETHER))
            counts = np.full((BUCKETS, min(TOGETHER, len(self.languages) - first)), 0.5)
            counts[self.bucket[a:b], self.language[a:b] - first] += self.count[a:b]
            self._ready[first] = np.log(counts / counts.sum(0))
        return self._ready[first]

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weighted log-likelihoods of each row, that of the background, and how many trigrams it has."""
        grams, parts, bounds = _trigrams(texts)
        n = np.diff(bounds)
        total = np.zeros((len(n), len(self.languages)))
        for first in range(0, len(self.languages), TOGETHER):
            logs = self.logs(first)
            sums = np.zeros((len(grams) + 1, logs.shape[1]))
            np.cumsum(logs[grams], axis=0, out=sums[1:])
            total[:, first : first + TOGETHER] = sums[bounds[1:]] - sums[bounds[:-1]]
        base = np.concatenate([np.zeros(1), np.cumsum(self.background[parts].sum(1))])
        weight = np.minimum(n, WEIGHT) / np.maximum(n, 1)
        return total * weight[:, None], (base[bounds[1:]] - base[bounds[:-1]]) * weight, n


def fit(docs: DataFrame) -> TextModel:
    """Trigram frequencies of every language from all rows of (text, lang) that have both.

    Each label is a language, however rare; they are names of languages, so their list and BUCKETS counts for
    each are held by the driver and every worker. Rows without a text or label, and texts without a letter,
    count nothing; repeated rows count each. An empty table gives a model without languages. Other columns are
    not read.
    """
    labelled = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    languages = sorted(r.lang for r in labelled.select("lang").distinct().collect())

    def task(batches):
        place = {x: i for i, x in enumerate(languages)}
        held: dict[int, np.ndarray] = {}
        each = np.zeros(256, np.int64)

        def given(language: int, counts: np.ndarray) -> pa.RecordBatch:
            seen = np.flatnonzero(counts)
            arrays = [np.full(len(seen), language), seen, counts[seen]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(arrays, (pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["language", "bucket", "n"])

        for batch in batches:
            for part in slices(batch):
                own = np.array([place[x] for x in part.column("lang").to_pylist()], np.int64)
                grams, parts, bounds = _trigrams(part.column("text"))
                each += np.bincount(parts.ravel(), minlength=256)
                row = np.repeat(own, np.diff(bounds))
                for i in np.unique(own).tolist():
                    if i not in held and len(held) == TOGETHER:  # room for others
                        yield from (given(k, held.pop(k)) for k in list(held))
                    held[i] = held.get(i, 0) + np.bincount(grams[row == i], minlength=BUCKETS)
        yield from (given(k, v) for k, v in held.items())
        yield given(-1, each)  # bytes

    # BUCKETS rows a language at most
    got = labelled.mapInArrow(task, "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()
    language, bucket, n = (got.column(c).to_numpy() for c in ("language", "bucket", "n"))
    own = language >= 0
    single = np.zeros(256)
    single[bucket[~own]] = n[~own]
    # half as in the labelled texts, else any letter: rare ones are no sign of a language
    plain, letters = np.zeros(256), _LETTER.astype(float)
    plain[97:123] = plain[_EDGE] = letters[_EDGE] = 1
    mixed = 0.5 * single / max(single.sum(), 1) + 0.4 * plain / plain.sum() + 0.1 * letters / letters.sum()
    order = np.flatnonzero(own)[np.lexsort((bucket[own], language[own]))]
    return TextModel(languages, language[order], bucket[order], n[order], np.log(np.maximum(mixed, 1e-9)))


def _scored(rows: DataFrame, model: TextModel, text: str) -> DataFrame:
    """The rows with text_scores (array), text_other (the background's) and text_lang (position; null without a trigram)."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def task(batches):
        model = held.value
        for batch in batches:
            for part in slices(batch, text):
                scores, other, n = model.scores(part.column(text))
                best = scores.argmax(1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * scores.shape[1], pa.int32()), pa.array(scores.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(other), pa.array(best, pa.int32(), mask=n == 0)], names=[*part.schema.names, "text_scores", "text_other", "text_lang"])

    return rows.mapInArrow(task, f"{fields}, text_scores array<double>, text_other double, text_lang int")


def _counts(size: int) -> list[Column]:
    return [F.sum(F.when(F.col("text_lang") == i, F.col("n")).otherwise(0)) for i in range(size)]


def identify(rows: DataFrame, model: TextModel, text: str, declared: str, suffix: str, domain: str, host: str) -> DataFrame:
    """`rows` with language (null: nothing tells), confidence and text_language.

    The arguments after the model name string columns of `rows`; null values and
    nulls of whole columns are evidence that is missing. Ties go to the language
    first in the alphabet. Other columns are kept. The names of the new columns
    and `text_scores`, `text_other`, `text_lang` must be free. Confidence falls where
    single bytes tell a text as well as the language does: gibberish, other languages.
    """
    names, size = model.languages, len(model.languages)
    if not size:
        return rows.withColumns({"language": F.lit(None).cast("string"), "confidence": F.lit(0.0), "text_language": F.lit(None).cast("string")})
    evidence = {"_declared": declared, "_suffix": suffix, "_domain": domain, "_host": host}
    seen = _scored(rows.select(F.col(text).alias("_text"), *(F.col(c).alias(k) for k, c in evidence.items())), model, "_text").where("text_lang is not null")
    table = saved(seen.groupBy("_declared", "_suffix", "_domain", "_host", "text_lang").agg(F.count("*").alias("n")))
    whole = [float(x or 0) for x in table.agg(*_counts(size)).first()]

    def likelihood(key: str) -> DataFrame:
        """log P(key | language) for each value of the key."""
        kinds = table.where(F.col(key).isNotNull()).select(key).distinct().count() + 1
        has = [float(x or 0) for x in table.where(F.col(key).isNotNull()).agg(*_counts(size)).first()]
        logs = F.array(*[F.log((c + 0.5) / F.lit(h + 0.5 * kinds)) for c, h in zip(_counts(size), has, strict=True)])
        return table.where(F.col(key).isNotNull()).groupBy(key).agg(logs.alias(f"{key}_logs"))

    def tally(key: str) -> DataFrame:
        return table.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*[c.cast("double") for c in _counts(size)]).alias(f"{key}_n"))

    # the text passes through Python once, in its own column
    out = _scored(rows.withColumns({k: F.col(c) for k, c in evidence.items()}), model, text)
    for key in ("_declared", "_suffix"):
        out = out.join(likelihood(key), key, "left")
    for key in ("_domain", "_host"):
        out = out.join(tally(key), key, "left")
    own = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(F.col("text_lang") == i, 1.0).otherwise(0.0))
    nothing = F.array(*[F.lit(0.0)] * size)

    def share(counts: Column, parent: Column) -> Column:
        left = F.zip_with(F.coalesce(counts, own), own, lambda a, b: F.greatest(a - b, F.lit(0.0)))
        total = F.aggregate(left, F.lit(0.0), lambda a, x: a + x) + PRIOR
        return F.zip_with(left, parent, lambda n, p: (n + PRIOR * p) / total)

    flat = F.array(*[F.lit(1.0 / size)] * size)
    out = out.withColumn("_p", share(F.array(*[F.lit(x) for x in whole]), flat))
    out = out.withColumn("_p", share(F.col("_domain_n"), F.col("_p")))
    out = out.withColumn("_p", share(F.col("_host_n"), F.col("_p")))
    logs = F.transform(F.col("_p"), lambda p: F.log(p))
    for part in ("text_scores", "_declared_logs", "_suffix_logs"):
        logs = F.zip_with(logs, F.coalesce(F.col(part), nothing), lambda a, b: a + b)
    out = out.withColumn("_logs", logs).withColumn("_top", F.array_max("_logs"))
    known = F.col("text_lang").isNotNull() | F.col("_declared").isNotNull() | F.col("_suffix").isNotNull() | F.col("_host_n").isNotNull()
    languages = F.array(*[F.lit(x) for x in names])
    best = F.array_position("_logs", F.col("_top")).cast("int")
    misfit = F.when(F.col("text_lang").isNotNull(), OTHER * F.exp(F.least(F.col("text_other") - F.element_at("text_scores", best), F.lit(700.0)))).otherwise(0.0)
    out = out.withColumns(
        {
            "language": F.when(known, F.element_at(languages, best)),
            "confidence": F.when(known, 1 / (misfit + F.aggregate(F.transform("_logs", lambda x: F.exp(x - F.col("_top"))), F.lit(0.0), lambda a, x: a + x))).otherwise(F.lit(0.0)),
            "text_language": F.get(languages, F.col("text_lang")),
        }
    )
    return out.select(*rows.columns, "language", "confidence", "text_language")


def address(url: Column) -> dict[str, Column]:
    """host, domain (its last two labels) and suffix of an address; null without a host."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    labels = F.split(host, r"\.")
    return {"host": host, "domain": F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2))), "suffix": F.when(host.rlike(r"\.[a-z]+$"), F.element_at(labels, -1))}


def declared_language(page: Column) -> Column:
    """The primary language that the html element of a page declares."""
    tag = F.regexp_extract(page, r"(?is)<html\b([^>]*)>", 1)
    code = F.lower(F.regexp_extract(tag, r"""(?is)(?:^|[\s"'])(?:xml:)?lang\s*=\s*["']?\s*([a-z]{2,3})\b""", 1))
    return F.nullif(code, F.lit(""))


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, url, language, confidence, text_language, declared, suffix, host for every page.

    The text is what `extract.blocks` takes for the article. A null html has no
    text and no declared language, a null or odd url no host. Rows that share a
    page_id stay rows of their own. Other columns are not read.
    """
    from .extract import blocks

    def texts(batches):
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                found = ["\n".join(t for k, t in blocks(h or "") if k < 2) for h in part.column("html").to_pylist()]
                yield part.drop_columns(["html"]).append_column("text", pa.array(found, pa.string()))

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.select("page_id", "url", declared_language(F.col("html")).alias("declared"), *(c.alias(k) for k, c in address(F.col("url")).items()), "html")
    plain = rows.mapInArrow(texts, "page_id long, url string, declared string, host string, domain string, suffix string, text string")
    found = identify(saved(plain), model, "text", "declared", "suffix", "domain", "host")
    return found.select("page_id", "url", "language", "confidence", "text_language", "declared", "suffix", "host")


def keep_identified(docs: DataFrame, model: TextModel, least: float = 0.5) -> DataFrame:
    """The rows of `docs` (text, source, ...) whose language is known with confidence `least`.

    The source serves as host. Texts without any letter are rejected,
    as are null and empty ones; all columns are kept as they are.
    """
    # other names, so that none clashes with those of `identify`
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in names.items())).withColumns({"host": F.col(names["source"]).cast("string"), "none": F.lit(None).cast("string")})
    found = identify(rows, model, names["text"], "none", "none", "none", "host")
    kept = found.where((F.col("confidence") >= least) & F.col("text_language").isNotNull())
    return kept.select(*(F.col(k).alias(c) for c, k in names.items()))
