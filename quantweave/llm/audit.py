"""What document filters do in every order: who fails what, first, again or alone.

A document's failures are a set of bits. Four filters look at the text; the fifth,
E, asks whether a smaller doc_id has the same text, by a left semi join of the
table with itself on a hash, the exact text and the smaller id. Marks of E are
united with the other failures and added up by document. What an order of the
filters does then follows from the number of documents of each combination of
bits, so all orders cost one small table and no further pass over the texts.
"""

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

LETTERS = "ABCDE"
_SETS = 1 << len(LETTERS)
_E = 1 << LETTERS.index("E")
_ORDERS = ["".join(o) for o in permutations(LETTERS)]
_KEY = ["h1", "h2", "size"]


def failures(rows: DataFrame) -> DataFrame:
    """`rows` (h1, h2, size, doc_id, part, text without nulls) without the text, with `mask`: bits of A to D.

    A: under 200 words; B: fewer distinct words than half of the words; C: more than 2 capitals A-Z in 100
    code points; D: one of #$%&*| . A text without words fails A alone.
    """
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    seen = rows.withColumn("words", words).withColumns(
        {"n": F.size("words"), "kinds": F.size(F.array_distinct("words")), "capitals": F.length(F.regexp_replace("text", "[^A-Z]+", "")), "points": F.length("text")}
    )
    fails = [F.col("n") < 200, 100 * F.col("kinds") < 50 * F.col("n"), 100 * F.col("capitals").cast("long") > 2 * F.col("points"), F.col("text").rlike(r"[#$%&*|]")]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return seen.select(*_KEY, "doc_id", "part", mask.cast("int").alias("mask"))


def _same(left: DataFrame, right: DataFrame) -> Column:
    same = left[_KEY[0]] == right[_KEY[0]]
    for k in _KEY[1:]:
        same &= left[k] == right[k]
    return same


def repeats(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of `rows` whose text a smaller doc_id has, without the text. `keys`: h1, h2, size, doc_id of all rows.

    Of the rows with one text only one with the smallest id is held against the others, so a text that a third
    of all rows share adds one row to the right side; the left side goes straight from its exchange into the
    join, so a heavy key can be split. Hashes and length choose the row that is held, the text itself decides.
    Rows without an id neither mark nor are marked; rows that share id and text do not mark each other.
    """
    firsts = keys.where("doc_id is not null").groupBy(*_KEY).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first")
    found = rows.join(firsts, _same(rows, firsts) & (rows["doc_id"] == firsts["first"]), "left_semi")
    # rows that share an id and these hashes: any one of them
    held = saved(found.groupBy(*_KEY, "doc_id").agg(F.any_value("text").alias("text")))
    return rows.join(held, _same(rows, held) & (rows["text"] == held["text"]) & (held["doc_id"] < rows["doc_id"]), "left_semi").drop("text")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a source fail exactly the filters of `mask`, and how
    many of them `labels` calls good (quality = 1) or toxic.

    `docs`: doc_id, text, source; null texts are empty, a null source is the part "". Every row counts, rows that
    share an id too. An id with several labels is good or toxic if any of them says so, a row without an id has
    none; other columns are not
    read. Empty tables give an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("again"), "text"), "size": F.octet_length("text")})
    failed = saved(failures(rows))  # one row a document, without its text
    marked = repeats(rows, failed.select(*_KEY, "doc_id")).select(*_KEY, "doc_id", "part", F.lit(_E).alias("mask"), F.lit(0).alias("n"))
    whole = failed.select(*_KEY, "doc_id", "part", "mask", F.lit(1).alias("n")).union(marked).groupBy(*_KEY, "doc_id", "part").agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n"))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counted = whole.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).join(said, "doc_id", "left")
    sums = {"n": F.col("n"), "good": F.col("n") * F.coalesce("good", F.lit(0)), "toxic": F.col("n") * F.coalesce("toxic", F.lit(0))}
    return counted.groupBy("part", "mask").agg(*[F.sum(v).cast("long").alias(k) for k, v in sums.items()])


def orders(combined: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every
    order of the five filters, from `combinations`' rows.

    A step's counts depend on its filter and on the set of filters before it, in whatever order: 80 cases.
    """
    bit = {x: 1 << i for i, x in enumerate(LETTERS)}
    steps = [(o, i + 1, bit[x], sum(bit[y] for y in o[:i])) for o in _ORDERS for i, x in enumerate(o)]
    cases = sorted({(own, before) for *_, own, before in steps})
    own, before, mask = F.col("case.own"), F.col("case.before"), F.col("mask")
    fails, fell = mask.bitwiseAND(own) != 0, mask.bitwiseAND(before) != 0
    # each member of a failing set comes first in as many of all orders
    turns = F.array(*[F.lit(len(_ORDERS) // max(1, m.bit_count())) for m in range(_SETS)])
    counts = {
        "kept": (~fails & ~fell, F.col("n")),
        "removed": (fails & ~fell, F.col("n")),
        "redundant": (fails & fell, F.col("n")),
        "unique_fails": (mask == own, F.col("n")),
        "good_lost": (fails & ~fell, F.col("good")),
        "toxic_lost": (fails & ~fell, F.col("toxic")),
        "shapley": (fails, F.col("n") * turns[mask]),
    }
    each = combined.withColumn("case", F.expr(f"explode(array({', '.join(f"named_struct('own', {a}, 'before', {b})" for a, b in cases)}))"))
    summed = each.groupBy("part", own.alias("own"), before.alias("before")).agg(*[F.sum(F.when(when, what).otherwise(0)).cast("long").alias(k) for k, (when, what) in counts.items()])
    served = combined.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(map(str, steps))} AS s(filter_order, step, own, before)")  # 600 rows
    return summed.join(F.broadcast(served), ["own", "before"]).select("part", "filter_order", "step", *counts)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`orders` of `combinations`: 600 rows a source."""
    return orders(combinations(docs, labels))
