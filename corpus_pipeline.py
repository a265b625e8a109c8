"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it
as Parquet into the folder that all executors share and reads it again as the
next stage's docs.
"""

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantweave.llm import decontaminate, langid, nearjoin, packing, toxicity
from quantweave.llm.shared import saved, table

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, by a model of all labels."""
    return toxicity.keep_ordinary(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return langid.keep_identified(docs, langid.fit(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of documents linked by 0.8 of their five-word
    shingles; of rows that share an id one stays, rows without an id stay all."""
    groups = nearjoin.link_components(docs, k=5, least=Fraction(4, 5))
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    one = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(*docs.columns)
    first = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    one = one.select(F.struct("*").alias("row"), first.alias("nth")).where("nth = 1").select("row.*")
    return one.union(docs.where("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item. Each row is judged by its own text: rows without an id
    and rows that share one are told apart by a hash of id and text."""
    own = F.xxhash64("doc_id", "text")
    leaks = decontaminate.matches(docs.withColumn("doc_id", own), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("key")).distinct()
    return docs.select(F.struct("*").alias("row"), own.alias("key")).join(leaks, "key", "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unidentified),
    ("ngram_jaccard_join", drop_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
