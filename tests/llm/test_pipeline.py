"""The pipeline on odd rows and on the smallest tables, against single operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_keep_the_columns(spark, odd_docs, no_docs, stage):
    _, f = stage
    docs = odd_docs.select(*COLUMNS)
    out = f(spark, docs, SF)
    assert out.columns == COLUMNS and out.count() <= docs.count()
    assert f(spark, no_docs.select(*COLUMNS), SF).count() == 0


def test_copies_leave_one_of_each_group(spark, odd_docs):
    out = [r.doc_id for r in corpus_pipeline.drop_copies(spark, odd_docs.select(*COLUMNS), SF).collect()]
    assert sorted(x for x in out if x is not None) == [0, 1, 2, 3, 4, 5, 8, 9, 10]
    assert out.count(None) == 1


def test_leaks_go_by_row_whatever_their_id(spark):
    item = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    clean = "quite another text that holds nothing of it at all and goes on for a while to be long enough"
    data = [(None, item), (5, item), (None, clean), (5, clean), (6, clean), (None, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_leaks(spark, docs, SF)
    assert kept.columns == COLUMNS
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((i, t) for i, t in data if t != item), key=str)


def test_run_packs_what_the_stages_keep(spark):
    got = corpus_pipeline.run(spark, SF).cache()
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    all_ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert ids < all_ids and len(ids) > 0.6 * len(all_ids)
    end = got.select((F.col("sequence_id") * 2048 + F.col("offset")).alias("at"), "length").orderBy("at").collect()
    assert np.array_equal([r.at for r in end][1:], np.cumsum([r.length for r in end])[:-1])
