"""Graphs over all vectors against brute force."""

import numpy as np
import pytest

from quantweave import catalog
from quantweave.operators import graphs


@pytest.mark.parametrize("block, few", [(32, 50), (512, 1 << 18)])
def test_graphs_use_every_vector(spark, tmp_path, monkeypatch, block, few):
    monkeypatch.setattr(graphs, "BLOCK", block)
    monkeypatch.setattr(graphs, "FEW", few)
    x = np.random.default_rng(4).normal(size=(150, 8)).astype(np.float32).astype(float)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-10)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    w = np.maximum(s - np.quantile(s[s > 0], 0.8), 0)
    got = {q: catalog.queries()[q](spark, str(tmp_path)).collect() for q in ("cosine_graph_all", "normalised_graph_all", "propagated_features_all")}
    for name, want in (("cosine_graph_all", w), ("normalised_graph_all", w / np.sqrt(np.maximum(np.outer(w.sum(1), w.sum(1)), 1e-300)))):
        have = np.zeros_like(w)
        for r in got[name]:
            have[r.i, r.j] += r.w
        assert len(got[name]) == (w > 0).sum() and np.abs(have - want).max() < 2e-6
    looped = w + np.eye(150)
    d = looped.sum(1)
    want = (looped / np.sqrt(np.outer(d, d))) @ x[:, :2]
    assert len(got["propagated_features_all"]) == 150
    assert all(abs(r.f1 - want[r.asset, 0]) < 2e-6 and abs(r.f2 - want[r.asset, 1]) < 2e-6 for r in got["propagated_features_all"])


def test_equal_cosines_join_the_nearest(spark):
    data = [(0, i, k, float(k == 0)) for i in range(5) for k in range(3)]
    rows = spark.createDataFrame(data, "t int, asset long, k int, v double")
    want = {tuple(r) for r in graphs.cosine_graph(rows, 8).collect()}
    assert want and {tuple(r) for r in graphs.whole_cosine_graph(rows.drop("t"), 8).collect()} == want


def test_no_pair_and_no_edge_is_shuffled(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(60, 4)).astype(np.float32).astype(float)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for q in ("cosine_graph", "normalised_graph", "propagated_features"):
        plan = catalog.queries()[q](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "FlatMapGroupsInArrow" not in plan
        # the vectors by block, and of the features the sums by asset
        keys = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(" in line]
        assert all(k.startswith(("block#", "asset#")) for k in keys)


def test_copies_nulls_and_one_direction_as_in_sql(spark, tmp_path):
    import duckdb

    x = np.random.default_rng(6).normal(size=(40, 4)).astype(np.float32).astype(float)
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, [1.0, 0.0, 0.5, 0.0]), (50, [0.0] * 4), (51, x[3].tolist())]
    spark.createDataFrame(data, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    for q in ("cosine_graph", "normalised_graph", "propagated_features"):
        got = catalog.queries()[q](spark, str(tmp_path))
        want = con.execute(catalog.oracles()[q])
        names = [c[0] for c in want.description]
        ours, theirs = sorted(tuple(r) for r in got.select(*names).collect()), sorted(want.fetchall())
        assert [r[:-2] for r in ours] == [r[:-2] for r in theirs] and np.allclose(np.array(ours, float), np.array(theirs, float), atol=2e-6)


@pytest.mark.parametrize("ordered", [100, 1 << 21])
def test_tasks_round_weights_and_put_them_in_order(spark, tmp_path, monkeypatch, ordered):
    monkeypatch.setattr(graphs, "BLOCK", 64)
    monkeypatch.setattr(graphs, "ORDERED", ordered)
    x = np.random.default_rng(7).normal(size=(300, 8)).astype(np.float32).astype(float)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = graphs.whole_vectors(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), "vec_id", "embedding")
    for q, exact in (("cosine_graph", graphs.whole_cosine_graph), ("normalised_graph", graphs.whole_normalised_graph)):
        got = catalog.queries()[q](spark, str(tmp_path))
        assert "round(" not in got._jdf.queryExecution().optimizedPlan().toString()
        parts = got.rdd.glom().collect()
        want = {(r.i, r.j): r.w for r in exact(rows, 8).collect()}
        have = {(r.i, r.j): r.w for part in parts for r in part}
        assert have.keys() == want.keys() and sum(map(len, parts)) == len(want)
        assert all(abs(have[k] - want[k]) < 5.1e-7 and have[k] == round(have[k], 6) for k in want)
        assert q == "normalised_graph" or ordered == 100 or all(a.w <= b.w for part in parts for a, b in zip(part, part[1:]))


def test_passes_that_leave_sums_cross_few_partitions(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("SLAB", 1 << 10), ("SIDES", 2)):
        monkeypatch.setattr(graphs, name, value, raising=False)
    x = np.random.default_rng(8).normal(size=(100, 8))
    rows = graphs.whole_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "a long, v array<double>"), "a", "v")
    whole = graphs._Whole(rows, 8)
    assert whole.parts == 7 and whole.edges().rdd.getNumPartitions() == 49
    assert whole.pairs(lambda pairs: iter(()), "asset long").rdd.getNumPartitions() == 4
