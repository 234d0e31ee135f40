"""The hash-prefix forest against brute force."""

import numpy as np
import pytest

from wardbook.llm.nearest import nearest
from wardbook.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(ids, x, queries, k):
    out = {}
    for i in queries:
        s = np.zeros(len(x))
        for d in range(x.shape[1]):
            s += x[i, d] * x[:, d]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in v}) / len(v) for q, v in want.items()])


def test_recall_on_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got, want = results(QUERIES["op5_nearest"](spark, SF)), brute(ids, x, np.flatnonzero(ids % 20 == 0), 20)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    for q, v in got.items():
        exact = {int(i): x[ids == q][0] @ x[ids == i][0] for i, _ in v}
        assert all(abs(exact[i] - s) < 1e-12 for i, s in v)


@pytest.mark.parametrize("scaled", [False, True])
def test_clusters_copies_and_lengths(spark, scaled):
    """Tight clusters, a vector with many copies, vectors of different lengths, several shards and blocks."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([np.repeat(centres, 60, axis=0) + rng.normal(size=(1800, 16)) * 0.02, rng.normal(size=(600, 16)), np.tile(centres[:1], (200, 1))])
    if scaled:
        x *= rng.uniform(0.2, 3, (len(x), 1))
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist(), "x", 1.0) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, ids string, v double")
    got = results(nearest(df, df.where("vec_id % 20 = 0"), k=10, shard=500, block=50))
    assert recall(got, brute(ids, x, np.flatnonzero(ids % 20 == 0), 10)) >= 0.9


def test_large_components_and_many_shards(spark):
    """Products of some 1e11: no neighbour is lost to rounding, and every query gets all its k."""
    rng = np.random.default_rng(8)
    x = np.concatenate([np.repeat(rng.normal(size=(20, 24)), 30, axis=0), rng.normal(size=(200, 24))]) * 1e5
    x[:600:2] += rng.normal(size=(300, 24)) * 1e3
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = results(nearest(df, df.where("vec_id % 20 = 0"), k=10, shard=30))
    assert {len(v) for v in got.values()} == {10}
    assert recall(got, brute(ids, x, np.flatnonzero(ids % 20 == 0), 10)) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, []), (20, [0.5, 0.5]), (None, [1.0, 1.0]), (40, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert results(nearest(df, df.where("vec_id % 20 = 0"))) == {0: [(1, 0.5), (20, 0.5)], 20: [(0, 0.5), (1, 0.5)]}
    assert nearest(df.limit(0), df.limit(0)).collect() == [] and nearest(df, df.limit(0)).collect() == []
