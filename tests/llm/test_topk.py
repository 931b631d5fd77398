"""MaxScore against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import topk


def plain_top(ids, x, query_id, q, k):
    rows = sorted((-int(v @ q), int(i)) for i, v in zip(ids, x, strict=True) if i != query_id)
    return [(i, -s) for s, i in rows[:k]]


@pytest.mark.parametrize("seed", range(12))
def test_shard_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, dims, k = int(rng.integers(1, 900)), int(rng.integers(1, 40)), int(rng.integers(1, 8))
    spread = [2, 30, 300][seed % 3]
    x = rng.integers(-spread, spread, (n, dims)) + (spread if seed % 4 == 0 else 0)
    ids = rng.permutation(n)
    for kind in (np.float64, np.int64):
        shard = topk.Shard(ids, x.astype(kind))
        for j in range(0, n, max(1, n // 10)):
            got_ids, scores = shard.top(int(ids[j]), x[j].astype(kind), k)
            assert list(zip(got_ids.tolist(), [int(s) for s in scores], strict=True)) == plain_top(ids, x, ids[j], x[j], k)


def test_bounds_save_work():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 8, (4000, 64)) * np.linspace(4, 0.2, 64)
    x = np.floor(x)
    probed = []
    shard = topk.Shard(np.arange(4000), x)
    for j in range(20):
        shard.top(j, x[j], 5, probed)
    assert sum(probed) < 20 * 4000 * 64 / 2


@pytest.mark.parametrize("per", [10_000, 7])
def test_odd_rows(spark, per):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 6).tolist()) for i in range(80)]
    rows += [(50, rows[50][1]), (80, [0.0]), (81, None), (82, [1.0, None]), (83, [float("nan")] * 6), (84, [float("inf")] * 6), (None, [1.0] * 6), (85, []), (86, rows[3][1])]
    df = spark.createDataFrame([(*r, 9, "mine") for r in rows], "vec_id long, embedding array<double>, rank int, part string")
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, per_shard=per, per_block=per).collect()
    part = {i: v for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    ids = np.array(sorted(part))
    x = np.zeros((len(ids), 6), dtype=np.int64)
    for k, i in enumerate(ids):
        x[k, : len(part[int(i)])] = np.floor(256 * np.array(part[int(i)]))
    want = [(int(i), r + 1, *t) for i, q in zip(ids, x, strict=True) if i % 10 == 0 for r, t in enumerate(plain_top(ids, x, i, q, 5))]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.where("false"), F.lit(True)).count() == 0
    assert len(topk.top_k(df.where("vec_id < 3"), F.lit(True)).collect()) == 6


def test_every_vector_of_an_id_is_a_candidate(spark):
    rows = [(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (3, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 3 == 0, k=3).collect()
    one = 256 * 256
    want = [(0, 1, 1, 3 * one), (0, 2, 2, 2 * one), (0, 3, 3, one // 2), (3, 1, 1, 3 * one // 2), (3, 2, 2, one), (3, 3, 0, one // 2)]
    assert sorted(map(tuple, got)) == want
