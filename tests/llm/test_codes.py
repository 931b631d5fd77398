"""Codebooks and codes against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import codes


def plain_codes(rows):
    """(vec_id, vector) rows of whole numbers -> ({(vec_id, code, error)}, codebooks digest)."""
    width = max(1, -(-max(len(v) for _, v in rows) // 16)) * 16
    rows = sorted(((i, list(v) + [0] * (width - len(v))) for i, v in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    k = width // 16
    parts = [[v[p * k : p * k + k] for p in range(16)] for _, v in rows]
    books = [[parts[i][p] for i in range(min(64, len(rows)))] for p in range(16)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(2):
        for p in range(16):
            members = {}
            for x in parts:
                members.setdefault(best(x[p], books[p])[1], []).append(x[p])
            for j, m in members.items():
                books[p][j] = [sum(c) // len(m) for c in zip(*m, strict=True)]
    out = []
    for (i, _), x in zip(rows, parts, strict=True):
        found = [best(x[p], books[p]) for p in range(16)]
        out.append((i, bytes(j for _, j in found).hex(), min(sum(d for d, _ in found), (1 << 63) - 1)))
    text = ",".join(str(c) for book in books for e in book for c in e)
    return sorted(map(str, out)), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("seed", range(12))
def test_pruned_search_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    spread = [3, 300, 1 << 23, 1 << 40][seed % 4]
    parts = rng.integers(-spread, spread, (300, 4))
    entries = np.concatenate((parts[:20], rng.integers(-spread, spread, (20, 4)), parts[:5]))
    pivots = codes.far_apart(entries, 4)
    far = codes.roots(parts[:, None], pivots[None]).astype(np.float32).astype(np.float64)
    index, error = codes.nearest(parts, far, entries, pivots)
    for x, i, e in zip(parts.tolist(), index.tolist(), error.tolist(), strict=True):
        assert (e, i) == min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(entries.tolist()))


def test_bounds_save_evaluations():
    rng = np.random.default_rng(0)
    parts = np.floor(rng.normal(0, 100, (2000, 4))).astype(np.int64)
    entries = parts[:64]
    pivots = codes.far_apart(entries, codes.PIVOTS)
    counted = []
    codes.nearest(parts, codes.roots(parts[:, None], pivots[None]), entries, pivots, counted)
    assert sum(counted) < 2000 * 64 / 3


def test_given_vectors_equal_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got, books = codes.encode(df.repartition(5))
    want = plain_codes([(r.vec_id, [int(np.floor(256.0 * float(x))) for x in r.embedding]) for r in df.collect()])
    assert sorted(str((r.vec_id, r.code, r.error)) for r in got.collect()) == want[0] and books.digest() == want[1]


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 20).tolist()) for i in range(90)]
    rows += [(50, rows[50][1]), (50, [0.5] * 20), (91, None), (92, [1.0, None]), (93, [float("nan")] * 20), (94, [float("inf")] * 20), (None, [1.0] * 20), (95, []), (96, [2.0]), (97, [1e12, -1e12]), (98, [1e30])]
    df = spark.createDataFrame([(*r, r[0] and r[0] % 3, "mine", "x") for r in rows], "vec_id long, embedding array<double>, label int, code string, vector string")
    largest = (1 << 63) - 1
    part = [(i, [max(-largest - 1, min(largest, int(np.floor(256 * x)))) for x in v]) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    coded, books = codes.encode(df)
    want = plain_codes(part)
    got = codes.with_label_errors(coded).collect()
    assert sorted(str((r.vec_id, r.code, r.error)) for r in got) == want[0] and books.digest() == want[1]
    sums = {}
    for r in got:
        sums[r.label] = min(sums.get(r.label, 0) + r.error, largest)
    assert None in sums and all(r.label_error == sums[r.label] for r in got)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(3, [1.0] * 16, "a"), (1, [2.0] * 16, None), (1, [2.0] * 16, None)], "vec_id long, embedding array<float>, label string")
    coded, books = codes.encode(df)
    assert sorted((r.vec_id, r.code, r.error) for r in coded.collect()) == [(1, "00" * 16, 0), (1, "00" * 16, 0), (3, "02" * 16, 0)]
    assert books.entries.shape == (16, 3, 1)
    none, books = codes.encode(df.where("false"))
    assert books is None and codes.with_label_errors(none).count() == 0
    assert codes.encode(df.withColumn("embedding", F.lit(None).cast("array<float>")))[0].count() == 0
