"""Exact top-k by integer inner product with MaxScore.

The terms of a query are its non-zero components; a term's postings are that component of every
vector of a shard, its score bound comes from the shard's smallest and largest value. Per query and
shard, terms are split into essential ones and the rest, whose bounds together cannot reach the
k-th best score so far. The postings of essential terms are traversed for all vectors; the others
are probed, largest bound first, only for vectors that can still compete. The k best of every
shard are merged.

The query set meets all rows in blocks: vectors are dealt into shards and queries into blocks by
the hash of their id, and every (shard, block) pair is one row of an equi-join. Nothing is
broadcast; the driver sees two counts.

Defined cases: vectors that are null or hold a null or non-finite component, and rows without id,
take no part; shorter vectors end in zeros; rows with one id and other vectors are
candidates each, and queries whose scores are ranked together; rows that repeat both count once;
ties go to the smaller id; a query's own id is no candidate; fewer than k candidates are all
returned. Columns other than the two named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.base import shards as shard_count
from gleaner.llm.base import stored

K = 5
SHARD = 4096
BLOCK = 1024
# Vectors scored in full first, so that there is a score to beat.
SEEDS = 64
# Terms probed between two looks at who still competes.
STEP = 8


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as longs."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def takes_part(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def matrix(vectors: list) -> np.ndarray:
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


PACKED = "part int, n int, ids binary, vectors binary"


def pack(key: int, frame: pd.DataFrame) -> pd.DataFrame:
    """One row for the vectors of a shard or block, each (id, vector) once."""
    x, ids = matrix(list(frame["vector"])), frame["vec_id"].to_numpy(dtype=np.int64)
    order = np.lexsort((*x.T[::-1], ids))
    ids_, x_ = ids[order], x[order]
    first = np.append(True, (ids_[1:] != ids_[:-1]) | (x_[1:] != x_[:-1]).any(axis=1))
    kept = order[first]
    return pd.DataFrame({"part": [key], "n": [len(kept)], "ids": [ids[kept].tobytes()], "vectors": [x[kept].tobytes()]})


def packed(vectors: DataFrame, parts: int) -> DataFrame:
    """(part, n, ids, vectors); a part's size is set by the number of parts."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pack(key[0], frame)

    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    return vectors.withColumn("_part", part).groupBy("_part").applyInPandas(run, PACKED)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        enough = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= enough)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


class Shard:
    """Vectors by component, with the bounds of every component."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids = ids
        # whole numbers below 2**53 are exact as doubles, and far faster to multiply
        self.x = x.T
        self.low, self.high = x.min(axis=0), x.max(axis=0)

    def top(self, query_id: int, q: np.ndarray, k: int, probed: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors but ``query_id``; counts probed components."""
        width = min(len(q), len(self.x))
        a, b = q[:width] * self.low[:width], q[:width] * self.high[:width]
        upper, lower = np.maximum(a, b), np.minimum(a, b)
        terms = np.flatnonzero(q[:width])
        terms = terms[np.argsort((lower - upper)[terms], kind="stable")]
        x, q = self.x[terms], q[terms]
        others = np.flatnonzero(self.ids != query_id)
        seeds = others[:SEEDS]
        scores = q @ x[:, seeds]
        top = best(scores, self.ids[seeds], k)
        found, found_scores = seeds[top], scores[top]
        alive = others[SEEDS:]
        # rest[i]: what terms from i on can add at most
        rest = np.append(np.cumsum(upper[terms][::-1])[::-1], 0)
        beat = found_scores[-1] if len(found) == k else None
        if beat is None:
            essential = len(terms)
        else:
            # the least any vector gets from the terms before i, and the most from those after
            least = np.append(0, np.cumsum(lower[terms]))
            can = least + rest >= beat
            essential = int(np.flatnonzero(~can)[0]) if (~can).any() else len(terms)
            essential = min(len(terms), max(essential, STEP))
        at = essential
        partial = q[:at] @ x[:at, alive]
        while beat is not None and at < len(terms) and len(alive):
            competes = partial + rest[at] >= beat
            alive, partial = alive[competes], partial[competes]
            to = min(len(terms), at + STEP)
            partial = partial + q[at:to] @ x[at:to, alive]
            if probed is not None:
                probed.append((to - at) * len(alive))
            at = to
        found, found_scores = np.append(found, alive), np.append(found_scores, partial)
        top = best(found_scores, self.ids[found], k)
        return self.ids[found[top]], found_scores[top]


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def exact_type(*matrices: np.ndarray) -> np.dtype:
    """Doubles where every inner product is a whole number below 2**53, else 64-bit integers."""
    limit = max(m.shape[1] for m in matrices)
    for m in matrices:
        limit *= int(np.abs(m).max(initial=1))
    return np.dtype(np.float64 if limit < 1 << 53 else np.int64)


def search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for row in rb.to_pylist():
                ids, qids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                x = np.frombuffer(row["vectors"], np.int64).reshape(row["n"], -1)
                q = np.frombuffer(row["q_vectors"], np.int64).reshape(row["q_n"], -1)
                kind = exact_type(x, q)
                shard = Shard(ids, x.astype(kind))
                out = [(i, *shard.top(i, v, k)) for i, v in zip(qids.tolist(), q.astype(kind), strict=True)]
                cols = (
                    np.repeat(qids, [len(o[1]) for o in out]),
                    np.concatenate([o[1] for o in out]),
                    np.concatenate([o[2] for o in out]).astype(np.int64),
                )
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=FOUND)

    return run


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, per_shard: int = SHARD, per_block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every query."""
    v = F.col(vector)
    rows = vectors.where(F.col(vec_id).isNotNull() & takes_part(v)).select(
        F.col(vec_id).cast("long").alias("vec_id"), quantised(v).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    n, n_queries = rows.agg(F.count("*"), F.count_if("q")).first()
    n_shards, n_blocks = shard_count(n, per_shard), shard_count(n_queries, per_block)
    everything = stored(packed(rows.select("vec_id", "vector"), n_shards))
    asked = stored(packed(rows.where("q").select("vec_id", "vector"), n_blocks))
    left = everything.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = asked.select(
        F.col("part").alias("block"), F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"),
        F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("part"),
    )
    pairs = left.join(right.hint("shuffle_hash"), ["part", "block"])
    found = pairs.mapInArrow(search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
