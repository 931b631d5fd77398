"""SimHash near-duplicates by covering locality-sensitive hashing.

Each text becomes a 64-bit fingerprint. Texts whose fingerprints differ in at most ``radius`` bits
are linked; groups are the connected components.

Covering: bit i gets a vector m(i) of radius + 1 bits. Table v, for every non-zero vector v, keeps
the bits whose m(i) has an odd product with v. Any ``radius`` vectors m(i) leave some v that is
orthogonal to all of them, so in table v two fingerprints that differ in these bits only have the
same key: every pair within the radius meets in at least one table.

Defined cases: null and empty texts and texts of white space have fingerprint zero and link like
any other; equal texts share a fingerprint; a row without doc_id gets its fingerprint, links
nothing and has a null component; rows that repeat a doc_id are one node per fingerprint. Columns
other than the two named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.base import free_names, numbered, small_batches, stored
from gleaner.llm.graph import components
from gleaner.operators.keyed import spread_join

SEED = 42
SHINGLE = 4
RADIUS = 4
# A bucket of more fingerprints than this is dealt out again by a second covering.
HOT_BUCKET = 20_000
# Up to this size all pairs of a bucket are compared at once; larger ones are searched from seeds.
TINY = 6


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of one text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[-n:].tolist()
    hashes = [hash64(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 14):
        part = np.array(hashes[i : i + (1 << 14)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        values = np.array([text_fingerprint(t, shingle) for t in texts], dtype=np.uint64)
        return pd.Series(values.view(np.int64))

    return of(text)


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def cover_masks(radius: int, vectors: list[int]) -> list[int]:
    """One 64-bit mask per table; ``vectors[i]`` is m(i), a number of radius + 1 bits."""
    return [
        sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        for v in range(1, 1 << (radius + 1))
    ]


def first_vectors(radius: int) -> list[int]:
    return [i % ((1 << (radius + 1)) - 1) + 1 for i in range(64)]


def second_vectors(radius: int) -> list[int]:
    """Independent of the first ones, so that two masks together keep most bits."""
    return [int(x) for x in np.random.default_rng(SEED).integers(1, 1 << (radius + 1), 64)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tables(df: DataFrame, masks: list[int], more: Iterable[str] = ()) -> DataFrame:
    """Every row once per table, with the table's number and key."""
    listed = F.array(*[F.lit(signed(m)) for m in masks])
    return df.select(*more, "fp", "rep", F.posexplode(listed).alias("t", "mask")).select(
        *more, "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "rep"
    )


def spanning_links(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs that join exactly what all pairs within the radius would join."""
    left, right = [], []
    rest = np.arange(len(fp))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            q = queue.pop()
            near = np.bitwise_count(fp[rest] ^ fp[q]) <= radius
            if near.any():
                hits = rest[near]
                left.append(np.full(len(hits), q))
                right.append(hits)
                queue.extend(hits)
                rest = rest[~near]
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


OUT = pa.schema([("hot", pa.bool_()), ("t", pa.int32()), ("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def link_buckets(keys: list[str], radius: int, limit: int | None):
    """A function over partitions sorted by ``keys``: links inside each bucket, as pairs of reps.

    Buckets of more than ``limit`` rows come out as they are (hot) for a finer covering.
    """

    def links(names: list[np.ndarray], fp: np.ndarray, rep: np.ndarray) -> Iterator[pa.RecordBatch]:
        fp = fp.view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
        new = np.zeros(len(fp), dtype=bool)
        new[0] = True
        for k in names:
            new[1:] |= k[1:] != k[:-1]
        group = np.cumsum(new)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(fp)))
        size_of = sizes[group - 1]
        a, b = [], []
        for d in range(1, TINY):
            i = np.flatnonzero((group[d:] == group[:-d]) & (size_of[d:] <= TINY))
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
            a.append(rep[i])
            b.append(rep[i + d])
        for g in np.flatnonzero(sizes > TINY):
            s = slice(starts[g], starts[g] + sizes[g])
            i, j = spanning_links(fp[s], radius)
            a.append(rep[s][i])
            b.append(rep[s][j])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        n = len(pairs)
        yield batch(np.zeros(n, bool), np.zeros(n, np.int32), np.zeros(n, np.int64), pairs[:, 0], pairs[:, 1])

    def batch(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, OUT, strict=True)], schema=OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        hot: tuple | None = None
        for rb in batches:
            if not rb.num_rows:
                continue
            cols = [rb.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "fp", "rep")]
            if hot is not None:
                same = np.logical_and.reduce([c == k for c, k in zip(cols, hot, strict=False)])
                n = int(same.sum())
                yield batch(np.ones(n, bool), cols[0][:n].astype(np.int32), cols[1][:n], cols[-2][:n], cols[-1][:n])
                cols = [c[n:] for c in cols]
                if not len(cols[0]):
                    continue
                hot = None
            if held:
                cols = [np.concatenate(p) for p in zip(held, cols, strict=True)]
            # the last bucket may go on in the next batch
            last = np.logical_and.reduce([c == c[-1] for c in cols[: len(keys)]])
            cut = len(last) - int(last.sum())
            if cut:
                yield from links([c[:cut] for c in cols[: len(keys)]], cols[-2][:cut], cols[-1][:cut])
            held = [c[cut:] for c in cols]
            if limit and len(held[0]) > limit:
                n = len(held[0])
                yield batch(np.ones(n, bool), held[0].astype(np.int32), held[1], held[-2], held[-1])
                hot, held = tuple(c[0] for c in held[: len(keys)]), []
        if held:
            yield from links(held[: len(keys)], held[-2], held[-1])

    return run


def near_links(reps: DataFrame, radius: int = RADIUS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Pairs (a, b) of ``rep`` that connect all fingerprints within ``radius`` bits.

    ``reps`` has one row per distinct ``fp`` with its node ``rep``. A hot bucket is dealt out by a
    second covering: a pair that meets in the bucket meets in one of its parts too. Both masks
    together leave few free bits, so a part holds few distinct fingerprints by construction.
    """
    kind = "hot boolean, t int, key long, a long, b long"
    keyed = tables(reps, cover_masks(radius, first_vectors(radius)))
    first = stored(
        keyed.repartition("t", "key")
        .sortWithinPartitions("t", "key")
        .mapInArrow(link_buckets(["t", "key"], radius, hot_bucket), kind)
    )
    hot = first.where("hot").select(F.col("t").alias("t1"), F.col("key").alias("k1"), F.col("a").alias("fp"), F.col("b").alias("rep"))
    finer = tables(hot, cover_masks(radius, second_vectors(radius)), ["t1", "k1"])
    second = (
        finer.repartition("t1", "k1", "t", "key")
        .sortWithinPartitions("t1", "k1", "t", "key")
        .mapInArrow(link_buckets(["t1", "k1", "t", "key"], radius, None), kind)
    )
    return first.where("NOT hot").select("a", "b").unionByName(second.select("a", "b"))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links lead to, itself included."""
    small_batches(docs.sparkSession)
    marked = stored(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp")))
    reps = stored(
        marked.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    )
    roots = components(near_links(reps, radius), "a", "b")
    groups = reps.join(roots, reps["rep"] == roots["node"], "left").select(
        "fp", "n", F.coalesce("root", "rep").alias("component_id")
    )
    n_docs = reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = spread_join(marked.where("doc_id IS NOT NULL"), groups, "fp", "n", "doc_id", n_docs)
    alone = marked.where("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("long"))
    return known.select("doc_id", "fp", "component_id").unionByName(alone)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Rows of ``docs`` without near-duplicates: of each group the row with the smallest doc_id.

    Texts that share a doc_id are documents of their own, the smaller text first; of rows that repeat
    doc_id and text one stays; rows without doc_id stay.
    """
    kept_id, nth, number = free_names(docs, "kept_id", "nth", "number_")
    known = numbered(docs.where(F.col(doc_id).isNotNull()), doc_id, text, number, 0)
    groups = near_groups(known, number, text, radius)
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias(kept_id)).distinct()
    kept = known.join(first, F.col(number) == F.col(kept_id), "left_semi")
    order = Window.partitionBy(number).orderBy(F.col(text).asc_nulls_first())
    kept = kept.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(*docs.columns)
    return kept.unionByName(docs.where(F.col(doc_id).isNull()))
