"""Vector code compression with LAESA pivots.

Vectors of whole numbers, floor(256 * x), are cut into ``PARTS`` equal parts; each part position has a
codebook of at most ``ENTRIES`` entries, at first that part of the vectors with the smallest ids. A
round gives every part the nearest entry (squared Euclidean distance, ties to the lower index) and
moves each entry to the floor of its parts' mean; unused entries stay.

Some first entries of each position, far from each other, are its fixed pivots. The distances of every
part to them are computed once and stored beside it. Each round computes only the distances between
pivots and entries; the largest |part to pivot - entry to pivot| is a lower bound of part to entry. A
part's entries are evaluated, in whole numbers, in the order of these bounds, until the next bound
exceeds the best distance found. Bounds are lowered by more than roots can be off, so no rounding
prunes a tie.

The rows stay where they are: each round reads the stored table and shuffles one sum per task,
position and entry. The driver holds the codebooks and at most ``PARTS * ENTRIES`` sums a round.

Defined cases: vectors that are null or hold a null or non-finite component take no part; shorter ones
end in zeros up to the longest one's length, rounded up to a multiple of ``PARTS``; rows without id or
with a repeated one are encoded each, and first entries are taken by id, nulls last, then by vector;
fewer vectors make fewer entries; columns other than the three named ones are ignored. Components
beyond ``WIDE`` are computed as unbounded whole numbers, exactly; a component beyond a long counts as
the nearest long, an error beyond a long is given as the largest long. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StringType, StructField, StructType

from gleaner.llm.base import stored
from gleaner.llm.topk import takes_part

PARTS = 16
ENTRIES = 64
ROUNDS = 2
PIVOTS = 4
SCALE = 256
# Larger components leave 64-bit arithmetic.
WIDE = 1 << 24
# Entries evaluated between two looks at which parts still compete.
STEP = 4
# How far stored roots (single precision) may be off, with room to spare.
SLACK = 1e-6
LONG_MAX = (1 << 63) - 1
# Rows that a task works on at a time.
CHUNK = 4096

Batches = Iterator[pa.RecordBatch]


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def number_type(*arrays: np.ndarray) -> np.dtype:
    """64-bit numbers where all squared distances fit, else unbounded ones."""
    wide = max(max(int(a.max(initial=0)), -int(a.min(initial=0))) for a in arrays) > WIDE
    return np.dtype(object if wide else np.int64)


def roots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    kind = number_type(a, b)
    return np.sqrt(squares(a.astype(kind), b.astype(kind)).astype(np.float64))


@dataclass(frozen=True)
class Codebooks:
    """Entries and pivots, of shape (positions, entries or pivots, components)."""

    entries: np.ndarray
    pivots: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def far_apart(entries: np.ndarray, n: int) -> np.ndarray:
    """``n`` entries of one position, each with the largest sum of distances to those before it."""
    far = roots(entries[:, None], entries[None])
    chosen = [0]
    while len(chosen) < min(n, len(entries)):
        total = far[chosen].sum(axis=0)
        total[chosen] = -1
        chosen.append(int(np.argmax(total)))
    return entries[chosen]


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray, counted: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of one position; counts exact evaluations.

    ``parts`` is (rows, components), ``to_pivots`` (rows, pivots), ``entries`` (entries, components).
    """
    kind = number_type(parts, entries)
    parts, entries = parts.astype(kind), entries.astype(kind)
    of_entries = roots(entries[:, None], pivots[None])
    bound = np.zeros((len(parts), len(entries)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - of_entries[None, :, p]), out=bound)
    bound -= SLACK * (to_pivots.max(axis=1, initial=0)[:, None] + of_entries.max(initial=0))
    bound = np.square(np.maximum(bound, 0))
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1)
    best = np.zeros(len(parts), dtype=kind)
    index = np.full(len(parts), len(entries))
    alive = np.arange(len(parts))
    for k in range(0, len(entries), STEP):
        if k:
            alive = alive[bound[alive, k] <= best[alive].astype(np.float64) * (1 + SLACK)]
        if not len(alive):
            break
        some = order[alive, k : k + STEP]
        d = squares(parts[alive, None], entries[some])
        if counted is not None:
            counted.append(d.size)
        least = d.min(axis=1)
        at = np.where(d == least[:, None], some, len(entries)).min(axis=1)
        better = (least < best[alive]) | ((least == best[alive]) & (at < index[alive])) if k else np.ones(len(alive), bool)
        best[alive[better]], index[alive[better]] = least[better], at[better]
    return index, best


def chunks(batches: Batches) -> Batches:
    for rb in batches:
        for i in range(0, rb.num_rows, CHUNK):
            yield rb.slice(i, CHUNK)


def cut(rb: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch, all of one length, as (rows, positions, components)."""
    return rb.column("vector").flatten().to_numpy().reshape(rb.num_rows, PARTS, -1)


def with_roots(pivots: np.ndarray):
    """Adds the distances of every part to the pivots of its position."""

    def run(batches: Batches) -> Batches:
        for rb in chunks(batches):
            far = roots(cut(rb)[:, :, None, :], pivots[None]).astype(np.float32)
            ends = np.arange(rb.num_rows + 1, dtype=np.int32) * far[0].size
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*rb.columns, column], names=[*rb.schema.names, "roots"])

    return run


def assign(rb: pa.RecordBatch, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parts, entry of each part, squared distance of each part)."""
    x = cut(rb)
    far = rb.column("roots").flatten().to_numpy().reshape(rb.num_rows, PARTS, -1).astype(np.float64)
    each = [nearest(x[:, p], far[:, p], books.entries[p], books.pivots[p]) for p in range(PARTS)]
    return x, np.stack([e[0] for e in each], axis=1), np.stack([e[1].astype(object) for e in each], axis=1)


SUMS = pa.schema([("position", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])
SUMS_DDL = "position int, entry int, n long, sums array<decimal(38,0)>"


def sums_of(books: Codebooks):
    """A task's number and sum of parts, by position and entry."""

    def run(batches: Batches) -> Batches:
        n = np.zeros(books.entries.shape[:2], dtype=np.int64)
        total = np.zeros(books.entries.shape, dtype=object)
        for rb in chunks(batches):
            x, index, _ = assign(rb, books)
            for p in range(PARTS):
                n[p] += np.bincount(index[:, p], minlength=n.shape[1])
                some = np.zeros(total.shape[1:], dtype=number_type(x))
                np.add.at(some, index[:, p], x[:, p].astype(some.dtype))
                total[p] += some
        at, entry = np.nonzero(n)
        sums = [[Decimal(int(v)) for v in row] for row in total[at, entry]]
        cols = (at, entry, n[at, entry], sums)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SUMS, strict=True)], schema=SUMS)

    return run


def moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round over the stored parts."""
    width = books.entries.shape[2]
    sums = rows.mapInArrow(sums_of(books), SUMS_DDL).groupBy("position", "entry")
    sums = sums.agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    entries = books.entries.copy()
    for r in sums.collect():  # at most PARTS * ENTRIES rows
        entries[r.position, r.entry] = [int(r[f"s{i}"]) // r.n for i in range(width)]
    return replace(books, entries=entries)


def codes_of(books: Codebooks):
    """Hex code and error of every vector."""

    def run(batches: Batches) -> Batches:
        for rb in chunks(batches):
            _, index, error = assign(rb, books)
            code = [bytes(r).hex() for r in index.astype(np.uint8)]
            total = [min(int(e), LONG_MAX) for e in error.sum(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [rb.column("vec_id"), rb.column("label"), pa.array(code, pa.string()), pa.array(total, pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    return run


def whole_numbers(vector: Column, width: int) -> Column:
    """floor(scale * x) of every component, with zeros at the end up to ``width``."""
    numbers = F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(vector))
    return F.concat(numbers, zeros)


def encode(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """((vec_id, label, code, error) of every vector that takes part, final codebooks)."""
    kept = vectors.where(takes_part(F.col(vector)))
    width = kept.agg(F.max(F.size(vector))).first()[0] or 0
    width = max(1, -(-width // PARTS)) * PARTS
    rows = kept.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), whole_numbers(F.col(vector), width).alias("vector"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    coded = StructType([*rows.schema.fields[:2], StructField("code", StringType()), StructField("error", LongType())])
    if not first:
        return rows.sparkSession.createDataFrame([], coded), None
    entries = np.array([r.vector for r in first], dtype=np.int64).reshape(len(first), PARTS, -1).transpose(1, 0, 2)
    books = Codebooks(entries, np.stack([far_apart(e, PIVOTS) for e in entries]))
    with_far = StructType([*rows.schema.fields, StructField("roots", ArrayType(FloatType()))])
    rows = stored(rows.mapInArrow(with_roots(books.pivots), with_far))
    for _ in range(ROUNDS):
        books = moved(rows, books)
    return rows.mapInArrow(codes_of(books), coded), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the sum of the errors of all rows with its label, nulls together."""
    coded = stored(coded)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)"))
    totals = stored(coded.groupBy(F.col("label").alias("_label")).agg(total.cast("long").alias("label_error")))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
