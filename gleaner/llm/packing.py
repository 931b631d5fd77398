"""Packing token sequences: Martello-Toth dominance reduction, then best fit.

Only the counts per piece length decide how to pack, and there are at most ``capacity`` lengths. So
the driver plans on that histogram: it permanently fixes sets of one or two pieces that provably
dominate every other way to fill a bin with the larger piece, shrinks the counts, and packs the
rest best-fit by decreasing length, many equal bins in one step. Every step uses up a length, a
kind of bin or a remainder, so the plan has a few entries per length at any number of documents.
Spark then gives every piece a rank among those of its length and looks its place up in the plan.

Defined cases: a null or empty text is the closing id alone; repeated rows and repeated doc_ids are
packed like any others; a null doc_id is kept; an empty table gives an empty result; texts that need
more than one sequence are cut, no others are. Columns other than the two named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.base import free_names, small_batches, stored

CAPACITY = 2048
END_ID = 0
# Pieces of one length in one window group.
RANK_GROUP = 100_000

Bin = tuple[tuple[int, int], ...]  # (length, how many of it), in the order they lie in
Plan = list[tuple[Bin, int]]  # a way to fill a bin, and how many bins are filled so


def public_tokenizer() -> str:
    """The installed file whose ids the registered queries take."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _words(path: str):
    from gleaner.llm.tokens import WordTokens

    return WordTokens(path)


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids binary"


def token_pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids): every text's ids and ``end_id``, cut at ``capacity``.

    ``ids`` holds little-endian unsigned 32-bit numbers.
    """
    small_batches(docs.sparkSession, "2m")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        for rb in batches:
            out = []
            encoded = words.encode([t or "" for t in rb.column("text").to_pylist()])
            for doc, ids in zip(rb.column("doc_id").to_pylist(), encoded, strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(cut) // 4, cut))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PIECES, strict=True)], schema=PIECES)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, PIECES_DDL)


def _take(counts: dict[int, int], bin_: Bin, times: int, plan: Plan) -> None:
    plan.append((bin_, times))
    for length, n in bin_:
        counts[length] -= n * times
        if not counts[length]:
            del counts[length]


def _smallest(counts: dict[int, int], but: int, n: int) -> list[int]:
    """The n smallest pieces beside one of length ``but``."""
    out: list[int] = []
    for length in sorted(counts):
        out += [length] * min(counts[length] - (length == but), n - len(out))
        if len(out) == n:
            break
    return out


def _best_pair(counts: dict[int, int], but: int, room: int) -> int:
    """Largest sum of two pieces beside one of ``but`` that fits in ``room``; 0 if none does."""
    lengths = [x for x in sorted(counts) if counts[x] > (x == but) and x < room]
    best, i, j = 0, 0, len(lengths) - 1
    while i <= j:
        a, b = lengths[i], lengths[j]
        if a + b > room or (i == j and counts[a] - (a == but) < 2):
            j -= 1
        else:
            best = max(best, a + b)
            i += 1
    return best


def dominating(counts: dict[int, int], x: int, capacity: int) -> Bin | None:
    """A set with a piece of length ``x`` that dominates all others with one, else None.

    A set dominates another if the pieces of the other can take the places of its own. So {x} does
    if nothing fits beside x. {x, y} with the largest y that fits does if y fills the bin, or if at
    most two pieces fit beside x and no two of them exceed y together.
    """
    room = capacity - x
    fits = [y for y in counts if y <= room and counts[y] > (y == x)]
    if not fits:
        return ((x, 1),)
    y = max(fits)
    pair = ((x, 2),) if x == y else ((x, 1), (y, 1))
    if y == room:
        return pair
    three = _smallest(counts, x, 3)
    if (len(three) < 3 or sum(three) > room) and _best_pair(counts, x, room) <= y:
        return pair
    return None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> Plan:
    """Fix dominating sets until there are none; ``counts`` keeps what is left."""
    plan: Plan = []
    changed = True
    while changed:
        changed = False
        for x in sorted(counts, reverse=True):
            # a set stays dominating while its pieces last and others only get fewer
            while x in counts and (found := dominating(counts, x, capacity)) is not None:
                _take(counts, found, min(counts[length] // n for length, n in found), plan)
                changed = True
    return plan


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit by decreasing length, over groups of equally filled bins."""
    by_room: dict[int, dict[Bin, int]] = {}

    def put(bin_: Bin, room: int, n: int) -> None:
        if n:
            group = by_room.setdefault(room, {})
            group[bin_] = group.get(bin_, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in by_room if r >= length), default=capacity)
            each = room // length
            if room in by_room:
                bin_, bins = by_room[room].popitem()
                if not by_room[room]:
                    del by_room[room]
            else:
                bin_, bins = (), -(-left // each)
            full = min(bins, left // each)
            put((*bin_, (length, each)), room - each * length, full)
            left -= full * each
            if full < bins:
                if left:  # fewer than a bin takes
                    put((*bin_, (length, left)), room - left * length, 1)
                    put(bin_, room, bins - full - 1 if bin_ else 0)
                    left = 0
                elif bin_:
                    put(bin_, room, bins - full)
    return [(b, n) for group in by_room.values() for b, n in group.items()]


def pack_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    counts = {k: v for k, v in counts.items() if v}
    if counts and (min(counts) < 1 or max(counts) > capacity):
        raise ValueError("lengths must lie between 1 and the capacity")
    return reduce_by_dominance(counts, capacity) + best_fit(counts, capacity)


def places(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end of ranks, first sequence, offset, pieces per sequence)."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for bin_, n in plan:
        offset = 0
        for length, each in bin_:
            lo = used.get(length, 0)
            used[length] = lo + each * n
            out.append((length, lo, lo + each * n, sequence, offset, each))
            offset += each * length
        sequence += n
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``capacity``) and their sequence_id and offset.

    Pass a stored table: it is read more than once.
    """
    spark = pieces.sparkSession
    # at most one row per length
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    listed = places(pack_plan(counts, capacity))
    names = free_names(pieces, "for_length", "lo", "hi", "first", "at", "each", "part", "rank", "before")
    for_length, lo, hi, first, at, each, part, rank, before = names
    plan = spark.createDataFrame(listed, ", ".join(f"{c} long" for c in names[:6]))
    spread = -(-max(counts.values(), default=1) // RANK_GROUP)
    dealt = pieces.withColumn(part, F.pmod(F.xxhash64(*key), F.lit(spread)))
    parts = dealt.groupBy("length", part).agg(F.count("*").alias(rank))
    earlier = Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("length", part, F.coalesce(F.sum(rank).over(earlier), F.lit(0)).alias(before))
    inside = Window.partitionBy("length", part).orderBy(*key)
    ranked = dealt.withColumn(rank, F.row_number().over(inside)).join(parts, ["length", part])
    ranked = ranked.withColumn(rank, F.col(rank) - 1 + F.col(before))
    # the plan has a few rows per length, whatever the number of pieces
    found = ranked.join(
        F.broadcast(plan),
        (F.col("length") == F.col(for_length)) & (F.col(rank) >= F.col(lo)) & (F.col(rank) < F.col(hi)),
    )
    place = F.col(rank) - F.col(lo)
    nth = F.pmod(place, F.col(each))
    return found.select(
        *pieces.columns,
        (F.col(first) + (place - nth) / F.col(each)).cast("long").alias("sequence_id"),
        (F.col(at) + nth * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), with ``ids`` if asked for."""
    pieces = token_pieces(docs, tokenizer, doc_id, text, capacity).withColumn("ids_crc32", F.crc32("ids"))
    return pack(stored(pieces if keep_ids else pieces.drop("ids")), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_starts): the sequences themselves, from ``pack_documents(keep_ids=True)``.

    A group holds at most ``capacity`` ids.
    """
    part = F.struct("offset", "ids")
    got = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return got.select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: p["offset"]).alias("doc_starts"),
    )
