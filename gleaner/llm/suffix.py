"""Repeated byte strings by a depth-limited radix sort of suffixes.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts earlier (in a document with
a smaller id, or further left in the same one). Suffixes are ordered through ``WINDOW`` bytes only,
most significant digit first; at that depth equal groups are exactly the repeated windows. A digit
is a hashed run of bytes, so that groups, not their order, come out.

* Every window holds one anchor: its first ``DIGIT``-byte run with the smallest hash. Equal windows
  have equal anchors, so only anchors (about one byte in 35) need sorting.
* Digit 1 is the anchor's run. Groups of one are done: no window at that anchor occurs twice.
* Digit 2 is the anchor's context: the bytes of every window that could hold it. All of an equal
  group but the first are covered over their whole context.
* Digit 3 is the window itself. It is needed only for the first of each context, and only where a
  run occurs in different contexts, such as at the edges of a shared passage. There the contexts
  are sent once, and the windows in them are sorted where the contexts of one run meet.

Each pass keeps the first of equal entries inside a task before the shuffle, so of a passage found in
a third of all documents one entry per task meets the others; the rest is covered already and dealt by
document. A run that meets very many contexts in one task
is hot: its contexts are dealt out by context, and its windows one by one by their own hash, so no
task gets all of them. Equality is that of two 64-bit hashes together.

Defined cases: a null text is empty; texts under ``WINDOW`` bytes lose nothing; texts that share a
doc_id are documents in the order of their texts, rows with equal ones are one; rows without doc_id
are documents before all others, each of its own (``without_repeats`` counts a repeated or null id
once, with its smallest text, unless it is told ``each_text``); columns other than the two named ones
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.base import numbered, release, small_batches, stored

WINDOW = 100
DIGIT = 32
# Bytes of context before and after the start of an anchor.
BEFORE, AFTER = WINDOW - DIGIT, WINDOW
# Empty bytes between the texts of a block, so that no run or context reaches the next text.
PAD = WINDOW
# Longer texts are hashed in pieces of so many window starts.
PIECE = 1 << 20
# Anchors or windows that a task holds before it sends them.
FLUSH = 300_000
# Contexts of one run in one task from which they are dealt out by context.
HOT_RUN = 64
# Contexts of one run that may meet in one task.
HOT_MEET = 5_000
# Text bytes for each bucket of the sort.
PER_BUCKET = 16_000_000
NO_ID = -(1 << 63)

U64 = np.uint64
# Odd multipliers for mixing; any odd numbers do.
ODD = [U64(2 * int(x) + 1) for x in np.random.default_rng(10).integers(1 << 61, 1 << 63, 24, dtype=np.uint64)]


def mix(x: np.ndarray, k: int) -> np.ndarray:
    x = x * ODD[k]
    x ^= x >> U64(29)
    return x


def run_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the ``DIGIT`` bytes from each position on, along the last axis."""
    h = ODD[0] * (raw.astype(U64) + U64(1))
    step, k = 1, 1
    while step < DIGIT:  # ever longer runs by doubling
        h = mix(h[..., :-step] + h[..., step:] * ODD[k], k + 8)
        step, k = 2 * step, k + 1
    return h


def window_hashes(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash of windows, from the hashes of the four runs that cover them."""
    a = np.zeros(len(runs[0]), dtype=U64)
    b = np.zeros(len(runs[0]), dtype=U64)
    for k, r in enumerate(runs):
        a = mix(a + r * ODD[k + 1], k + 12)
        b = mix(b ^ (r * ODD[k + 6]), k + 3)
    return a, b


RUNS_OF_WINDOW = (0, DIGIT, 2 * DIGIT, WINDOW - DIGIT)


class Block:
    """Texts in one padded byte array, with the hash of every run and the anchor of every window.

    A part is a piece of a text: the windows that start in it, with all bytes their contexts need.
    """

    def __init__(self, texts: list[bytes]) -> None:
        parts = []  # text number, first window, windows
        for i, t in enumerate(texts):
            n = len(t) - WINDOW + 1
            parts += [(i, s, min(PIECE, n - s)) for s in range(0, n, PIECE)]
        whole = np.array(parts, dtype=np.int64).reshape(-1, 3)
        self.text, self.first, self.count = whole.T
        self.size = np.array([len(t) for t in texts], dtype=np.int64)[self.text]
        self.low = np.maximum(self.first - BEFORE, 0)
        high = np.minimum(self.first + self.count + BEFORE + AFTER + BEFORE, self.size)
        lengths = high - self.low
        self.place = np.concatenate(([0], np.cumsum(lengths + PAD)))[:-1] + PAD
        raw = np.zeros(PAD + int((lengths + PAD).sum()) + DIGIT, dtype=np.uint8)
        for i, lo, n, at in zip(self.text.tolist(), self.low.tolist(), lengths.tolist(), self.place.tolist(), strict=True):
            raw[at : at + n] = np.frombuffer(texts[i], dtype=np.uint8, count=n, offset=lo)
        self.raw = raw
        self.runs = run_hashes(raw)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the start, place of the anchor, part) of every window."""
        part = np.repeat(np.arange(len(self.count)), self.count)
        if not len(part):
            return part, part, part
        before = np.concatenate(([0], np.cumsum(self.count)))[:-1]
        start = np.arange(len(part)) - before[part] + (self.place + self.first - self.low)[part]
        # smallest hash of the runs in a window, the leftmost of equal ones
        key = (mix(self.runs, 20) & ~U64((1 << 32) - 1)) | np.arange(len(self.runs), dtype=U64)
        span, width = 1, WINDOW - DIGIT + 1
        while 2 * span <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        rest = width - span
        key = np.minimum(key[: len(key) - rest], key[rest:])
        return start, (key[start] & U64((1 << 32) - 1)).astype(np.int64), part

    def offset(self, place: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Position in the text."""
        return place - self.place[part] + self.low[part]

    def context(self, anchor: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Hash of the bytes of all windows that can hold an anchor, cut at the text's ends."""
        at = self.offset(anchor, part)
        left = np.minimum(BEFORE, at)
        right = np.minimum(AFTER, self.size[part] - at)
        out = mix((left * 1000 + right).astype(U64), 9)
        for k, d in enumerate((-BEFORE, -BEFORE + DIGIT, -BEFORE + 2 * DIGIT, 28, 60, AFTER - DIGIT)):
            out = mix(out + self.runs[anchor + d] * ODD[k + 1], k + 10)
        return out

    def window(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return window_hashes([self.runs[start + d] for d in RUNS_OF_WINDOW])

    def context_bytes(self, anchor: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The context of each anchor and, as a last byte, how much of the text follows its start."""
        view = np.lib.stride_tricks.sliding_window_view(self.raw, BEFORE + AFTER)
        right = np.minimum(AFTER, self.size[part] - self.offset(anchor, part)).astype(np.uint8)
        return np.ascontiguousarray(np.concatenate((view[anchor - BEFORE], right[:, None]), axis=1)).view(CONTEXT_BYTES)[:, 0]


# One entry of a sort: two hashes, the document and the place in it.
Entries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
CONTEXT_BYTES = np.dtype(f"V{BEFORE + AFTER + 1}")
TYPES = (np.dtype("<u8"), np.dtype("<u8"), np.dtype("<i8"), np.dtype("<i4"))
CONTEXT_TYPES = (TYPES[0], CONTEXT_BYTES, TYPES[2], TYPES[3])
PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *[(c, pa.binary()) for c in "abdp"]])
PACKED_DDL = "bucket int, kind int, a binary, b binary, d binary, p binary"
# Kinds of packed entries: to be sorted; of a hot run; news for its bucket that a run is hot; known
# to be covered; contexts whose windows are to be sorted.
SORT, HOT, HOT_NEWS, COVERED, CONTEXT = range(5)
MARKS = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
MARKS_DDL = "kind int, doc long, lo int, hi int"
# Kinds of marks: bytes lo to hi are covered; anchors (lo) whose windows are to be sorted, where
# contexts meet or, for hot runs, one by one.
COVER, MEET, SINGLE = range(3)


def in_order(e: Entries) -> Entries:
    o = np.lexsort((e[3], e[2], e[1], e[0]))
    return tuple(c[o] for c in e)


def equal_before(*columns: np.ndarray) -> np.ndarray:
    """For each row of sorted columns: is the row before it equal?"""
    out = np.zeros(len(columns[0]), dtype=bool)
    if len(out):
        out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return out


def later_copies(e: Entries) -> np.ndarray:
    """For sorted entries: does an equal string start earlier? One place listed twice is one place."""
    equal = equal_before(e[0], e[1])
    first = np.maximum.accumulate(np.where(equal, 0, np.arange(len(equal))))
    return equal & ((e[2] != e[2][first]) | (e[3] != e[3][first]))


def packed(e: Entries, kind: int, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per bucket with all its entries; those that are covered already need no hashes."""
    if kind == COVERED:
        e = (np.empty((len(bucket), 0), dtype=np.uint8),) * 2 + e[2:]
    if not len(bucket):
        return
    o = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[o])) + 1
    ends = np.append(cuts, len(o))
    starts = np.concatenate(([0], cuts))
    cols = [c[o] for c in e]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[o][starts], pa.int32()),
            pa.array(np.full(len(starts), kind), pa.int32()),
            *[pa.array([c[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()) for c in cols],
        ],
        schema=PACKED,
    )


def dealt(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U64(33)) % U64(buckets)).astype(np.int64)


def by_doc(doc: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of entries that need not meet others: copies of one passage are spread by document."""
    return dealt(mix(doc.astype(U64), 2), buckets)


def send_anchors(e: Entries, buckets: int) -> Iterator[pa.RecordBatch]:
    """Pack a task's anchors: one per context, the rest is covered already."""
    e = in_order(e)
    late = later_copies(e)
    yield from packed(tuple(c[late] for c in e), COVERED, by_doc(e[2][late], buckets))
    e = tuple(c[~late] for c in e)
    again = equal_before(e[0])
    group = np.cumsum(~again) - 1
    hot = (np.bincount(group) > HOT_RUN)[group] if len(group) else np.zeros(0, dtype=bool)
    for kind, some, h in ((HOT, hot, e[1]), (HOT_NEWS, hot & ~again, e[0]), (SORT, ~hot, e[0])):
        yield from packed(tuple(c[some] for c in e), kind, dealt(h[some], buckets))


def send_windows(e: Entries, buckets: int) -> Iterator[pa.RecordBatch]:
    e = in_order(e)
    late = later_copies(e)
    yield from packed(tuple(c[late] for c in e), COVERED, by_doc(e[2][late], buckets))
    yield from packed(tuple(c[~late] for c in e), SORT, dealt(e[0][~late], buckets))


def send_contexts(e: Entries, buckets: int) -> Iterator[pa.RecordBatch]:
    yield from packed(e, CONTEXT, dealt(e[0], buckets))


def blocks(rb: pa.RecordBatch) -> Iterator[tuple[int, int, Block]]:
    """Row ranges of a batch and their texts."""
    texts = [t.encode("utf-8", "surrogatepass") for t in rb.column("text").to_pylist()]
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) <= PIECE):
            total += len(texts[j])
            j += 1
        yield i, j, Block(texts[i:j])
        i = j


class Held:
    """Entries of a task, sent on when there are ``FLUSH`` of them."""

    def __init__(self, send, buckets: int) -> None:
        self.send, self.buckets, self.parts, self.n = send, buckets, [], 0

    def add(self, e: Entries, weight: int = 1) -> Iterator[pa.RecordBatch]:
        self.parts.append(e)
        self.n += weight * len(e[0])
        if self.n >= FLUSH:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            parts, self.parts, self.n = self.parts, [], 0
            yield from self.send(tuple(map(np.concatenate, zip(*parts, strict=True))), self.buckets)


def anchor_entries(buckets: int):
    """All anchors of every partition, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(send_anchors, buckets)
        for rb in batches:
            ids = rb.column("doc").to_numpy(zero_copy_only=False)
            for i, j, block in blocks(rb):
                _, anchor, part = block.windows()
                new = ~equal_before(anchor, part)
                anchor, part = anchor[new], part[new]
                doc = ids[i:j][block.text[part]].astype(np.int64)
                pos = block.offset(anchor, part).astype(np.int32)
                yield from held.add((block.runs[anchor], block.context(anchor, part), doc, pos))
        yield from held.rest()

    return run


def window_entries(buckets: int):
    """Contexts of the anchors in ``meet`` and windows of those in ``single``, packed by bucket."""

    def chosen(rb: pa.RecordBatch, column: str, i: int, j: int, block: Block, anchor: np.ndarray, part: np.ndarray) -> np.ndarray:
        lists = rb.column(column).slice(i, j - i)
        row = np.repeat(np.arange(j - i), pa.compute.list_value_length(lists).fill_null(0).to_numpy())
        pos = lists.flatten().to_numpy().astype(np.int64)
        return np.isin((block.text[part] << 32) | block.offset(anchor, part), (row << 32) | pos)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, singles = Held(send_contexts, buckets), Held(send_windows, buckets)
        for rb in batches:
            ids = rb.column("doc").to_numpy(zero_copy_only=False)
            for i, j, block in blocks(rb):
                start, anchor, part = block.windows()

                def of(place: np.ndarray, p: np.ndarray, ids=ids, i=i, j=j, block=block) -> tuple[np.ndarray, np.ndarray]:
                    return ids[i:j][block.text[p]].astype(np.int64), block.offset(place, p).astype(np.int32)

                one = np.flatnonzero(chosen(rb, "single", i, j, block, anchor, part))
                a, b = block.window(start[one])
                yield from singles.add((a, b, *of(start[one], part[one])))
                new = np.flatnonzero(~equal_before(anchor, part))
                new = new[chosen(rb, "meet", i, j, block, anchor[new], part[new])]
                at, p = anchor[new], part[new]
                yield from contexts.add((block.runs[at], block.context_bytes(at, p), *of(at, p)), weight=8)
        yield from singles.rest()
        yield from contexts.rest()

    return run


def marks(kind: int, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    cols = (np.full(len(doc), kind), doc, np.maximum(lo, 0), hi)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, MARKS, strict=True)], schema=MARKS)


def around(kind: int, e: Entries) -> pa.RecordBatch:
    """Marks of anchors: their contexts if covered, else their places."""
    cover = kind == COVER
    return marks(kind, e[2], e[3] - (BEFORE if cover else 0), e[3] + (AFTER if cover else 0))


def of_kind(t: pa.Table, kind: int, types: tuple[np.dtype, ...] = TYPES) -> Entries:
    part = t.filter(pa.compute.equal(t["kind"], kind))
    return tuple(np.frombuffer(b"".join(part[c].to_pylist()), dtype=d) for c, d in zip("abdp", types, strict=True))


def several(h: np.ndarray) -> np.ndarray:
    """Positions of values that occur more than once."""
    o = np.argsort(h)
    same = equal_before(h[o])
    return o[same | np.append(same[1:], False)] if len(o) else o


def sort_anchors(t: pa.Table) -> pa.Table:
    """Marks of one bucket of anchors."""
    out = [around(COVER, of_kind(t, COVERED))]
    e = in_order(of_kind(t, HOT))
    late = later_copies(e)
    out += [around(COVER, tuple(c[late] for c in e)), around(SINGLE, tuple(c[~late] for c in e))]
    news = np.unique(of_kind(t, HOT_NEWS)[0])
    e = of_kind(t, SORT)
    some = np.zeros(len(e[0]), dtype=bool)
    some[several(e[0])] = True  # first digit: groups of one are done, but for those hot elsewhere
    some |= np.isin(e[0], news)
    e = in_order(tuple(c[some] for c in e))
    late = later_copies(e)
    out.append(around(COVER, tuple(c[late] for c in e)))
    group = np.cumsum(~equal_before(e[0])) - 1
    contexts = np.bincount(group, weights=~equal_before(e[0], e[1]))[group] if len(group) else group
    hot = np.isin(e[0], news) | (contexts > HOT_MEET)
    out.append(around(SINGLE, tuple(c[~late & hot] for c in e)))
    out.append(around(MEET, tuple(c[~late & ~hot & (contexts > 1)] for c in e)))
    return pa.Table.from_batches(out, schema=MARKS)


def sort_windows(t: pa.Table) -> pa.Table:
    """Marks of one bucket of contexts and single windows."""

    def windows(e: Entries) -> pa.RecordBatch:
        return marks(COVER, e[2], e[3], e[3] + WINDOW)

    out = [windows(of_kind(t, COVERED))]
    e = of_kind(t, SORT)
    e = in_order(tuple(c[several(e[0])] for c in e))
    late = later_copies(e)
    out.append(windows(tuple(c[late] for c in e)))
    run, raw, doc, pos = of_kind(t, CONTEXT, CONTEXT_TYPES)
    order = np.argsort(run, kind="stable")
    for some in np.split(order, meeting_cuts(run[order])):
        out.append(sort_contexts(raw[some], doc[some], pos[some].astype(np.int64)))
    return pa.Table.from_batches(out, schema=MARKS)


def meeting_cuts(run: np.ndarray, size: int = 20_000) -> np.ndarray:
    """Where to cut sorted runs into parts of about ``size`` without parting equal ones."""
    starts = np.flatnonzero(~equal_before(run))
    return starts[np.flatnonzero(np.diff(starts // size)) + 1] if len(starts) else starts


def sort_contexts(raw: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Marks of the windows in contexts, each as long as consecutive windows are covered."""
    n = len(raw)
    data = np.frombuffer(raw.tobytes(), dtype=np.uint8).reshape(n, CONTEXT_BYTES.itemsize)
    runs, right = run_hashes(data[:, :-1]), data[:, -1].astype(np.int64)
    covered = np.zeros((n, BEFORE + 2), dtype=bool)
    for o in range(BEFORE + 1):
        inside = np.flatnonzero((pos - BEFORE + o >= 0) & (o + DIGIT <= right))
        a, b = window_hashes([runs[inside, o + d] for d in RUNS_OF_WINDOW])
        again = several(a)
        at = inside[again]
        order = np.lexsort((pos[at], doc[at], b[again], a[again]))
        at, again = at[order], again[order]
        covered[at[later_copies((a[again], b[again], doc[at], pos[at]))], o + 1] = True
    # runs of covered windows: where a column begins to be covered and where it ends
    edge = np.diff(covered.astype(np.int8), axis=1, append=0)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    lo = pos[row] - BEFORE + first
    return marks(COVER, doc[row], lo, lo + (last - first - 1) + WINDOW)


def repeated_ids(rows: DataFrame) -> DataFrame | None:
    """(doc, chosen) of ids that several rows have, with the smallest text; None if there are none.

    Only such rows are shuffled with their text.
    """
    twice = stored(rows.groupBy("doc").count().where("count > 1").select("doc"))
    if not twice.take(1):
        return None
    return stored(rows.join(twice, "doc", "left_semi").groupBy("doc").agg(F.min("text").alias("chosen")))


def covered_spans(rows: DataFrame, buckets: int) -> DataFrame:
    """(doc, lo, hi): covered bytes of the texts of ``rows`` (doc, text, further columns)."""
    sent = rows.select("doc", "text").mapInArrow(anchor_entries(buckets), PACKED_DDL)
    first = stored(sent.groupBy("bucket").applyInArrow(sort_anchors, MARKS_DDL))
    release(rows.sparkSession)
    chosen = first.where(F.col("kind") != COVER).groupBy("doc").agg(
        F.collect_list(F.when(F.col("kind") == MEET, F.col("lo"))).alias("meet"),
        F.collect_list(F.when(F.col("kind") == SINGLE, F.col("lo"))).alias("single"),
    )
    # all columns of rows, so that this shuffle of the texts serves the join with the marks too
    sent = rows.join(chosen, "doc").mapInArrow(window_entries(buckets), PACKED_DDL)
    second = sent.groupBy("bucket").applyInArrow(sort_windows, MARKS_DDL)
    return first.where(F.col("kind") == COVER).unionByName(second).drop("kind")


KEPT_DDL = "doc long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"
KEPT = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary())])


def spans_of(n: int, marks_of: np.ndarray) -> np.ndarray:
    """Maximal covered runs [start, end) of a text of n bytes; marks hold lo and hi in one number."""
    if not len(marks_of):
        return np.empty((0, 2), dtype=np.int64)
    marks_of = np.sort(marks_of.astype(np.int64))
    lo, hi = marks_of >> 32, np.minimum(np.maximum.accumulate(marks_of & ((1 << 32) - 1)), n)
    new = np.append(True, lo[1:] > hi[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)
    return np.stack([lo[new], hi[last]], axis=1)


def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        out = []
        cols = [rb.column(c).to_pylist() for c in ("doc", "text", "marks")]
        for doc, text, marks_of in zip(*cols, strict=True):
            data = text.encode("utf-8", "surrogatepass")
            spans = spans_of(len(data), np.array(marks_of or [], dtype=np.int64))
            edges = [0, *spans.ravel().tolist(), len(data)]
            kept = b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
            out.append((doc, len(data), [{"start": s, "end": e} for s, e in spans.tolist()], kept))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), KEPT, strict=True)] if out else [pa.array([], f.type) for f in KEPT], schema=KEPT)


def doc_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    return docs.select(key.alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def covered_by_doc(rows: DataFrame, per_bucket: int) -> DataFrame:
    """(doc, marks): the marks of each document that has any; ``rows`` has unique ids."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    spans = covered_spans(rows, max(12, -(-total // per_bucket)))
    mark = F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR(F.col("hi").cast("long"))
    return spans.groupBy("doc").agg(F.collect_list(mark).alias("marks"))


def searched_once(rows: DataFrame) -> DataFrame:
    """``rows`` (doc, text, further columns) with one row per number; only repeated ones are shuffled."""
    twice = stored(rows.groupBy("doc").count().where("count > 1").select("doc"))
    if not twice.take(1):
        return rows
    again = rows.join(twice, "doc", "left_semi").dropDuplicates(["doc"])
    return rows.join(twice, "doc", "left_anti").select(*rows.columns).unionByName(again)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", per_bucket: int = PER_BUCKET, each_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): removed runs of bytes and the bytes that stay.

    One row per id or, with ``each_text``, one row per document: per row without id, and per text of an id.
    """
    small_batches(docs.sparkSession)
    if each_text:
        rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        rows = searched_once(numbered(rows, "id", "text", "doc", NO_ID))
        marked = rows.join(covered_by_doc(rows, per_bucket), "doc", "left")
        cut = marked.select(F.col("id").alias("doc"), "text", "marks").mapInArrow(cut_texts, KEPT_DDL)
        return cut.withColumnRenamed("doc", "doc_id")
    rows = doc_rows(docs, doc_id, text)
    if (chosen := repeated_ids(rows)) is not None:
        single = rows.join(chosen, "doc", "left_anti")
        rows = single.unionByName(chosen.withColumnRenamed("chosen", "text"))
    marked = rows.join(covered_by_doc(rows, per_bucket), "doc", "left")
    cut = marked.select("doc", "text", "marks").mapInArrow(cut_texts, KEPT_DDL)
    return cut.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_bytes", "spans", "kept")


def cut_text(text: Column, marks_of: Column) -> Column:
    """What stays of a text, less characters of which a part is removed."""

    @F.pandas_udf("string")
    def of(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for t, m in zip(texts, lists, strict=True):
            if t is None or m is None:
                out.append(t)
                continue
            data = t.encode("utf-8", "surrogatepass")
            edges = [0, *spans_of(len(data), np.asarray(m)).ravel().tolist(), len(data)]
            out.append("".join(data[i:j].decode("utf-8", "ignore") for i, j in zip(edges[::2], edges[1::2], strict=True)))
        return pd.Series(out, dtype=object)

    return of(text, marks_of)


def cut_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", per_bucket: int = PER_BUCKET) -> DataFrame:
    """``docs`` with repeated windows cut out of their texts; rows and other columns stay."""
    small_batches(docs.sparkSession)
    all_columns = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    rows = docs.select(all_columns).select(
        F.col("row")[doc_id].cast("long").alias("id"),
        F.coalesce(F.col("row")[text], F.lit("")).alias("text"),
        F.struct(*[F.col("row")[c].alias(c) for c in docs.columns if c != text]).alias("rest"),
        F.col("row")[text].isNull().alias("no_text"),
    )
    rows = numbered(rows, "id", "text", "doc", NO_ID)
    out = rows.join(covered_by_doc(searched_once(rows), per_bucket), "doc", "left")
    left = F.when(~F.col("no_text"), cut_text(F.col("text"), F.col("marks")))
    return out.select("rest", left.alias("left")).select(
        *[F.col("left" if c == text else f"rest.`{c}`").alias(c) for c in docs.columns]
    )
