"""Repeated word passages by suffix automata of reference shards.

A word goes if a window of ``WINDOW`` consecutive words that covers it also starts anywhere else.
The table is its own reference, so a shard is not a slice of documents but of contents: every
document then meets only the shards it can match, and the work grows with the table, not its square.

* Every window has one anchor: its ``GRAM`` words with the smallest hash. Consecutive windows with one
  anchor make a stretch, and equal windows lie in stretches with equal anchors. A first pass finds the
  anchors that occur more than once. Equal stretches are pre-aggregated in the task and again
  where they meet: one of them stands for all with weight two, the others are covered whole.
* The stretches whose anchor is shared by other stretches go to the shard of their anchor. A shard
  builds the suffix automaton of its stretches, with the weighted number of places of every state,
  and streams the stretches through it for matching statistics: after each word, the longest
  suffix that has two places or more. Maximal spans of at least ``WINDOW`` words are removed.
* An anchor with very many different stretches is hot (such as the edges of a passage that a third
  of all documents share). No task may hold all of these, so their windows are dealt one by one by
  their own hash, and equal ones are counted; this is exact as well.

The automata are not broadcast to all tasks: all shards for all documents would be quadratic, and
their size has no bound. Marks that need no meeting are dealt by document, so a passage in every
text is spread. Words are compared by hashes of 64 bits, windows and stretches by two of them.

Defined cases: a null text has no words; texts under ``WINDOW`` words lose nothing; rows with one id
and one text are one document, other texts of an id and rows without id are documents of their own;
columns other than the two named ones are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.base import numbered, small_batches, stored
from gleaner.llm.suffix import NO_ID, ODD, U64, dealt, equal_before, mix, searched_once, several, spans_of

WINDOW = 35
GRAM = 8
# Bytes of text, and windows, that are worked on at a time.
PIECE = 1 << 20
# Stretches or windows that a task holds before it sends them.
FLUSH = 200_000
# Different stretches of one anchor in one task from which they are dealt by content.
HOT_RUN = 64
# Different stretches of one anchor that may meet in one task.
HOT_MEET = 2_000
# Words of one automaton; an anchor's stretches are never parted.
SHARD_WORDS = 100_000
# Text bytes for each bucket of the shuffles.
PER_BUCKET = 16_000_000

SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 - 2  # 3 modulo 8


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base % (1 << 64)), dtype=U64)
    out[:1] = 1
    return np.cumprod(out)


class Polynomial:
    """Hashes of ranges from running sums, all modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = powers(1, 0)

    def ranges(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.up) < len(values):
            n = 1 << len(values).bit_length()
            self.up, self.down = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)
        total = np.concatenate((U64([0]), np.cumsum(values * self.up[: len(values)])))
        return mix((total[end] - total[start]) * self.down[start], 5)


POLYNOMIAL = Polynomial()


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word in bytes that begin and end with a space."""
    space = SPACE[raw]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    out = np.empty(len(start), dtype=U64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, side="right")))
        lo = start[i]
        out[i:j] = POLYNOMIAL.ranges(BYTE[raw[lo : end[j - 1]]], start[i:j] - lo, end[i:j] - lo)
        i = j
    return start, out


def gram_hashes(words: np.ndarray) -> np.ndarray:
    h, step, k = words, 1, 0
    while step < GRAM:
        h = mix(h[:-step] + h[step:] * ODD[k], k + 8)
        step, k = 2 * step, k + 1
    return h


# Consecutive windows of a document with one anchor. ``many``: has an equal one that needs no sending.
STRETCH = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("n", "<i2"), ("many", "<i2")])
MARK = np.dtype([("doc", "<i8"), ("lo", "<i4"), ("hi", "<i4")])


class Block:
    """Texts as one array of word hashes, and the stretches in them."""

    def __init__(self, texts: list[bytes], docs: np.ndarray) -> None:
        raw = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
        start, self.words = word_hashes(raw)
        first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))[:-1] + 1
        self.row = np.searchsorted(first, start, side="right") - 1
        self.docs = docs
        self.first_word = np.searchsorted(start, first)

    def pieces(self) -> Iterator[tuple[int, np.ndarray]]:
        for i in range(0, max(len(self.words) - WINDOW + 1, 0), PIECE):
            yield i, self.words[i : i + PIECE + WINDOW - 1]

    def stretches(self) -> tuple[np.ndarray, np.ndarray]:
        """(stretches, place of their first word in the block)."""
        out, places = [np.empty(0, STRETCH)], [np.empty(0, np.int64)]
        for base, words in self.pieces():
            n = len(words) - WINDOW + 1
            row = self.row[base : base + len(words)]
            inside = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
            if not len(inside):
                continue
            grams = gram_hashes(words)
            # smallest hash of the grams in a window, the leftmost of equal ones
            key = (mix(grams, 20) & ~U64((1 << 32) - 1)) | np.arange(len(grams), dtype=U64)
            span, width = 1, WINDOW - GRAM + 1
            while 2 * span <= width:
                key = np.minimum(key[:-span], key[span:])
                span *= 2
            key = np.minimum(key[:n], key[width - span : width - span + n])
            anchor = (key[inside] & U64((1 << 32) - 1)).astype(np.int64)
            new = np.flatnonzero(~equal_before(anchor, row[inside]))
            start = inside[new]
            e = np.empty(len(new), STRETCH)
            e["anchor"] = grams[anchor[new]]
            e["n"] = np.diff(np.append(new, len(inside))) + WINDOW - 1
            e["content"] = POLYNOMIAL.ranges(words, start, start + e["n"])
            e["doc"] = self.docs[row[start]]
            e["at"] = base + start - self.first_word[row[start]]
            e["many"] = 0
            out.append(e)
            places.append(base + start)
        return np.concatenate(out), np.concatenate(places)

    def windows(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the window at each place."""
        a, b = np.empty(len(place), U64), np.zeros(len(place), U64)
        for base, words in self.pieces():
            here = np.flatnonzero((place >= base) & (place < base + PIECE))
            at = place[here] - base
            grams = gram_hashes(words)
            a[here] = POLYNOMIAL.ranges(words, at, at + WINDOW)
            for k, d in enumerate((*range(0, WINDOW - GRAM, GRAM), WINDOW - GRAM)):
                b[here] = mix(b[here] ^ (grams[at + d] * ODD[k + 6]), k + 3)
        return a, b


def blocks(rb: pa.RecordBatch) -> Iterator[tuple[int, int, Block]]:
    """Row ranges of a batch and their texts."""
    texts = [t.encode("utf-8", "surrogatepass") for t in rb.column("text").to_pylist()]
    docs = rb.column("doc").to_numpy(zero_copy_only=False)
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) <= PIECE):
            total += len(texts[j])
            j += 1
        yield i, j, Block(texts[i:j], docs[i:j])
        i = j


# Kinds of packed entries: stretches that meet by anchor; of a hot anchor, by content; news for the
# bucket of an anchor that it is hot; marks of covered words; stretches with their words; windows.
MEET, HOT, HOT_NEWS, COVERED, WORDS, SINGLE = range(6)
PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary()), ("words", pa.binary())])
PACKED_DDL = "bucket int, kind int, data binary, words binary"


def packed(e: np.ndarray, kind: int, by: np.ndarray, buckets: int, words: Sequence[np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """One row per bucket with all its entries."""
    if not len(e):
        return
    bucket = dealt(by, buckets)
    o = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[o])) + 1
    parts = np.split(o, cuts)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([bucket[p[0]] for p in parts], pa.int32()),
            pa.array([kind] * len(parts), pa.int32()),
            pa.array([e[p].tobytes() for p in parts], pa.binary()),
            pa.array([None if words is None else b"".join(words[i].tobytes() for i in p.tolist()) for p in parts], pa.binary()),
        ],
        schema=PACKED,
    )


def covered_whole(e: np.ndarray) -> np.ndarray:
    out = np.empty(len(e), MARK)
    out["doc"], out["lo"], out["hi"] = e["doc"], e["at"], e["at"] + e["n"]
    return out


def by_doc(m: np.ndarray) -> np.ndarray:
    return mix(m["doc"].astype(U64), 2)


def one_of_each(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one stretch or window of each equal group, with its weight; all others), sorted."""
    o = np.lexsort((e["many"], e["content"], e["anchor"]))
    e = e[o]
    again = equal_before(e["anchor"], e["content"])
    group = np.cumsum(~again) - 1
    if len(e):
        many = (np.bincount(group) > 1) | (np.bincount(group, weights=e["many"]) > 0)
        e["many"] = many[group]
    return e[~again], e[again]


def send_stretches(e: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    e, others = one_of_each(e)
    marks = covered_whole(others)
    yield from packed(marks, COVERED, by_doc(marks), buckets)
    again = equal_before(e["anchor"])
    group = np.cumsum(~again) - 1
    hot = (np.bincount(group) > HOT_RUN)[group] if len(e) else np.zeros(0, bool)
    for kind, some, key in ((MEET, ~hot, "anchor"), (HOT, hot, "content"), (HOT_NEWS, hot & ~again, "anchor")):
        yield from packed(e[some], kind, e[key][some], buckets)


def send_windows(e: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    e, others = one_of_each(e)
    marks = covered_whole(others)
    yield from packed(marks, COVERED, by_doc(marks), buckets)
    yield from packed(e, SINGLE, e["anchor"], buckets)


def stretch_entries(buckets: int, flush: int = FLUSH):
    """All stretches of every partition, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for rb in batches:
            for _, _, block in blocks(rb):
                held.append(block.stretches()[0])
                n += len(held[-1])
                if n >= flush:
                    yield from send_stretches(np.concatenate(held), buckets)
                    held, n = [], 0
        if n:
            yield from send_stretches(np.concatenate(held), buckets)

    return run


def of_kind(t: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
    rows = t.filter(pa.compute.equal(t["kind"], kind))
    return np.frombuffer(b"".join(rows["data"].to_pylist()), dtype=dtype)


FOUND = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
FOUND_DDL = "kind int, doc long, lo int, hi int"
# Kinds of findings: words lo to hi are covered; the stretch that begins with word lo is for an
# automaton or for single windows, hi tells its weight.
COVER, TO_SHARD, TO_WINDOWS = range(3)


def found(kind: int, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    cols = (np.full(len(doc), kind), doc, lo, hi)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, FOUND, strict=True)], schema=FOUND)


def covers(m: np.ndarray) -> pa.RecordBatch:
    return found(COVER, m["doc"], m["lo"], m["hi"])


def meet_stretches(t: pa.Table) -> pa.Table:
    """Which stretches of a bucket are covered, and which must be looked into."""
    hot, others = one_of_each(of_kind(t, HOT, STRETCH))
    out = [covers(of_kind(t, COVERED, MARK)), covers(covered_whole(others)), found(TO_WINDOWS, hot["doc"], hot["at"], hot["many"])]
    news = np.unique(of_kind(t, HOT_NEWS, STRETCH)["anchor"])
    e = of_kind(t, MEET, STRETCH)
    some = np.isin(e["anchor"], news) | (e["many"] > 0)
    some[several(e["anchor"])] = True
    e, others = one_of_each(e[some])
    group = np.cumsum(~equal_before(e["anchor"])) - 1
    different = np.bincount(group)[group] if len(e) else group
    hot = np.isin(e["anchor"], news) | (different > HOT_MEET)
    alone = ~hot & (different == 1)
    out += [covers(covered_whole(others)), covers(covered_whole(e[alone & (e["many"] > 0)]))]
    for kind, chosen in ((TO_WINDOWS, hot), (TO_SHARD, ~hot & ~alone)):
        out.append(found(kind, e["doc"][chosen], e["at"][chosen], e["many"][chosen]))
    return pa.Table.from_batches(out, schema=FOUND)


def content_entries(buckets: int, flush: int = FLUSH):
    """The words of the stretches in ``to_shard`` and the windows of those in ``to_windows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, windows, n = [], [], [], 0

        def rest() -> Iterator[pa.RecordBatch]:
            if held:
                e = np.concatenate(held)
                yield from packed(e, WORDS, e["anchor"], buckets, list(words))
            if windows:
                yield from send_windows(np.concatenate(windows), buckets)
            held.clear()
            words.clear()
            windows.clear()

        for rb in batches:
            for i, j, block in blocks(rb):
                e, place = block.stretches()
                row = block.row[place]
                for column in ("to_shard", "to_windows"):
                    lists = rb.column(column).slice(i, j - i)
                    rows = np.repeat(np.arange(j - i), pa.compute.list_value_length(lists).fill_null(0).to_numpy())
                    asked = lists.flatten().to_numpy().astype(np.int64)
                    asked = np.unique((rows << 40) | asked)  # row, first word, weight
                    key = (row << 40) | (e["at"].astype(np.int64) << 1)
                    nth = np.minimum(np.searchsorted(asked, key), max(len(asked) - 1, 0))
                    hit = (asked[nth] | 1) == (key | 1) if len(asked) else np.zeros(len(e), bool)
                    some, at = e[hit].copy(), place[hit]
                    some["many"] = asked[nth[hit]] & 1 if len(asked) else 0
                    if column == "to_shard":
                        held.append(some)
                        words += [block.words[p : p + k] for p, k in zip(at.tolist(), some["n"].tolist(), strict=True)]
                        n += len(some)
                    elif len(some):
                        count = some["n"].astype(np.int64) - WINDOW + 1
                        nth = np.repeat(np.arange(len(some)), count)
                        step = np.arange(len(nth)) - np.repeat(np.cumsum(count) - count, count)
                        one = some[nth]
                        one["at"] += step.astype(np.int32)
                        one["n"] = WINDOW
                        one["anchor"], one["content"] = block.windows(at[nth] + step)
                        windows.append(one)
                        n += len(one)
                if n >= flush:
                    yield from rest()
                    n = 0
        yield from rest()

    return run


class Automaton:
    """Suffix automaton of several strings with the weighted number of places of every state."""

    def __init__(self, strings: list[list[int]], weights: list[int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, places = [-1], [0], [0]
        nexts, link, length = self.next, self.link, self.length

        def split(p: int, c: int, q: int) -> int:
            """The part of state q that p reaches by c, as a state of its own."""
            r = len(length)
            nexts.append(nexts[q].copy())
            link.append(link[q])
            length.append(length[p] + 1)
            places.append(0)
            while p >= 0 and nexts[p].get(c) == q:
                nexts[p][c] = r
                p = link[p]
            link[q] = r
            return r

        for string, weight in zip(strings, weights, strict=True):
            last = 0
            for c in string:
                q = nexts[last].get(c)
                if q is not None:
                    last = q if length[q] == length[last] + 1 else split(last, c, q)
                else:
                    new = len(length)
                    nexts.append({})
                    length.append(length[last] + 1)
                    places.append(0)
                    link.append(0)
                    p = last
                    while p >= 0 and c not in nexts[p]:
                        nexts[p][c] = new
                        p = link[p]
                    if p >= 0:
                        q = nexts[p][c]
                        link[new] = q if length[q] == length[p] + 1 else split(p, c, q)
                    last = new
                places[last] += weight
        for v in np.argsort(np.array(length), kind="stable")[:0:-1].tolist():
            places[link[v]] += places[v]
        self.places = places

    def matching(self, string: list[int], least: int = 2) -> list[int]:
        """After each symbol, the length of the longest suffix with ``least`` places."""
        nexts, link, length, places = self.next, self.link, self.length, self.places
        state, n, out = 0, 0, []
        for c in string:
            while state and c not in nexts[state]:
                state = link[state]
                n = length[state]
            to = nexts[state].get(c)
            if to is not None:
                state, n = to, n + 1
                while state and places[state] < least:
                    state = link[state]
                    n = length[state]
            out.append(n)
        return out


def long_matches(lengths: list[int], least: int) -> list[tuple[int, int]]:
    """Maximal spans that matches of at least that length cover."""
    out: list[tuple[int, int]] = []
    for end, n in enumerate(lengths, 1):
        if n >= least:
            lo = end - n
            while out and lo <= out[-1][1]:
                lo = min(lo, out.pop()[0])
            out.append((lo, end))
    return out


def match_shard(e: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Marks of one shard's stretches."""
    _, codes = np.unique(np.concatenate(words), return_inverse=True)
    strings = [p.tolist() for p in np.split(codes, np.cumsum(e["n"].astype(np.int64))[:-1])]
    automaton = Automaton(strings, (1 + e["many"].astype(np.int64)).tolist())
    marks = []
    for doc, at, string in zip(e["doc"].tolist(), e["at"].tolist(), strings, strict=True):
        marks += [(doc, at + lo, at + hi) for lo, hi in long_matches(automaton.matching(string), WINDOW)]
    return np.array(marks, dtype=MARK)


def match_bucket(t: pa.Table) -> pa.Table:
    """Marks of one bucket: its shards one after another, and its single windows."""
    out = [covers(of_kind(t, COVERED, MARK))]
    single, others = one_of_each(of_kind(t, SINGLE, STRETCH))
    out += [covers(covered_whole(others)), covers(covered_whole(single[single["many"] > 0]))]
    rows = t.filter(pa.compute.equal(t["kind"], WORDS))
    e = np.frombuffer(b"".join(rows["data"].to_pylist()), STRETCH)
    words = np.frombuffer(b"".join(rows["words"].to_pylist()), U64)
    ends = np.cumsum(e["n"].astype(np.int64))
    order = np.argsort(e["anchor"], kind="stable")
    first = np.flatnonzero(~equal_before(e["anchor"][order]))
    before = np.concatenate(([0], np.cumsum(e["n"].astype(np.int64)[order])))[first]
    for shard in np.split(order, first[np.flatnonzero(np.diff(before // SHARD_WORDS)) + 1]):
        if len(shard):
            out.append(covers(match_shard(e[shard], [words[ends[i] - e["n"][i] : ends[i]] for i in shard.tolist()])))
    return pa.Table.from_batches(out, schema=FOUND)


def covered_spans(rows: DataFrame, buckets: int) -> DataFrame:
    """(doc, lo, hi): covered words of the texts of ``rows`` (doc, text, further columns)."""
    sent = rows.select("doc", "text").mapInArrow(stretch_entries(buckets), PACKED_DDL)
    first = stored(sent.groupBy("bucket").applyInArrow(meet_stretches, FOUND_DDL))
    place = F.shiftleft(F.col("lo").cast("long"), 1).bitwiseOR(F.col("hi").cast("long"))
    chosen = first.where(F.col("kind") != COVER).groupBy("doc").agg(
        F.collect_list(F.when(F.col("kind") == TO_SHARD, place)).alias("to_shard"),
        F.collect_list(F.when(F.col("kind") == TO_WINDOWS, place)).alias("to_windows"),
    )
    # all columns of rows, so that this shuffle of the texts serves the join with the marks too
    sent = rows.join(chosen, "doc").mapInArrow(content_entries(buckets), PACKED_DDL)
    second = sent.groupBy("bucket").applyInArrow(match_bucket, FOUND_DDL)
    return first.where(F.col("kind") == COVER).unionByName(second).drop("kind")


KEPT_DDL = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, kept string"
KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.string())])


def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        out = []
        for id_, text, marks in zip(*(rb.column(c).to_pylist() for c in ("id", "text", "marks")), strict=True):
            words = text.encode("utf-8", "surrogatepass").split()  # bytes: white space of ASCII only
            n = len(words)
            spans = spans_of(n, np.array(marks or [], dtype=np.int64)).tolist()
            edges = [0, *(x for s in spans for x in s), n]
            kept = [w for i, j in zip(edges[::2], edges[1::2], strict=True) for w in words[i:j]] if spans else words
            out.append((id_, n, [{"start": s, "end": e} for s, e in spans], b" ".join(kept).decode("utf-8", "surrogatepass")))
        columns = zip(*out, strict=True) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, KEPT, strict=True)], schema=KEPT)


def without_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", per_bucket: int = PER_BUCKET) -> DataFrame:
    """(doc_id, n_words, spans, kept): removed spans of words and the words that stay, one row per document."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = searched_once(numbered(rows, "id", "text", "doc", NO_ID))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    spans = covered_spans(rows, max(12, -(-total // per_bucket)))
    mark = F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR(F.col("hi").cast("long"))
    marks = spans.groupBy("doc").agg(F.collect_list(mark).alias("marks"))
    return rows.join(marks, "doc", "left").select("id", "text", "marks").mapInArrow(cut_texts, KEPT_DDL)
