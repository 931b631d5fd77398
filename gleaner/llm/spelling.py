"""Spelling variants by scans of a sorted vocabulary with banded edit rows.

Words are the maximal runs of Latin letters (``A-Z a-z U+00C0-U+00FF``) of all texts, A-Z in lower case,
as the contract's rule spoils them: a run whose crc32 with its doc_id is divisible by ``SPOIL`` loses one
letter. Kept are words of ``LEAST_LENGTH`` letters and ``LEAST_COUNT`` occurrences. Two are near if they
differ by one inserted, deleted or replaced letter. A word's form is its most frequent near word, if
that is ``FACTOR`` times as frequent; its root is the last word that forms lead to.

Near words share all letters outside the place of the edit. So each word goes, for either half that
may hold the edit, to the block of words with the same rest; a block with more than ``BLOCK`` words is
split again by halving that range, until one place is left, where the alphabet bounds it. A pair meets in
one block only. In a block the words lie sorted. For each of them the list is scanned
once: the edit matrix keeps three entries a row, a word reuses the rows of its common prefix with the word
before, and where a row has no entry of one or less, all words that share this prefix are skipped. Each block
sends a count and the best form per word, never its pairs.

Counts are summed inside tasks before the shuffle. Roots double their reach each round; as counts grow by
``FACTOR`` along the way, a handful of rounds is enough.

Defined cases: a null text has no runs; a null doc_id counts as an empty one; rows that repeat others count
again; very long runs are words like others; columns other than the two named ones are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.base import small_batches, stored

SPOIL = 31
LEAST_LENGTH = 7
LEAST_COUNT = 2
FACTOR = 10
# Words of one block; a range of one place is never split.
BLOCK = 200
# Different words that a task holds before it sends their counts.
FLUSH = 200_000

# One byte a letter: Latin-1 has all letters of the rule; what is none becomes a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def runs(text: str, prefix: int) -> list[bytes]:
    """The words of one text, in Latin-1; ``prefix`` is the crc32 of the id and the colon."""
    data = text.encode("latin-1", "replace").translate(LETTERS)
    words = [w for w in data.split() if len(w) >= LEAST_LENGTH]
    if data.isascii():
        hashes = [crc32(w, prefix) for w in words]
    else:
        hashes = [crc32(w if w.isascii() else w.decode("latin-1").encode(), prefix) for w in words]
    for i, h in enumerate(hashes):
        if h % SPOIL == 0:
            at = h % len(words[i])
            words[i] = words[i][:at] + words[i][at + 1 :]
    return words


def count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rest() -> pa.RecordBatch:
        known = {w.decode("latin-1"): n for w, n in counts.items() if len(w) >= LEAST_LENGTH}
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array(list(known.values()), pa.int64())], schema=COUNTS)

    counts: Counter[bytes] = Counter()
    for rb in batches:
        for id_, text in zip(rb.column("id").to_pylist(), rb.column("text").to_pylist(), strict=True):
            counts.update(runs(text, crc32(f"{id_}:".encode())))
            if len(counts) >= FLUSH:
                yield rest()
    yield rest()


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n)."""
    rows = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(count_runs, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


# A block: the shorter word's length, the range of places that may hold the edit, all other letters.
KEY = ["length", "low", "high", "rest"]


def keyed(rows: DataFrame, ranges: Column) -> DataFrame:
    """``rows`` (word, n) once per block; ``ranges`` is an array of (length, low, high)."""
    r = F.col("r")
    before = F.substring(F.col("word"), F.lit(1), r["low"])
    after = F.substring(F.col("word"), F.length("word") - r["length"] + r["high"] + 1, r["length"] - r["high"])
    out = rows.withColumn("r", F.explode(ranges))
    return out.select("word", "n", r["length"].alias("length"), r["low"].alias("low"), r["high"].alias("high"), F.concat(before, after).alias("rest"))


def halves(length: Column, low: Column, high: Column) -> Column:
    middle = F.floor((low + high) / 2).cast("int")
    return F.array(*[F.struct(length.alias("length"), a.alias("low"), b.alias("high")) for a, b in ((low, middle), (middle, high))])


def blocks(words: DataFrame, limit: int = BLOCK) -> DataFrame:
    """(word, n, length, low, high, rest): every word in all its blocks, large ones split."""
    length = F.length("word")
    both = [halves(n, F.lit(0), n) for n in (length, length - 1)]
    todo = keyed(words, F.concat(both[0], F.when(length > LEAST_LENGTH, both[1]).otherwise(F.slice(both[1], 1, 0))))
    done = []
    while True:
        sizes = todo.where(F.col("high") - F.col("low") > 1).groupBy(*KEY).count()
        hot = stored(sizes.where(F.col("count") > limit).select(*KEY))
        if not hot.take(1):
            break
        done.append(todo.join(hot, KEY, "left_anti"))
        split = todo.join(hot, KEY, "left_semi")
        todo = stored(keyed(split.select("word", "n", *[F.col(c).alias(f"of_{c}") for c in KEY[:3]]), halves(*[F.col(f"of_{c}") for c in KEY[:3]])))
    for d in done:
        todo = todo.unionByName(d)
    return todo


def common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


class Scan:
    """Sorted words with their common prefixes."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.shared = [0, *map(common, words[:-1], words[1:]), -1]
        # the next word that shares less with the one before it
        self.less = [0] * (len(words) + 1)
        open_: list[int] = []
        for i, n in enumerate(self.shared):
            while open_ and self.shared[open_[-1]] > n:
                self.less[open_.pop()] = i
            open_.append(i)

    def near(self, q: str, visited: list[int] | None = None) -> list[int]:
        """Places of the words that are one edit from ``q`` and as long or longer by one.

        rows[d]: edits from the first d letters of a word to the first d - 1, d, d + 1 letters of q; 2 is
        two or more.
        """
        words, shared, less, m = self.words, self.shared, self.less, len(q)
        rows = [(2, 0, 1)]
        out, i = [], 0
        while i < len(words):
            w = words[i]
            d = min(shared[i], len(rows) - 1)
            del rows[d + 1 :]
            a, b, c = rows[d]
            end = min(len(w), m + 1)
            dead = False
            while d < end:
                x = w[d]
                if b == 0 and d < m and x == q[d]:  # all equal so far
                    a, c = 1, (1 if d + 1 < m else 2)
                else:
                    na = min(a + (x != q[d - 1]) if d else 2, b + 1, 2)
                    nb = min(b + (x != q[d]), c + 1, na + 1, 2) if d < m else 2
                    c = min(c + (x != q[d + 1]), nb + 1, 2) if d + 1 < m else 2
                    a, b = na, nb
                d += 1
                rows.append((a, b, c))
                if a > 1 and b > 1 and c > 1:
                    dead = True
                    break
            if visited is not None:
                visited.append(i)
            if not dead and len(w) - m in (0, 1) and (b, a)[len(w) - m] == 1:
                out.append(i)
            i += 1
            if dead:
                while shared[i] >= d:
                    i = less[i]
        return out


NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])
NEAR_DDL = "word string, n_near long, form string, form_n long"


def near_in_block(words: list[str], counts: list[int], length: int, low: int, high: int) -> list[tuple[str, int, str, int]]:
    """(word, near words in this block, the most frequent of them, its count)."""
    found: dict[int, list] = {}

    def add(i: int, j: int) -> None:
        best = (-counts[j], words[j])
        if i in found:
            found[i][0] += 1
            found[i][1] = min(found[i][1], best)
        else:
            found[i] = [1, best]

    scan = Scan(words)
    for i, q in enumerate(words):
        if len(q) != length:
            continue
        for j in scan.near(q):
            if len(words[j]) == length and j < i:
                continue  # the other word finds this pair
            at = common(q, words[j])
            if low <= at < high or at == high == length:
                add(i, j)
                add(j, i)
    return [(words[i], k, best[1], -best[0]) for i, (k, best) in found.items()]


def scan_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of the blocks of a partition that is sorted by block and word."""
    key, words, counts, out = None, [], [], []

    def batch() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(map(list, columns), NEAR, strict=True)], schema=NEAR)

    for rb in batches:
        for *k, word, n in zip(*(rb.column(c).to_pylist() for c in (*KEY, "word", "n")), strict=True):
            if k != key:
                if len(words) > 1:
                    out += near_in_block(words, counts, *key[:3])
                key, words, counts = k, [], []
            words.append(word)
            counts.append(n)
        yield batch()
        out.clear()
    if len(words) > 1:
        out += near_in_block(words, counts, *key[:3])
    yield batch()


def near_words(words: DataFrame, limit: int = BLOCK) -> DataFrame:
    """(word, n_near, form, form_n): the number of near words and the most frequent one."""
    placed = blocks(words, limit).repartition(*KEY).sortWithinPartitions(*KEY, "word")
    found = placed.mapInArrow(scan_blocks, NEAR_DDL)
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n")
    )


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of words with a form; ``links`` is (word, form)."""
    at = stored(links.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = stored(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not at.where("moved").take(1):
            return at.drop("moved")
        at = at.drop("moved")


def group_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n)."""
    small_batches(docs.sparkSession)
    words = stored(vocabulary(docs, doc_id, text))
    near = near_words(words, limit)
    is_form = F.col("form_n") >= FACTOR * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"),
    )
    rows = stored(rows)
    found = roots(rows.where(F.col("form").isNotNull()))
    out = rows.join(found, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
