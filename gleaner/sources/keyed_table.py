"""Stored tables by key, in hash buckets, so that a batch meets them without moving them.

Every write makes a generation: a bucketed Parquet table whose file names tell the bucket. A join of
a batch with it shuffles the batch to the buckets and never the stored rows, however large the batch
is. Each generation has a Bloom filter per bucket, built by bitmap aggregates: keys that no filter
knows are new without any read, and only the buckets of the others are opened, as their file
names are pruned when files are listed.

A manifest lists the generations of a version and the buckets each one still owns. It is written
last and put in place by a rename, so a batch that fails leaves no trace, and one that runs again reads
the version before it and gives the same tables. Small generations are merged into the next write, so
their number stays logarithmic.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Bits of one bitmap page, as the bitmap aggregates have it, keys per page and probes per key.
PAGE_BITS = 32_768
PAGE_KEYS = 2_500
PROBES = 5


@dataclass(frozen=True)
class Generation:
    folder: str
    rows: int
    pages: int
    # buckets it still owns; the others were rewritten later
    owned: list[int]


class KeyedTable:
    """Rows by ``key`` under ``path``, with versions numbered by batch.

    ``fold`` turns all rows of some keys into one row per key, for tables that get a key more than once;
    it is applied when generations are merged and when several are read.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64, fold: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.buckets, self.fold = buckets, fold
        self.columns = spark.createDataFrame([], schema).columns

    # -- files and versions ---------------------------------------------------------------

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._hadoop(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _manifests(self) -> list[str]:
        return [n for n in self._names(f"{self.path}/manifest") if n.endswith(".json")]

    def generations(self, before: int | None = None) -> list[Generation]:
        """Those of the newest version, or of the newest one of an earlier batch than ``before``."""
        names = [n for n in self._manifests() if before is None or int(n.split("-")[0]) < before]
        if not names:
            return []
        fs, p = self._hadoop(f"{self.path}/manifest/{names[-1]}")
        stream = fs.open(p)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        version = json.loads(text)
        if version["buckets"] != self.buckets:
            raise ValueError(f"{self.path} has {version['buckets']} buckets, not {self.buckets}")
        return [Generation(**g) for g in version["generations"]]

    def _commit(self, generations: Sequence[Generation], batch: int) -> None:
        earlier = [n for n in self._manifests() if int(n.split("-")[0]) == batch]
        attempt = 1 + int(earlier[-1].removesuffix(".json").split("-")[1]) if earlier else 0
        fs, draft = self._hadoop(f"{self.path}/manifest/{uuid.uuid4().hex}.draft")
        stream = fs.create(draft)
        version = {"buckets": self.buckets, "generations": [asdict(g) for g in generations]}
        stream.write(bytearray(json.dumps(version).encode()))
        stream.close()
        if not fs.rename(draft, self._hadoop(f"{self.path}/manifest/{batch:012d}-{attempt:06d}.json")[1]):
            raise RuntimeError(f"version {batch} of {self.path} was written by someone else")

    def vacuum(self, keep: int = 2) -> None:
        """Delete what the newest versions of the last ``keep`` batches don't refer to."""
        newest = {int(n.split("-")[0]): n for n in self._manifests()}
        kept = sorted(newest)[-keep:]
        live = {g.folder for batch in kept for g in self.generations(batch + 1)}
        for name in self._names(f"{self.path}/data"):
            if name not in live:
                for part in ("data", "filters"):
                    fs, p = self._hadoop(f"{self.path}/{part}/{name}")
                    fs.delete(p, True)
        for name in self._manifests():
            if name not in {newest[batch] for batch in kept}:
                fs, p = self._hadoop(f"{self.path}/manifest/{name}")
                fs.delete(p, False)

    # -- reading --------------------------------------------------------------------------

    def bucket(self, key: Column) -> Column:
        """The bucket that Spark's bucketed writer puts a key into."""
        return F.pmod(F.hash(key), F.lit(self.buckets))

    def _bucketed(self, folder: str) -> str:
        """A name for the folder as a bucketed table of this session."""
        name = f"keyed_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.createDataFrame([], self.schema).schema.fields)
        self.spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`)"
            f" INTO {self.buckets} BUCKETS LOCATION '{self.path}/data/{folder}'"
        )
        return name

    def _scan(self, g: Generation, wanted: Sequence[int] | None = None, bucketed: bool = False) -> DataFrame:
        """Rows of a generation in the buckets it owns, of those ``wanted``; other files are not opened.

        Bucketed ones are for a join that follows at once: a union of them would promise a partitioning that
        the planner may then give up below it.
        """
        mine = set(g.owned) if wanted is None else set(g.owned) & set(wanted)
        folder = f"{self.path}/data/{g.folder}"
        table = self.spark.table(self._bucketed(g.folder)) if bucketed else self.spark.read.schema(self.schema).parquet(folder)
        if len(mine) < self.buckets:
            names = "|".join(f"{b:05d}" for b in sorted(mine)) or "none"
            table = table.where(F.col("_metadata.file_name").rlike(rf"_({names})\."))
        return table

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def _union(self, parts: Sequence[DataFrame]) -> DataFrame:
        out = self._empty()
        for i, p in enumerate(parts):
            out = p if i == 0 else out.unionByName(p)
        return out

    def read(self, before: int | None = None) -> DataFrame:
        found = self.generations(before)
        rows = self._union([self._scan(g) for g in found])
        return self.fold(rows) if self.fold and len(found) > 1 else rows

    def possible(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """(key, generation, bucket) of the keys that a filter knows, generations by position."""
        found = self.generations(before)
        empty = keys.select(self.key).where("false").select(self.key, F.lit(0).alias("_generation"), F.lit(0).alias("_bucket"))
        if not found:
            return empty
        filters = self._union_filters(found)
        key = F.col(self.key)
        owners = F.array(*[
            F.when(F.array_contains(F.lit(g.owned), self.bucket(key)), F.struct(F.lit(i).alias("_generation"), _page(key, g.pages).alias("_page")))
            for i, g in enumerate(found)
        ])
        probes = keys.select(key).where(key.isNotNull()).distinct().select(key, self.bucket(key).alias("_bucket"), F.explode(F.array_compact(owners)).alias("_o"))
        probes = probes.select(self.key, "_bucket", "_o.*")
        return probes.join(filters, ["_generation", "_bucket", "_page"]).where(_all_set(F.col("_bits"), key)).select(self.key, "_generation", "_bucket")

    def _union_filters(self, found: Sequence[Generation]) -> DataFrame:
        out = None
        for i, g in enumerate(found):
            part = self.spark.read.schema("_bucket int, _page int, _bits binary").parquet(f"{self.path}/filters/{g.folder}")
            part = part.withColumn("_generation", F.lit(i))
            out = part if out is None else out.unionByName(part)
        return out

    def known(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """The distinct ones of ``keys`` that are stored. Stored rows are read for their key, and not moved."""
        from gleaner.session import stored

        found = self.generations(before)
        maybe = stored(self.possible(keys, before))
        # at most one row per generation and bucket
        open_ = [(r["_generation"], r["_bucket"]) for r in maybe.select("_generation", "_bucket").distinct().collect()]
        hits = keys.select(self.key).where("false")
        for i, g in enumerate(found):
            wanted = [b for gen, b in open_ if gen == i]
            if wanted:
                mine = maybe.where(F.col("_generation") == i).select(self.key)
                hits = hits.unionByName(mine.join(self._scan(g, wanted, bucketed=True).select(self.key), self.key, "left_semi"))
        # a key may be in several generations of a table that folds
        return hits.distinct() if self.fold else hits

    # -- writing --------------------------------------------------------------------------

    def _write(self, rows: DataFrame, batch: int, owned: Sequence[int] | None = None) -> Generation:
        folder = f"{batch:012d}-{uuid.uuid4().hex}"
        name = self._bucketed(folder)
        size = Observation()
        # the writer's own partitioning: each task has whole buckets, so a bucket is one file
        dealt = rows.select(*self.columns).repartition(self.buckets, self.key)
        dealt.observe(size, F.count("*").alias("rows")).write.insertInto(name)
        n = size.get["rows"]
        written = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{folder}")
        pages = max(1, -(-n // (self.buckets * PAGE_KEYS)))
        key = F.col(self.key)
        bits = written.where(key.isNotNull()).select(
            self.bucket(key).alias("_bucket"), _page(key, pages).alias("_page"), F.explode(F.array(*_positions(key))).alias("_bit")
        )
        bits.groupBy("_bucket", "_page").agg(F.bitmap_construct_agg(F.col("_bit")).alias("_bits")).write.parquet(f"{self.path}/filters/{folder}")
        return Generation(folder, n, pages, list(range(self.buckets)) if owned is None else sorted(owned))

    def append(self, rows: DataFrame, batch: int) -> None:
        """A new version with ``rows`` added; without ``fold`` their keys must be new.

        Trailing generations that are not much larger than the rows are merged with them, so a row is
        rewritten a logarithmic number of times.
        """
        kept = list(self.generations(batch))
        new = self._write(rows, batch)
        total, small = new.rows, []
        while kept and kept[-1].rows <= 2 * total and len(kept[-1].owned) == self.buckets:
            small.append(kept.pop())
            total += small[-1].rows
        if small:
            merged = self._union([self._scan(g) for g in (*reversed(small), new)])
            new = self._write(self.fold(merged) if self.fold else merged, batch)
        self._commit([*kept, new], batch)

    def upsert(self, rows: DataFrame, batch: int, merge: Callable[[DataFrame], DataFrame], most: int = 8) -> None:
        """A new version in which the buckets that ``rows`` touch are rewritten, all others kept.

        ``rows`` has one row per key. ``merge`` gets the full outer join of the touched stored rows, in
        ``old``, with the given ones, in ``new``, and returns rows of the table. The stored rows are read
        once. More than ``most`` generations are put together by touching all buckets.
        """
        from gleaner.session import stored

        found = self.generations(batch)
        rows = stored(rows)
        everything = list(range(self.buckets))
        touched = everything if len(found) >= most or not found else sorted(r[0] for r in rows.select(self.bucket(F.col(self.key))).distinct().collect())
        given = rows.select(F.col(self.key).alias("_given"), F.struct(*rows.columns).alias("new"))
        parts, free = [], set(touched)
        for g in found:
            mine = sorted(free & set(g.owned))
            if not mine:
                continue
            free -= set(mine)
            old = self._scan(g, mine, bucketed=True)
            old = old.select(F.col(self.key).alias("_stored"), F.struct(*self.columns).alias("old"))
            part = given if len(mine) == self.buckets else given.where(self.bucket(F.col("_given")).isin(mine))
            parts.append(merge(old.join(part, F.col("_stored") == F.col("_given"), "full").select("old", "new")).select(*self.columns))
        if free:  # no generation owns these yet
            old_type = self._empty().select(F.struct(*self.columns).alias("old")).schema["old"].dataType
            part = given.where(self.bucket(F.col("_given")).isin(sorted(free)))
            parts.append(merge(part.select(F.lit(None).cast(old_type).alias("old"), "new")).select(*self.columns))
        new = self._write(self._union(parts), batch, touched)
        rest = [Generation(g.folder, g.rows, g.pages, sorted(set(g.owned) - set(touched))) for g in found]
        self._commit([*[g for g in rest if g.owned], new], batch)


def _page(key: Column, pages: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(pages)).cast("int")


def _positions(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(PAGE_BITS)) for i in range(PROBES)]


def _all_set(bits: Column, key: Column) -> Column:
    """Are all bits of the key set? Bit p is bit p % 8 of byte p / 8."""
    out = F.lit(True)
    for p in _positions(key):
        byte = F.conv(F.hex(F.substring(bits, F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        out &= F.floor(byte / F.pow(F.lit(2), p % 8)) % 2 == 1
    return out

