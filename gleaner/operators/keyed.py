"""Building blocks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import ensure_checkpoint_dir


def top_per_group(
    df: DataFrame,
    keys: Sequence[str | Column],
    order: Sequence[Column],
    n: int = 1,
    rank: str | None = None,
) -> DataFrame:
    """First ``n`` rows of every group.

    A ``row_number() <= n`` filter on top of the window lets Spark cut every group to ``n`` rows
    before the shuffle, so a hot group sends ``n`` rows per task and no more.
    """
    name = rank or "_rn"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out.withColumn(name, F.col(name).cast("bigint")) if rank else out.drop(name)


def global_rank(df: DataFrame, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """1-based rank over the whole table without a single-task window.

    The range-partitioned sort is cut with a checkpoint, so the row numbers inside partitions and
    the partition sizes come from the same sort. Pass narrow rows; ``order`` must be total.
    """
    ensure_checkpoint_dir(df.sparkSession)
    pos = F.monotonically_increasing_id()
    ordered = df.orderBy(*order).withColumn("_pos", pos).checkpoint()
    part = F.shiftright("_pos", 33)
    # one row per partition of the sort
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(rank, F.col("_before") + F.col("_pos").bitwiseAND((1 << 33) - 1) + 1)
        .drop("_part", "_pos", "_before")
    )


def anti_join(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """left_anti against the distinct keys of the right side.

    Nothing is counted beforehand and no side is broadcast by hand: the adaptive planner sees the
    bytes of both shuffled sides, broadcasts below its threshold and splits skewed partitions.
    """
    keys = [on] if isinstance(on, str) else on
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def known_of(history: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Keys of the history that the batch has too.

    The batch is the small side: pass a stored one, whose size the planner knows, and the history
    is only scanned for its key column, not shuffled.
    """
    return history.select(key).join(batch.select(key), key, "left_semi")


def flag_match(left: DataFrame, right: DataFrame, key: str, flag: str) -> DataFrame:
    """Left rows with a boolean: is the key on the right side? ``key`` is unique on the left."""
    marks = right.select(key).distinct().withColumn("_hit", F.lit(True))
    return (
        left.join(marks, key, "left")
        .withColumn(flag, F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


def spread_join(
    facts: DataFrame,
    table: DataFrame,
    key: str,
    weight: str,
    row_id: str,
    total: int,
    slices: int = 2000,
) -> DataFrame:
    """Equi-join of a large table with one row per key whose fact count (``weight``) is known.

    ``total`` is the counted number of facts. Keys with more than 1/``slices`` of them are split
    into as many parts as they need; there are fewer than ``slices`` of them by construction, and
    the list that tags the facts holds the key and one number each, so it can be broadcast. The
    table itself is left to the adaptive planner.
    """
    limit = max(total // slices, 1)
    parts = F.ceil(F.col(weight) / F.lit(limit)).cast("int")
    hot = table.where(F.col(weight) > limit).select(key, parts.alias("_parts"))
    slice_of = F.pmod(F.xxhash64(row_id), F.coalesce("_parts", F.lit(1)).cast("bigint"))
    tagged = facts.join(F.broadcast(hot), key, "left").withColumn("_slice", slice_of.cast("int"))
    copies = table.withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))
    )
    return tagged.drop("_parts").join(copies, [key, "_slice"]).drop("_slice")
