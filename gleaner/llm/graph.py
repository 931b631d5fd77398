"""Connected components of a large edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.base import stored


def _checksum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that is not the smallest of its component.

    Alternates two steps until nothing changes. Large star: every node hands its larger neighbours
    the smallest node it knows. Small star: the same for its smaller neighbours and itself. Both
    are a ``min`` per node (combined before the shuffle) and one join back, so no neighbour list is
    ever collected; the driver sees one checksum per round. Edges with a null end are ignored.
    """
    link = F.col(a) != F.col(b)
    e = edges.where(link).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = stored(e)
    state = _checksum(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        before, state = state, _checksum(e)
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
