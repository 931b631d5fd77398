"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. A source whose target is r times its size takes every
document floor(r) times for certain; the rest of the target comes from a sample without repetition. Its
inclusion probabilities are proportional to the documents' words, scaled so that the expected words
are those wanted; a document whose probability would pass 1 is one more certain copy. The others are
ranked by their random odds u / (1 - u) over their inclusion odds p / (1 - p), and taken in that order up to
the words that are wanted. A document that does not fit ends one pass; ``PASSES`` go on behind it with
those that still fit, and the last place goes to the document whose size fits best. No document is taken more
than ``cap`` times, rounded up.

Everything is DataFrame operations. The scale comes from counts per source and size. The cut in a source's
order is found from sums per bin of the rank, twice refined, so no source is ever sorted or gathered
in one task; u comes from a hash of doc_id, so reruns agree. The driver sees one number per round of
sharing out the targets.

Defined cases: a null text has size 0 and is not sampled; null is a source of its own, the last; rows
that repeat doc_id, source and size are taken all alike, with the words of all; sources without words have
target 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.base import free_names, n_words, stored
from gleaner.operators.keyed import global_rank

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = "mix"
# Each of two refinements tells so many bins of the rank apart.
BINS = 1 << 12
# Passes over the documents that still fit.
PASSES = 3
# A source's row is copied so often where it is joined to its documents.
COPIES = 32


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number between 0 and 1, neither included, that depends on the key only."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def pareto_rank(u: Column, p: Column) -> Column:
    return (u / (1 - u)) / (p / (1 - p))


def with_source(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Rows and what ``params`` says of their source; a large source is spread over ``COPIES`` keys."""
    copies = params.withColumnRenamed("source", "_source").withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))
    )
    copy = F.pmod(F.xxhash64("doc_id"), F.lit(COPIES)).cast("int")
    return (
        rows.withColumn("_row_copy", copy)
        .join(copies, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_row_copy") == F.col("_copy")))
        .drop("_source", "_copy", "_row_copy")
    )


def level(sources: DataFrame, share: float, cap: float) -> float:
    """Words per unit of weight after the excess of full sources has been shared out again."""
    full = F.lit(cap) * F.col("source_size")
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return 0.0
    now, before = share * total / weights, None
    while now != before:
        is_full = full <= F.lit(now) * F.col("weight")
        used, open_weights = sources.agg(F.sum(F.when(is_full, full)), F.sum(F.when(~is_full, F.col("weight")))).first()
        if not open_weights:
            return float("inf")
        before, now = now, (share * total - (used or 0.0)) / open_weights
    return now


def source_targets(units: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, weight, target); weights go round the sources in code-point order."""
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    ordered = global_rank(sizes, [F.col("source").isNull(), F.col("source")], "_nth")
    turn = F.pmod(F.col("_nth") - 1, F.lit(len(weights))).cast("int")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)
    sources = stored(ordered.select("source", "source_size", weight.alias("weight")))
    words = level(sources, share, cap)
    target = F.least(F.lit(cap) * F.col("source_size"), F.lit(words) * F.col("weight"))
    return sources.withColumn("target", target)


def sample_scale(units: DataFrame) -> DataFrame:
    """(source, scale, certain_from, missing, mean_odds) of sources with a sample.

    Documents of ``certain_from`` words or more are certain; the others have probability scale * words, which
    together expect the ``missing`` words. One row per source and size: larger sizes become certain first.
    """
    sizes = units.where("need > 0 AND mass > 0").groupBy("source", "need", "mass").agg(F.count("*").alias("k"))
    smaller = Window.partitionBy("source").orderBy("mass")
    larger = Window.partitionBy("source").orderBy(F.col("mass").desc()).rowsBetween(Window.unboundedPreceding, -1)
    square = F.col("mass").cast("decimal(19,0)") * F.col("mass") * F.col("k")
    sums = sizes.select(
        "source", "mass",
        (F.col("need") - F.coalesce(F.sum(F.col("mass") * F.col("k")).over(larger), F.lit(0))).alias("missing"),
        F.sum(F.col("mass") * F.col("k")).over(smaller).alias("words"),
        F.sum(square.cast("decimal(38,0)")).over(smaller).cast("double").alias("squares"),
    )
    first = sums.where(F.col("missing") * F.col("mass") < F.col("squares")).groupBy("source")
    first = first.agg(F.max(F.struct("mass", "missing", "words", "squares")).alias("f"))
    mean = F.col("f.missing") / F.col("f.words")
    return first.select(
        "source", (F.col("f.missing") / F.col("f.squares")).alias("scale"), F.col("f.mass").alias("largest"),
        F.col("f.missing").alias("missing"), (mean / (1 - mean)).alias("mean_odds"),
    )


def cut_bins(rows: DataFrame, bin_: Column, before: Column) -> DataFrame:
    """(source, bin, before) of the bin in which a source's words reach what is ``missing``."""
    sums = rows.groupBy("source", "missing", before.alias("start"), bin_.alias("bin")).agg(F.sum("mass").alias("mass"))
    w = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.col("start") + F.coalesce(F.sum("mass").over(w), F.lit(0)))
    reached = sums.where("before <= missing").groupBy("source")
    return reached.agg(F.max(F.struct("bin", "before")).alias("cut")).select("source", "cut.bin", "cut.before")


def unit() -> Column:
    """A document's place in the order of its source."""
    return F.struct("q", "doc_id", "size")


def one_pass(open_: DataFrame) -> DataFrame:
    """(source, bin, cut, got): how far the order of each source's documents reaches, and their words.

    ``open_`` has the documents that fit into what is ``missing``.
    """
    coarse = F.floor(F.col("fine") / BINS)
    first = stored(cut_bins(open_, coarse, F.lit(0)))
    inside = with_source(open_, first).where(coarse == F.col("bin"))
    second = stored(cut_bins(inside, F.col("fine"), F.col("before")))
    # the documents of that part, one by one
    last = with_source(open_, second).where("fine = bin").withColumn("unit", unit())
    w = Window.partitionBy("source").orderBy("unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("through", F.col("before") + F.sum("mass").over(w)).where("through <= missing")
    ends = last.groupBy("source").agg(F.max("unit").alias("cut"), F.max("through").alias("through"))
    s2 = second.withColumnRenamed("source", "_s")
    return s2.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        F.col("_s").alias("source"), F.col("bin"), "cut", F.coalesce("through", "before").alias("got")
    )


def by_source(sources: DataFrame, more: DataFrame) -> DataFrame:
    """``sources`` with the columns of ``more``, null where it has no row."""
    m = more.withColumnRenamed("source", "_s")
    return sources.join(m, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    units = stored(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))

    targets = source_targets(units, weights, share, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio)
    need = F.when(ratio > whole, F.col("target") - whole * F.col("source_size")).otherwise(F.lit(0.0))
    targets = stored(targets.select("source", "source_size", "target", whole.alias("whole"), need.alias("need")))
    wanted = stored(with_source(units.withColumn("mass", F.col("size") * F.col("n")), targets))

    # one row per source from here on: what is still missing
    sources = stored(by_source(targets.select("source"), sample_scale(wanted)))
    p = F.col("scale") * F.col("mass")
    rank = uniform(F.col("doc_id"), seed)
    rank = pareto_rank(rank, p) * F.col("mean_odds")
    may = (F.col("mass") > 0) & (F.col("mass") <= F.col("largest"))
    ranked = with_source(wanted, sources).select(
        "doc_id", "source", "size", "n", "source_size", "target", "whole", "mass",
        F.when(may, rank / (1 + rank)).alias("q"),
        # certain copies are chosen from the start
        F.coalesce((F.col("mass") > F.col("largest")), F.lit(False)).alias("chosen"),
    )
    fine = F.least(F.floor(F.col("q") * (BINS * BINS)), F.lit(BINS * BINS - 1))
    ranked = stored(ranked.withColumn("fine", fine))
    sources = sources.select("source", "missing")
    for _ in range(PASSES):
        open_ = with_source(ranked.where("q IS NOT NULL AND NOT chosen"), sources).where("mass <= missing")
        ends = stored(by_source(sources, one_pass(open_)))
        within = (F.col("fine") < F.col("bin")) | ((F.col("fine") == F.col("bin")) & F.coalesce(unit() <= F.col("cut"), F.lit(False)))
        within = F.coalesce(F.col("q").isNotNull() & (F.col("mass") <= F.col("missing")) & within, F.lit(False))
        ranked = stored(with_source(ranked, ends).withColumn("chosen", F.col("chosen") | within).select(*ranked.columns))
        sources = ends.select("source", (F.col("missing") - F.coalesce("got", F.lit(0))).alias("missing"))
    # the document outside the sample that comes closest to what is still missing
    off = F.abs(F.col("mass") - F.col("missing"))
    extra = with_source(ranked.where("q IS NOT NULL AND NOT chosen"), sources).where(off < F.col("missing")).groupBy("source")
    extra = stored(by_source(sources, extra.agg(F.min(F.struct(off.alias("off"), unit().alias("unit"))).alias("extra"))))
    sampled = (F.col("chosen") | F.coalesce(unit() == F.col("extra.unit"), F.lit(False))).cast("bigint")
    out = with_source(ranked, extra).withColumn("copies", F.col("whole") + sampled)
    return out.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("_row"),
    ).drop("_row")


def take(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them; a repeated doc_id as its largest number."""
    key, times, nth = free_names(docs, "key", "times", "nth")
    wanted = mixed.groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(times)).where(F.col(times) > 0)
    found = docs.join(wanted, F.col(doc_id).eqNullSafe(F.col(key)))
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times)))
    return found.withColumn(nth, each).select(*docs.columns)
