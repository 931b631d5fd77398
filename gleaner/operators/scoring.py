"""Scores of records against query texts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from gleaner import params as P
from gleaner.functions import text as X
from gleaner.session import stored

# Queries whose weights for one term lie in one row of the query index.
QUERY_BLOCK = 1_000
# Terms that more than this part of all facts have are looked up without a shuffle.
HOT_TERMS = 200_000
# Words beyond which facts are shuffled in slices of their terms, one after the other, and frequent terms are
# sought in one of so many records.
SLICE_WORDS = 4_000_000
SLICES = 4
SAMPLE = 16
# Bytes of words in a batch, and of the list of different words in a file.
BATCH_BYTES = 4 << 20
WORD_LIST_BYTES = 16 << 20
# Terms of the queries up to this number are a list that every task holds.
QUERY_TERMS = 1_000_000


def words_of(df: DataFrame, key: str, text: str, stop: Sequence[str] = P.STOP_WORDS) -> DataFrame:
    """(key, _words): the words of each text in their order, as hashes of 64 bits."""
    return df.select(key, F.transform(X.tokens(F.col(text), stop), lambda w: F.xxhash64(w)).alias("_words"))


def term_facts(words: DataFrame, key: str, part: int = 0, parts: int = 1) -> DataFrame:
    """(key, term, tf) of the unigrams and bigrams of each row's words; with ``parts`` only the terms of one part.

    A row's words stay in its task: they are sorted and counted batch by batch.
    """

    # inside, so that workers need not import this package
    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def pair_ids(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return mixed(mixed(first + np.uint64(0x9E3779B97F4A7C15)) + second)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(1)).fill_null(0).to_numpy())
            near = row[1:] == row[:-1]
            term, row = np.concatenate([ids, pair_ids(ids[:-1][near], ids[1:][near])]), np.concatenate([row, row[1:][near]])
            if parts > 1:
                mine = term % np.uint64(parts) == part
                term, row = term[mine], row[mine]
            if not len(term):
                continue
            # one number holds the row and as many upper bits of the term as fit, which sorts much faster than two
            bits = np.uint64(batch.num_rows.bit_length())
            place = (row.astype(np.uint64) << (np.uint64(64) - bits)) | (term >> bits)
            order = np.argsort(place)
            term, row, place = term[order], row[order], place[order]
            differ = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
            if (differ & (place[1:] == place[:-1])).any():  # terms of a row that differ in the lower bits only
                order = np.lexsort((term, row))
                term, row = term[order], row[order]
                differ = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
            new = np.flatnonzero(np.append(True, differ))
            tf = np.diff(np.append(new, len(term))).astype(np.int32)
            facts = [batch.column(0).take(pa.array(row[new])), pa.array(term[new].view(np.int64)), pa.array(tf)]
            yield pa.RecordBatch.from_arrays(facts, [key, "term", "tf"])

    words.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    schema = StructType([words.schema[key], StructField("term", LongType()), StructField("tf", IntegerType())])
    return words.select(key, "_words").mapInArrow(run, schema)


def plain_lengths(words: DataFrame, key: str, idf: Callable[[Column], Column], slices: int, sample: int) -> DataFrame:
    """(key, _plain), several rows a key: sums of squared weights, with the frequency of every term in all records.

    Facts of frequent terms, found in one of ``sample`` records and counted in all, are summed where they lie.
    Those of the other terms meet by term, counted and weighed in one shuffle, a slice of the terms at a time:
    the files of a slice's shuffle are gone when the next one begins.
    """
    plain = F.pow((F.lit(1.0) + F.log("tf")) * idf(F.col("df")), 2).alias("_plain")
    some = words.where(F.pmod(F.xxhash64(key), F.lit(sample)) == 0) if sample > 1 else words
    # n words have fewer than 2 n facts, so there are fewer than HOT_TERMS by construction: they can be broadcast
    limit = max(2 * (some.agg(F.sum(F.size("_words"))).first()[0] or 0) // HOT_TERMS, 1)
    counts = term_facts(some, key).groupBy("term").agg(F.count("*").alias("df"))
    hot = stored(counts.where(F.col("df") > limit).select("term"), cleanup=True)
    frequent = stored(term_facts(words, key).join(F.broadcast(hot), "term").select(key, "term", "tf"))
    known = frequent.groupBy("term").agg(F.count("*").alias("df"))
    sums = [frequent.join(F.broadcast(known), "term").select(key, plain)]
    for part in range(slices):
        rare = term_facts(words, key, part, slices).join(F.broadcast(hot), "term", "left_anti")
        rare = rare.withColumn("df", F.count("*").over(Window.partitionBy("term")))
        sums.append(stored(rare.groupBy(key).agg(F.sum(plain).alias("_plain")), cleanup=True))
    return reduce(DataFrame.unionByName, sums)


def query_index(queries: DataFrame, seen: DataFrame, idf: Callable[[Column], Column], query_key: str, blocks: int) -> DataFrame:
    """(term, _idf, _idf_q, _queries): for every term that records have, the unit weights of the queries that hold it.

    ``queries`` is (query_key, term, tf), ``seen`` (term, df) of the terms both sides have. A query counts as
    a record holding its terms. A term's queries are dealt to ``blocks`` rows, so that none is too long.
    """
    q = queries.join(seen, "term", "left").withColumn("_idf_q", idf(F.coalesce("df", F.lit(0)) + 1))
    q = q.withColumn("_wq", (F.lit(1.0) + F.log("tf")) * F.col("_idf_q"))
    length = F.sqrt(F.sum(F.col("_wq") * F.col("_wq")).over(Window.partitionBy(query_key)))
    q = q.withColumn("_wq", F.col("_wq") / length).where(F.col("df").isNotNull())
    entry = F.struct(F.col(query_key).alias("q"), "_wq")
    block = F.pmod(F.xxhash64(query_key), F.lit(blocks))
    listed = q.groupBy("term", "df", block.alias("_block")).agg(F.collect_list(entry).alias("_queries"))
    return listed.select("term", idf(F.col("df")).alias("_idf"), idf(F.col("df") + 1).alias("_idf_q"), "_queries")


def tfidf_cosine(
    docs: DataFrame,
    queries: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    query_key: str = "query_id",
    query_text: str = "text",
    stop: Sequence[str] = P.STOP_WORDS,
) -> DataFrame:
    """(query_key, key, score) of all pairs that share a term; other pairs score 0.

    Each query is fitted with the records on its own, as if it were one more record: smooth idf,
    1 + ln(tf), unit length. A record's length under a query differs from its plain length only in
    the shared terms, so lengths are summed once and corrected per pair.

    Any number of queries takes one pass. Texts are tokenised once and written as their words' hashes, from
    which the facts (key, term, tf) are counted anew for each step, as they are many times as large. Dot
    products need only the facts whose term a query has: these are dealt by record and meet the query index
    there, so pairs are summed, and compared by what follows, where they arise. The index is held by every task
    up to QUERY_TERMS entries; beyond, no side is broadcast by hand: the planner knows the sizes of the stored tables.
    """
    texts = Observation()
    rows = words_of(docs, key, text, stop).observe(texts, F.count_if(F.size("_words") > 0).alias("records"), F.sum(F.size("_words")).alias("words"))
    # words repeat, so a dictionary of them for each file is worth its place
    words = stored(rows, **{"parquet.dictionary.page.size": str(WORD_LIST_BYTES)})
    records, n_words = texts.get["records"], texts.get["words"] or 0
    n = records + 1
    many = n_words > SLICE_WORDS
    slices, sample = (SLICES, SAMPLE) if many else (1, 1)

    def idf(seen: Column) -> Column:
        return F.log(F.lit(1.0 + n) / (F.lit(1.0) + seen)) + F.lit(1.0)

    sums = plain_lengths(words, key, idf, slices, sample)
    lengths = stored(sums.groupBy(key).agg(F.sum("_plain").alias("_base")), cleanup=True)

    asked = stored(term_facts(words_of(queries, query_key, query_text, stop), query_key))
    terms = stored(asked.select("term").distinct())
    few = asked.count() <= QUERY_TERMS
    listed = F.broadcast if few else lambda df: df
    # a long list meets the facts by term, so slice by slice
    parts = 1 if few else slices
    found = [stored(term_facts(words, key, part, parts).join(listed(terms), "term", "left_semi"), cleanup=True) for part in range(parts)]
    hits = reduce(DataFrame.unionByName, found)
    seen = hits.groupBy("term").agg(F.count("*").alias("df"))
    blocks = -(-asked.select(query_key).distinct().count() // QUERY_BLOCK) or 1
    index = stored(query_index(asked, seen, idf, query_key, blocks))
    w, e = F.lit(1.0) + F.log("tf"), F.col("_e")
    # merged, so that both sides are dealt by record, which a broadcast of the smaller one would not do
    mine = hits.join(lengths.hint("merge"), key).select(key, "_base", "term", w.alias("_w"))
    pairs = mine.join(listed(index), "term").select(key, "_base", "_w", "_idf", "_idf_q", F.explode("_queries").alias("_e"))
    w = F.col("_w")
    scores = pairs.groupBy(key, "_base", e["q"].alias(query_key)).agg(
        F.sum(w * F.col("_idf_q") * e["_wq"]).alias("dot"),
        F.sum(w * w * (F.col("_idf_q") * F.col("_idf_q") - F.col("_idf") * F.col("_idf"))).alias("len2"),
    )
    return scores.select(query_key, key, (F.col("dot") / F.sqrt(F.col("_base") + F.col("len2"))).alias("score"))


def score_against(docs: DataFrame, query: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``docs`` with the cosine to the single query text; 0.0 without shared terms."""
    hits = tfidf_cosine(docs.select(key, text), query, key, text).select(key, F.col("score").alias("_s"))
    return docs.join(hits, key, "left").withColumn("base", F.coalesce("_s", F.lit(0.0))).drop("_s")


def semantic_cosine(df: DataFrame, vector: str, query: Sequence[float]) -> DataFrame:
    """Cosine with one query vector, negatives cut to 0."""
    length = math.sqrt(sum(float(x) * float(x) for x in query)) or 1.0
    unit = F.array(*[F.lit(float(x) / length) for x in query])

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    v = F.transform(vector, lambda x: x.cast("double"))
    staged = df.withColumn("_v", v)
    norm = F.sqrt(dot(F.col("_v"), F.col("_v")))
    cos = F.when(norm > 0, dot(F.col("_v"), unit) / norm).otherwise(F.lit(0.0))
    return staged.withColumn("score", F.greatest(cos, F.lit(0.0))).drop("_v")


# -- keyword terms and boosts ----------------------------------------------------------


def keyword_hits(
    title: Column, description: Column, keywords: Iterable[str], title_weight: float = 2.0
) -> Column:
    """Sum over keywords: ``title_weight`` for a title hit, else 1 for a description hit."""
    words = list(keywords)

    def total(t: Column, d: Column) -> Column:
        hits = F.lit(0.0)
        for k in words:
            hits = hits + F.when(X.whole_word(t, k), F.lit(float(title_weight))).when(
                X.whole_word(d, k), F.lit(1.0)
            ).otherwise(F.lit(0.0))
        return hits

    low_title, low_text = F.lower(X.text_of(title)), F.lower(X.text_of(description))
    return X.let(low_title, lambda t: X.let(low_text, lambda d: total(t, d)))


def expanded_query(query: Column, focus: P.FocusRules, blend_active: bool) -> Column:
    if blend_active or not focus.expand or not focus.keywords:
        return query
    return F.concat_ws(" ", query, F.lit(" ".join(list(focus.keywords) * focus.expand_weight)))


def focus_boost(base: Column, title: Column, description: Column, focus: P.FocusRules) -> Column:
    if not focus.keywords:
        return base
    hits = keyword_hits(title, description, focus.keywords, focus.title_weight)
    return F.least(base + F.least(hits * focus.per_hit, F.lit(focus.cap)), F.lit(1.0))


def target_fit(title: Column, description: Column, blend: P.BlendRules) -> Column:
    if not blend.keywords or blend.saturation <= 0:
        return F.lit(0.0)
    hits = keyword_hits(title, description, blend.keywords, blend.title_weight)
    return F.least(hits / F.lit(float(blend.saturation)), F.lit(1.0))


def blend_score(base: Column, fit: Column, w_resume: float, w_target: float) -> Column:
    return F.least(base * w_resume + fit * w_target, F.lit(1.0))


def salary_boost(score: Column, lo: Column, hi: Column, pay: P.PayRules) -> Column:
    if not pay.enabled or pay.target <= 0:
        return score
    amount = F.coalesce(hi, lo)
    ratio = F.least(amount / F.lit(float(pay.target)), F.lit(1.0))
    return F.when(amount > 0, F.least(score + ratio * pay.boost, F.lit(1.0))).otherwise(score)


def location_boost(score: Column, location: Column, place: P.PlaceRules) -> Column:
    if not place.home or place.boost <= 0:
        return score
    near = X.contains_any(F.lower(X.text_of(location)), [c.lower() for c in place.home])
    return F.when(near, F.least(score + place.boost, F.lit(1.0))).otherwise(score)


def apply_boosts(
    df: DataFrame,
    base: str,
    blend: P.BlendRules | None,
    focus: P.FocusRules,
    pay: P.PayRules,
    place: P.PlaceRules,
    name: str = "score",
) -> DataFrame:
    """base -> blend or focus -> pay -> place, one projection."""
    title, text = F.col("title"), F.col("description")
    if blend is not None and blend.enabled:
        s = blend_score(F.col(base), target_fit(title, text, blend), blend.w_resume, blend.w_target)
    else:
        s = focus_boost(F.col(base), title, text, focus)
    s = salary_boost(s, F.col("salary_min"), F.col("salary_max"), pay)
    return df.withColumn(name, location_boost(s, F.col("location"), place))


# -- profiles and categories -----------------------------------------------------------


def category_keywords(categories: Sequence[P.Category], names: Sequence[str] = ()) -> list[str]:
    wanted = {n.lower() for n in names}
    out: dict[str, str] = {}
    for c in categories:
        if c.enabled and (not wanted or c.name.lower() in wanted):
            for k in c.keywords:
                if k.strip():
                    out.setdefault(k.strip().lower(), k.strip())
    return list(out.values())


def resolve_profile(profiles: Sequence[P.Profile], active: str) -> P.Profile:
    """The named profile, else the first, else a plain one."""
    by_name = {p.name: p for p in reversed(profiles)}
    return by_name.get(active) or (profiles[0] if profiles else P.Profile("default"))


def profile_blend(profile: P.Profile, categories: Sequence[P.Category]) -> P.BlendRules:
    return P.BlendRules(
        w_resume=profile.w_resume,
        w_target=profile.w_target,
        keywords=category_keywords(categories, profile.categories),
    )


def score_profiles(
    df: DataFrame,
    base: str,
    profiles: Sequence[P.Profile],
    categories: Sequence[P.Category],
    default_threshold: float,
) -> DataFrame:
    """Every row under every profile in one pass: profile, gate, threshold, score, above."""
    entries = []
    for p in profiles:
        blend = profile_blend(p, categories)
        fit = target_fit(F.col("title"), F.col("description"), blend)
        entries.append(
            F.struct(
                F.lit(p.name).alias("profile"),
                F.lit(p.gate).alias("gate"),
                F.lit(default_threshold if p.threshold is None else p.threshold).alias("threshold"),
                blend_score(F.col(base), fit, p.w_resume, p.w_target).alias("score"),
            )
        )
    out = df.withColumn("_p", F.explode(F.array(*entries))).select("*", "_p.*").drop("_p")
    return out.withColumn("above", F.col("score") >= F.col("threshold"))


def best_category(title: Column, description: Column, categories: Sequence[P.Category]) -> Column:
    """Enabled category with a title hit and the most 2*title + description hits; else null."""
    enabled = [c for c in categories if c.enabled]
    if not enabled:
        return F.lit(None).cast("string")

    def count(hay: Column, words: Sequence[str]) -> Column:
        total = F.lit(0)
        for k in words:
            total = total + F.when(X.whole_word(hay, k), 1).otherwise(0)
        return total

    def entry(pos: int, c: P.Category, t: Column, d: Column) -> Column:
        return X.let(
            count(t, c.keywords),
            lambda n: F.when(
                n > 0,
                F.struct(
                    (n * 2 + count(d, c.keywords)).alias("hits"),
                    F.lit(-pos).alias("pos"),
                    F.lit(c.name).alias("name"),
                ),
            ),
        )

    def best(t: Column, d: Column) -> Column:
        entries = [entry(pos, c, t, d) for pos, c in enumerate(enabled)]
        return F.array_max(F.array_compact(F.array(*entries)))["name"]

    low_title, low_text = F.lower(X.text_of(title)), F.lower(X.text_of(description))
    return X.let(low_title, lambda t: X.let(low_text, lambda d: best(t, d)))


def best_profile(title: Column, description: Column) -> Column:
    """Document profile with the most keyword occurrences, title keywords counting two more."""

    def hits(t: Column, d: Column, words: Sequence[str]) -> Column:
        total = F.lit(0)
        for k in words:
            pattern = rf"(?U)\b{X.escape(k)}\b"
            # title words occur in the text too, so one substring test guards both
            total = total + F.when(
                F.contains(d, F.lit(k)),
                F.regexp_count(d, F.lit(pattern)) + F.when(X.whole_word(t, k), 2).otherwise(0),
            ).otherwise(0)
        return total

    def best(t: Column, d: Column) -> Column:
        entries = [
            F.struct(hits(t, d, words).alias("hits"), F.lit(-pos).alias("pos"), F.lit(name).alias("name"))
            for pos, (name, words) in enumerate(P.PROFILE_KEYWORDS.items())
        ]
        return X.let(
            F.array_max(F.array(*entries)),
            lambda b: F.when(b["hits"] > 0, b["name"]).otherwise(F.lit("general")),
        )

    low_title = F.lower(X.text_of(title))
    low_text = F.lower(X.title_and_text(title, description))
    return X.let(low_title, lambda t: X.let(low_text, lambda d: best(t, d)))


# -- several query texts ----------------------------------------------------------------


@dataclass(frozen=True)
class Chain:
    """What follows the base cosine in the full score: blend or focus, then pay, then place."""

    blend: P.BlendRules | None = None
    focus: P.FocusRules = field(default_factory=P.FocusRules)
    pay: P.PayRules = field(default_factory=P.PayRules)
    place: P.PlaceRules = field(default_factory=P.PlaceRules)

    def parts(self, df: DataFrame, key: str) -> DataFrame:
        """(key, _fit, _pay, _near): all that the score needs of a record besides its base, worked out once.

        Boosts only add to a score, so each is the number it adds to a score of 0.
        """
        title, text = F.col("title"), F.col("description")
        blended = self.blend is not None and self.blend.enabled
        fit = target_fit(title, text, self.blend) if blended else focus_boost(F.lit(0.0), title, text, self.focus)
        pay = salary_boost(F.lit(0.0), F.col("salary_min"), F.col("salary_max"), self.pay)
        near = location_boost(F.lit(0.0), F.col("location"), self.place)
        return df.select(key, fit.alias("_fit"), pay.alias("_pay"), near.alias("_near"))

    def score(self, base: Column) -> Column:
        """The full score of a base, beside the columns of ``parts``."""
        if self.blend is not None and self.blend.enabled:
            s = blend_score(base, F.col("_fit"), self.blend.w_resume, self.blend.w_target)
        else:
            s = F.least(base + F.col("_fit"), F.lit(1.0)) if self.focus.keywords else base
        for boost in ("_pay", "_near"):
            s = F.when(F.col(boost) > 0, F.least(s + F.col(boost), F.lit(1.0))).otherwise(s)
        return s


def variant_scores(
    docs: DataFrame,
    variants: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "label",
    score: Callable[..., DataFrame] = tfidf_cosine,
    chain: Chain | None = None,
    dense: bool = False,
    digits: int | None = None,
) -> DataFrame:
    """(key, label, score) of the pairs whose texts share something; ``score`` may be any scorer.

    With a ``chain`` the score is the full one, and ``zero`` is beside it: the score of the record with any
    variant it shares nothing with (0.0 without a chain). The boosts are worked out once per record and
    meet the sparse pairs. ``dense`` gives all pairs, records times variants, with those scores filled in.
    ``digits`` rounds all scores, so that equal ones tie.
    """

    def rounded(c: Column) -> Column:
        return c if digits is None else F.round(c, digits)

    pairs = score(docs.select(key, text), variants, key, text, query_key=label).select(key, label, F.col("score").alias("_base"))
    parts = docs.select(key) if chain is None else chain.parts(docs, key)
    final = F.col("_base") if chain is None else chain.score(F.col("_base"))
    zero = F.lit(0.0) if chain is None else chain.score(F.lit(0.0))
    if dense:
        labels = [r[0] for r in variants.select(label).distinct().collect()]
        grid = parts.withColumn(label, F.explode(F.array(*[F.lit(x) for x in labels])))
        filled = grid.join(pairs, [key, label], "left").withColumn("_base", F.coalesce("_base", F.lit(0.0)))
        return filled.select(key, label, rounded(final).alias("score"))
    found = pairs.where("_base <> 0") if chain is None else pairs.where("_base <> 0").join(parts, key)
    out = found.select(key, label, rounded(final).alias("score"), *([] if chain is None else [rounded(zero).alias("zero")]))
    return out if chain is not None else out.where("score <> 0")


def zero_scores(docs: DataFrame, chain: Chain | None, key: str = "doc_id", digits: int | None = None) -> DataFrame:
    """(key, zero): every record's score with a variant it shares nothing with."""
    if chain is None:
        return docs.select(key, F.lit(0.0).alias("zero"))
    zero = chain.score(F.lit(0.0))
    return chain.parts(docs, key).select(key, (zero if digits is None else F.round(zero, digits)).alias("zero"))


def best_variant(
    pairs: DataFrame, docs: DataFrame, variants: DataFrame, key: str = "doc_id", label: str = "label",
    chain: Chain | None = None, digits: int | None = None,
) -> DataFrame:
    """Best variant per record; the first label wins ties and takes records that no variant lifts.

    A base never lowers a score, so no variant is below the record's zero score, and where the best pair is
    not above it, all variants tie.
    """
    best = F.min_by(F.struct(label, "score"), F.struct((-F.col("score")).alias("s"), F.col(label).alias("l")))
    lifted = pairs.where("score > 0" if chain is None else "score > zero")
    top = lifted.groupBy(key).agg(best.alias("_b"))
    first = variants.agg(F.min(label)).scalar()
    return zero_scores(docs, chain, key, digits).join(top, key, "left").select(
        key,
        F.coalesce(F.col(f"_b.{label}"), first).alias("best_label"),
        F.coalesce("_b.score", "zero").alias("best_score"),
    )


def variant_summary(
    pairs: DataFrame, docs: DataFrame, variants: DataFrame, threshold: float, key: str = "doc_id", label: str = "label",
    chain: Chain | None = None, digits: int | None = None,
) -> DataFrame:
    """Wins, mean over all records and count above per variant, and whether it is the overall winner.

    A variant's sums are those of its pairs, and the zero scores of the records it has no pair with: all
    records' less its pairs'. The pairs are read several times, so they are stored first: one scoring pass.
    """
    if "zero" not in pairs.columns:
        pairs = pairs.withColumn("zero", F.lit(0.0))
    pairs = stored(pairs, cleanup=True)
    reached, zero_reached = F.col("score") >= threshold, F.col("zero") >= threshold
    zeros = stored(zero_scores(docs, chain, key, digits).agg(
        F.count("*").alias("records"), F.coalesce(F.sum("zero"), F.lit(0.0)).alias("zeros"), F.count_if(zero_reached).alias("zeros_above")
    ))
    sums = pairs.groupBy(label).agg(
        F.sum(F.col("score") - F.col("zero")).alias("lift"),
        (F.count_if(reached) - F.count_if(zero_reached)).alias("lifted_above"),
    )
    wins = best_variant(pairs, docs, variants, key, label, chain, digits).groupBy(F.col("best_label").alias(label)).agg(
        F.count("*").alias("wins")
    )
    records, zero_sum, zeros_above = (zeros.select(c).scalar() for c in ("records", "zeros", "zeros_above"))
    per = (
        variants.select(label)
        .distinct()
        .join(sums, label, "left")
        .join(wins, label, "left")
        .select(
            label,
            F.coalesce("wins", F.lit(0)).cast("bigint").alias("wins"),
            ((F.coalesce("lift", F.lit(0.0)) + zero_sum) / records).alias("avg_score"),
            (F.coalesce("lifted_above", F.lit(0)) + zeros_above).alias("above"),
        )
    )
    per = stored(per)
    winner = per.agg(
        F.min_by(F.struct(label, "avg_score"), F.struct((-F.col("avg_score")).alias("s"), F.col(label))).alias("w")
    )
    top = winner.select(F.when(F.col("w.avg_score") > 0, F.col(f"w.{label}"))).scalar()
    return per.withColumn("overall_winner", F.coalesce(F.col(label) == top, F.lit(False)))
