"""Queries over scores, categories, profiles and several query texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import params as P
from gleaner.functions import money as M
from gleaner.operators import scoring
from gleaner.plans import sqltext as S
from gleaner.plans.cases import Tables, case, r6, sql_list
from gleaner.plans.cases_filters import with_extracts
from gleaner.plans.cases_state import QUERY_TEXT, SCAN, boosts_sql, query_row

c = F.col

_LONGEST = "SELECT 0 AS q, text AS t FROM (SELECT * FROM benchmark ORDER BY length(text) DESC, item_id LIMIT 1)"
_DOCS = "SELECT doc_id AS k, text AS t FROM documents"
_VARIANTS = "SELECT 'item' || item_id AS q, text AS t FROM benchmark"


def longest_text(t: Tables) -> DataFrame:
    """The longest benchmark text serves as the query."""
    best = F.max_by("text", F.struct(F.length("text").alias("n"), -c("item_id")))
    return t.benchmark.agg(best.alias("text")).withColumn("query_id", F.lit(0))


def variants(t: Tables) -> DataFrame:
    return t.benchmark.select(F.concat(F.lit("item"), "item_id").alias("label"), "text")


@case(
    "tfidf_cosine",
    "WITH " + S.tfidf(_DOCS, _LONGEST) + "SELECT k AS doc_id, round(coalesce(score, 0), 6) AS score FROM (SELECT doc_id AS k FROM documents) LEFT JOIN tfidf USING (k)",
)
def _(t: Tables) -> DataFrame:
    out = scoring.score_against(t.documents.select("doc_id", "text"), longest_text(t))
    return out.select("doc_id", r6("base").alias("score"))


_UNIT = "CAST((SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) AS DOUBLE[])"


@case(
    "semantic_cosine",
    f"SELECT vec_id, round(greatest(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_UNIT}), 0), 6) AS score FROM embeddings",
)
def _(t: Tables) -> DataFrame:
    query = t.embeddings.agg(F.min_by("embedding", "vec_id").alias("v")).first()["v"]
    return scoring.semantic_cosine(t.embeddings, "embedding", query).select("vec_id", r6("score").alias("score"))


FOCUS = P.FocusRules(keywords=["data", "lab", "python"], expand=True)


@case(
    "query_expansion",
    "SELECT item_id, text || ' ' || repeat('data lab python ', 2) || 'data lab python' AS expanded, text AS blended FROM benchmark",
)
def _(t: Tables) -> DataFrame:
    return t.benchmark.select(
        "item_id",
        scoring.expanded_query(c("text"), FOCUS, False).alias("expanded"),
        scoring.expanded_query(c("text"), FOCUS, True).alias("blended"),
    )


_BASE = "greatest(coalesce(score, 0), 0)"


def based(t: Tables) -> DataFrame:
    return t.postings.withColumn("base", F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)))


@case(
    "focus_boost",
    f"SELECT arrival, round(least({_BASE} + least({S.keyword_hits(FOCUS.keywords)} * 0.05::DOUBLE, 0.25::DOUBLE), 1), 6) AS score FROM postings",
)
def _(t: Tables) -> DataFrame:
    s = scoring.focus_boost(c("base"), c("title"), c("description"), FOCUS)
    return based(t).select("arrival", r6(s).alias("score"))


BLEND = P.BlendRules(keywords=["data", "lab", "research", "widget", "python", "technician"])
_FIT = f"least({S.keyword_hits(BLEND.keywords)} / 6.0::DOUBLE, 1)"


@case("target_fit", f"SELECT arrival, round({_FIT}, 6) AS fit FROM postings")
def _(t: Tables) -> DataFrame:
    return t.postings.select("arrival", r6(scoring.target_fit(c("title"), c("description"), BLEND)).alias("fit"))


@case("blend_score", f"SELECT arrival, round(least({_BASE} * 0.6::DOUBLE + {_FIT} * 0.4::DOUBLE, 1), 6) AS score FROM postings")
def _(t: Tables) -> DataFrame:
    fit = scoring.target_fit(c("title"), c("description"), BLEND)
    return based(t).select("arrival", r6(scoring.blend_score(c("base"), fit, 0.6, 0.4)).alias("score"))


@case(
    "salary_boost",
    f"""WITH p AS ({S.salary_bounds('postings')})
SELECT arrival, round(CASE WHEN coalesce(salary_max, salary_min) > 0 THEN least({_BASE} + least(coalesce(salary_max, salary_min) / 60000.0::DOUBLE, 1) * 0.1::DOUBLE, 1) ELSE {_BASE} END, 6) AS score FROM p""",
)
def _(t: Tables) -> DataFrame:
    p = based(t).withColumn("_pay", M.salary_from_text(c("description")))
    s = scoring.salary_boost(c("base"), c("_pay.min"), c("_pay.max"), P.PayRules(True, 60_000, 0.1))
    return p.select("arrival", r6(s).alias("score"))


@case(
    "location_boost",
    f"SELECT arrival, round(CASE WHEN contains(lower(location), 'ontario') OR contains(lower(location), 'nation_1') THEN least({_BASE} + 0.08::DOUBLE, 1) ELSE {_BASE} END, 6) AS score FROM postings",
)
def _(t: Tables) -> DataFrame:
    s = scoring.location_boost(c("base"), c("location"), P.PlaceRules(["Ontario", "nation_1"], 0.08))
    return based(t).select("arrival", r6(s).alias("score"))


@case(
    "score_chain",
    f"WITH paid AS ({S.salary_bounds('postings')}),"
    + S.tfidf("SELECT arrival AS k, description AS t FROM postings", f"SELECT 0 AS q, '{QUERY_TEXT}' AS t")
    + f"""SELECT p.arrival, round({boosts_sql('coalesce(f.score, 0)')}, 6) AS score FROM paid p LEFT JOIN tfidf f ON f.k = p.arrival""",
)
def _(t: Tables) -> DataFrame:
    p = with_extracts(t.postings.drop("score"))
    scored = scoring.score_against(p, query_row(t), "arrival", "description")
    out = scoring.apply_boosts(scored, "base", SCAN.blend, SCAN.focus, SCAN.pay, SCAN.place)
    return out.select("arrival", r6("score").alias("score"))


def _profile_sql(p: P.Profile) -> str:
    words = scoring.category_keywords(P.CATEGORIES, p.categories)
    threshold = 0.17 if p.threshold is None else p.threshold
    fit = f"least({S.keyword_hits(words)} / 6.0::DOUBLE, 1)"
    s = f"least({_BASE} * {p.w_resume}::DOUBLE + {fit} * {p.w_target}::DOUBLE, 1)"
    return f"SELECT arrival, '{p.name}' AS profile, '{p.gate}' AS gate, round({s}, 6) AS score, {s} >= {threshold}::DOUBLE AS above FROM postings"


@case("profile_params", " UNION ALL ".join(_profile_sql(p) for p in P.PROFILES))
def _(t: Tables) -> DataFrame:
    out = scoring.score_profiles(based(t).drop("score"), "base", P.PROFILES, P.CATEGORIES, 0.17)
    return out.select("arrival", "profile", "gate", r6("score").alias("score"), "above")


def _category_sql() -> str:
    rows = []
    for pos, cat in enumerate(x for x in P.CATEGORIES if x.enabled):
        t = " + ".join(f"CAST({S.word_hit('lower(title)', k)} AS INT)" for k in cat.keywords)
        d = " + ".join(f"CAST({S.word_hit('lower(description)', k)} AS INT)" for k in cat.keywords)
        rows.append(f"SELECT arrival, '{cat.name}' AS category, {pos} AS pos, {t} AS th, {d} AS dh FROM postings")
    return (
        f"WITH s AS ({' UNION ALL '.join(rows)}), b AS (SELECT * FROM s WHERE th > 0 QUALIFY row_number() OVER (PARTITION BY arrival ORDER BY 2 * th + dh DESC, pos) = 1) "
        "SELECT p.arrival, b.category FROM postings p LEFT JOIN b USING (arrival)"
    )


@case("best_category", _category_sql())
def _(t: Tables) -> DataFrame:
    return t.postings.select("arrival", scoring.best_category(c("title"), c("description"), P.CATEGORIES).alias("category"))


def profile_hits_sql() -> list[str]:
    out = []
    for words in P.PROFILE_KEYWORDS.values():
        parts = [
            f"len(regexp_extract_all(lower{S.FULL}, '\\b{k}\\b')) + CASE WHEN {S.word_hit('lower(title)', k)} THEN 2 ELSE 0 END"
            for k in words
        ]
        out.append(" + ".join(parts))
    return out


def best_profile_sql(columns: str = "arrival", table: str = "postings") -> str:
    hits = ", ".join(f"{h} AS h{i}" for i, h in enumerate(profile_hits_sql()))
    names = list(P.PROFILE_KEYWORDS)
    return (
        f"SELECT {columns}, CASE WHEN greatest(h0, h1, h2) = 0 THEN 'general' WHEN h0 = greatest(h0, h1, h2) THEN '{names[0]}' "
        f"WHEN h1 = greatest(h0, h1, h2) THEN '{names[1]}' ELSE '{names[2]}' END AS profile FROM (SELECT *, {hits} FROM {table})"
    )


@case("best_profile", best_profile_sql())
def _(t: Tables) -> DataFrame:
    return t.postings.select("arrival", scoring.best_profile(c("title"), c("description")).alias("profile"))


_GRID = (
    "WITH "
    + S.tfidf(_DOCS, _VARIANTS)
    + """, grid AS (SELECT d.doc_id, 'item' || b.item_id AS label, round(coalesce(f.score, 0), 9) AS score FROM documents d CROSS JOIN benchmark b LEFT JOIN tfidf f ON f.k = d.doc_id AND f.q = 'item' || b.item_id)
"""
)


def grid(t: Tables) -> DataFrame:
    """Pairs that score, rounded so that equal scores tie in every engine."""
    s = scoring.variant_scores(t.documents, variants(t))
    return s.withColumn("score", F.round("score", 9)).where("score <> 0")


@case("variant_scores", _GRID + "SELECT doc_id, label, round(score, 6) AS score FROM grid WHERE score <> 0")
def _(t: Tables) -> DataFrame:
    return grid(t).select("doc_id", "label", r6("score").alias("score"))


@case(
    "best_variant_per_job",
    _GRID + "SELECT doc_id, label AS best_label, round(score, 6) AS best_score FROM grid QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) = 1",
)
def _(t: Tables) -> DataFrame:
    best = scoring.best_variant(grid(t), t.documents, variants(t))
    return best.select("doc_id", "best_label", r6("best_score").alias("best_score"))


@case(
    "variant_summary",
    _GRID
    + """, wins AS (SELECT label, count(*) AS wins FROM (SELECT label FROM grid QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) = 1) GROUP BY label),
per AS (SELECT label, avg(score) AS a, count(*) FILTER (score >= 0.05) AS above FROM grid GROUP BY label)
SELECT label, coalesce(wins, 0) AS wins, round(a, 6) AS avg_score, above, a > 0 AND row_number() OVER (ORDER BY a DESC, label) = 1 AS overall_winner FROM per LEFT JOIN wins USING (label)""",
)
def _(t: Tables) -> DataFrame:
    out = scoring.variant_summary(grid(t), t.documents, variants(t), 0.05)
    return out.select("label", "wins", r6("avg_score").alias("avg_score"), "above", "overall_winner")


# -- variants by the full score --------------------------------------------------------------

CHAIN = scoring.Chain(SCAN.blend, SCAN.focus, SCAN.pay, SCAN.place)
TARGETS = ["Python developer for data and lab research", "steel widget economy", "retail associate, large polished brass", "night watch"]
_TARGETS = " UNION ALL ".join(f"SELECT 'v{i}' AS q, '{text}' AS t" for i, text in enumerate(TARGETS))
_CHAINED = (
    f"WITH paid AS ({S.salary_bounds('postings')}),"
    + S.tfidf("SELECT arrival AS k, description AS t FROM postings", _TARGETS)
    + f""", chained AS (SELECT arrival, label, round({boosts_sql('base')}, 6) AS score, base > 0 AS shared FROM (
 SELECT p.*, l.q AS label, coalesce(f.score, 0) AS base FROM paid p CROSS JOIN ({_TARGETS}) l LEFT JOIN tfidf f ON f.k = p.arrival AND f.q = l.q))
"""
)


def targets(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(f"v{i}", text) for i, text in enumerate(TARGETS)], "label string, text string")


def paid(t: Tables) -> DataFrame:
    return with_extracts(t.postings.drop("score"))


def chained(t: Tables, dense: bool = False) -> DataFrame:
    return scoring.variant_scores(paid(t), targets(t), "arrival", "description", chain=CHAIN, dense=dense, digits=6)


@case("variant_chain", _CHAINED + "SELECT arrival, label, round(score, 6) AS score FROM chained WHERE shared")
def _(t: Tables) -> DataFrame:
    return chained(t).select("arrival", "label", r6("score").alias("score"))


@case("variant_chain_dense", _CHAINED + "SELECT arrival, label, round(score, 6) AS score FROM chained")
def _(t: Tables) -> DataFrame:
    return chained(t, dense=True).select("arrival", "label", r6("score").alias("score"))


@case(
    "best_variant_chain",
    _CHAINED + "SELECT arrival, label AS best_label, round(score, 6) AS best_score FROM chained QUALIFY row_number() OVER (PARTITION BY arrival ORDER BY score DESC, label) = 1",
)
def _(t: Tables) -> DataFrame:
    best = scoring.best_variant(chained(t), paid(t), targets(t), "arrival", chain=CHAIN, digits=6)
    return best.select("arrival", "best_label", r6("best_score").alias("best_score"))


@case(
    "variant_chain_summary",
    _CHAINED
    + """, wins AS (SELECT label, count(*) AS wins FROM (SELECT label FROM chained QUALIFY row_number() OVER (PARTITION BY arrival ORDER BY score DESC, label) = 1) GROUP BY label),
per AS (SELECT label, avg(score) AS a, count(*) FILTER (score >= 0.4) AS above FROM chained GROUP BY label)
SELECT label, coalesce(wins, 0) AS wins, round(a, 6) AS avg_score, above, a > 0 AND row_number() OVER (ORDER BY a DESC, label) = 1 AS overall_winner FROM per LEFT JOIN wins USING (label)""",
)
def _(t: Tables) -> DataFrame:
    out = scoring.variant_summary(chained(t), paid(t), targets(t), 0.4, "arrival", chain=CHAIN, digits=6)
    return out.select("label", "wins", r6("avg_score").alias("avg_score"), "above", "overall_winner")


# -- pluggable parts ----------------------------------------------------------------------

_WORDS = "list_distinct(list_filter(regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]{2,}'), lambda w: NOT list_contains(" + sql_list(P.STOP_WORDS) + ", w)))"


@case(
    "plug_scorer",
    f"""
WITH q AS (SELECT label, unnest(w) AS term, len(w) AS n FROM (SELECT q AS label, {_WORDS} AS w FROM ({_VARIANTS}))),
d AS (SELECT k AS doc_id, unnest({_WORDS}) AS term FROM ({_DOCS})),
s AS (SELECT doc_id, label, count(*) / any_value(n) AS score FROM d JOIN q USING (term) GROUP BY doc_id, label),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) = 1)
SELECT doc_id, coalesce(label, (SELECT min('item' || item_id) FROM benchmark)) AS best_label, round(coalesce(score, 0), 6) AS best_score
FROM documents LEFT JOIN best USING (doc_id)
""",
)
def _(t: Tables) -> DataFrame:
    """Any scorer with the same arguments can stand in: here shared words over query words."""
    from gleaner.functions import text as X

    def overlap(docs, queries, key, text, query_key) -> DataFrame:
        words = queries.select(F.array_distinct(X.tokens(c(text))).alias("w"), query_key)
        terms = words.select(query_key, F.explode("w").alias("term"), F.size("w").alias("n"))
        mine = docs.select(key, F.explode(F.array_distinct(X.tokens(c(text)))).alias("term"))
        return mine.join(terms, "term").groupBy(key, query_key).agg((F.count("*") / F.first("n")).alias("score"))

    s = scoring.variant_scores(t.documents, variants(t), score=overlap)
    best = scoring.best_variant(s, t.documents, variants(t))
    return best.select("doc_id", "best_label", r6("best_score").alias("best_score"))


def flagship(t: Tables) -> DataFrame:
    """Documents against one query text: TF-IDF, keyword blend, best 20."""
    scored = scoring.score_against(t.documents.select("doc_id", "text"), longest_text(t))
    fit = scoring.target_fit(F.lit(""), c("text"), P.BlendRules(keywords=["the", "and", "of"]))
    s = scoring.blend_score(c("base"), fit, 0.6, 0.4)
    return (
        scored.select("doc_id", r6("base").alias("cosine"), r6(s).alias("score"))
        .orderBy(c("score").desc(), c("doc_id"))
        .limit(20)
    )
