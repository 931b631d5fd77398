"""Queries over joins, counters, ranking, and the operators that keep state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import params as P
from gleaner.functions import answers as A
from gleaner.functions import money as M
from gleaner.functions import rules as R
from gleaner.functions import text as X
from gleaner.operators import documents as DOC
from gleaner.operators import filters, identity, reports, scoring, state
from gleaner.plans import sqltext as S
from gleaner.plans.cases import Tables, case, fresh_folder, r6, text
from gleaner.plans.cases_filters import _QUEUE, MIN_DATE, TODAY, FOLD, with_extracts
from gleaner.sources.keyed_table import KeyedTable
from gleaner.streaming import scan

c = F.col
_HASHED = f"SELECT *, {S.content_hash()} AS job_hash, {S.ID} AS id FROM "


# -- joins ------------------------------------------------------------------------------


@case(
    "anti_known_hash",
    f"""
WITH a AS ({_HASHED} arrived), k AS ({_HASHED} stored)
SELECT min(arrival) AS arrival, job_hash FROM a WHERE job_hash NOT IN (SELECT job_hash FROM k) GROUP BY job_hash
""",
)
def _(t: Tables) -> DataFrame:
    a, k = identity.with_identity(t.arrived), identity.with_identity(t.stored)
    return identity.anti_known_hash(a.select("arrival", "job_hash"), k.select("job_hash"))


# ids that a second sighting of a page would bring: the posting without its session part
_SIGHTINGS = """
SELECT arrival, source || ':' || regexp_replace(url, ';jsessionid=[^?]*|[?].*', '') AS id FROM arrived
UNION ALL SELECT arrival + 10000000, source || ':' || regexp_replace(url, ';jsessionid=[^?]*|[?].*', '') AS id FROM postings WHERE score >= 0.5
"""


@case(
    "anti_known_id",
    f"""
WITH b AS ({_SIGHTINGS.replace("', '') AS", "', '', 'g') AS")}), k AS (SELECT source || ':' || regexp_replace(url, ';jsessionid=[^?]*|[?].*', '', 'g') AS id FROM stored)
SELECT arrival, id, id NOT IN (SELECT id FROM k) AND row_number() OVER (PARTITION BY id ORDER BY arrival) = 1 AS is_new FROM b
""",
)
def _(t: Tables) -> DataFrame:
    known = t.derive("SELECT source || ':' || regexp_replace(url, ';jsessionid=[^?]*|[?].*', '') AS id FROM stored")
    return identity.flag_new(t.derive(_SIGHTINGS), known)


_CACHE = """
SELECT arrival AS job_id, 'v' || CAST(arrival % 3 AS STRING) AS master_hash, gap_raw AS report_json, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM answers
UNION ALL SELECT arrival, 'v1', 'newer ' || gap_raw, TIMESTAMP '2024-02-01 00:00:00' FROM answers WHERE gap_raw LIKE '%driving%'
"""


@case(
    "cache_lookup",
    f"""
WITH k AS ({_CACHE}), n AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY job_id, master_hash ORDER BY created_at DESC) = 1)
SELECT arrival AS job_id, report_json IS NOT NULL AS hit, report_json FROM postings LEFT JOIN n ON job_id = arrival AND master_hash = 'v1'
""",
)
def _(t: Tables) -> DataFrame:
    wanted = t.postings.select(c("arrival").alias("job_id"), F.lit("v1").alias("master_hash"))
    return state.cache_lookup(wanted, t.derive(_CACHE)).select("job_id", "hit", "report_json")


KEYWORDS = ["lab", "data", "python", "sql", "widget", "retail", "associate"]


@case(
    "keyword_hits",
    f"SELECT arrival, {S.keyword_hits(KEYWORDS)} AS hits FROM postings",
)
def _(t: Tables) -> DataFrame:
    return t.postings.select("arrival", scoring.keyword_hits(c("title"), c("description"), KEYWORDS).alias("hits"))


@case(
    "anti_untraceable",
    r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), m AS (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark)
SELECT doc_id, line FROM l WHERE lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) NOT IN (SELECT lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) FROM m)
""",
)
def _(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    master = t.benchmark.select(F.explode(F.split("text", "\n")).alias("line"))
    return DOC.anti_untraceable(lines, master).select("doc_id", "line")


REFERENCE = "Retail assistant with lab courses. Fluent in SQL."
FORBIDDEN = ["numbers", " ", "widget"]


def claims_sql(letter: str, reference: str = REFERENCE, forbidden=FORBIDDEN) -> str:
    from gleaner.plans.cases import sql_text

    parts = []
    for pattern, warning, word in P.CLAIM_RULES:
        if word is not None and word in reference.lower():
            continue
        parts.append(f"CASE WHEN regexp_matches({letter}, {sql_text('(?i)' + pattern)}) THEN {sql_text(warning)} END")
    for f in forbidden:
        if f.strip():
            message = f"forbidden phrase in config: '{f}'"
            parts.append(f"CASE WHEN contains(lower({letter}), {sql_text(f)}) THEN {sql_text(message)} END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


@case("claims_check", f"SELECT arrival, array_to_string({claims_sql('letter')}, '; ') AS warnings FROM letters")
def _(t: Tables) -> DataFrame:
    w = DOC.claim_warnings(c("letter"), F.lit(REFERENCE), FORBIDDEN)
    return t.letters.select("arrival", F.array_join(w, "; ").alias("warnings"))


@case(
    "apply_verdicts",
    f"""
WITH q AS (SELECT * FROM postings WHERE {_QUEUE}),
j AS (SELECT q.* EXCLUDE (description), CASE WHEN v.state <> 'dead' AND length(v.full_text) > length(q.description) THEN v.full_text ELSE q.description END AS description,
  coalesce(v.state <> 'dead' AND length(v.full_text) > length(q.description), false) AS enriched, coalesce(v.state, 'unchecked') AS state FROM q LEFT JOIN verdicts v USING (arrival)),
r AS (SELECT *, CASE WHEN enriched THEN {S.unsuitable()} END AS reason FROM j)
SELECT arrival, enriched, state = 'dead' OR reason IS NOT NULL AS hidden, CASE WHEN state = 'dead' THEN 'dead' ELSE reason END AS hidden_reason,
 CASE WHEN state = 'live' THEN 'live' ELSE 'unverified' END AS confidence, length(description) AS n FROM r
""",
)
def _(t: Tables) -> DataFrame:
    queue = filters.queue_candidates(t.postings, 0.17, None, TODAY, MIN_DATE)
    return state.apply_verdicts(queue, t.verdicts).select(
        "arrival", "enriched", "hidden", "hidden_reason", "confidence", F.length("description").cast("bigint").alias("n")
    )


_LOG = """
SELECT arrival AS alert_id, '[' || CAST(arrival AS STRING) || ',' || CAST(arrival + 1 AS STRING) || ',999999999]' AS jobs_alerted FROM postings
"""


@case(
    "alert_join_back",
    f"""
WITH l AS (SELECT alert_id, unnest(CAST(jobs_alerted AS BIGINT[])) AS arrival FROM ({_LOG})) SELECT alert_id, arrival, title FROM l JOIN postings USING (arrival)
""",
)
def _(t: Tables) -> DataFrame:
    out = state.alert_join_back(t.derive(_LOG), t.postings.select("arrival", "title"))
    return out.select("alert_id", "arrival", "title")


# -- counters ---------------------------------------------------------------------------


@case(
    "report_counters",
    """
SELECT count(*) AS total, count(*) FILTER (coalesce(score, 0) >= 0.17) AS above, count(*) FILTER (notified) AS notified, count(application_status) AS tracked, count(DISTINCT source) AS sources FROM postings
""",
)
def _(t: Tables) -> DataFrame:
    return reports.report_counters(t.postings, 0.17)


@case("source_counts", "SELECT source, count(*) AS postings FROM postings GROUP BY source")
def _(t: Tables) -> DataFrame:
    return reports.source_counts(t.postings)


_PICK = "max(score) FILTER (rn = CAST(floor(n * {q}) AS BIGINT) + 1)"


@case(
    "score_distribution",
    f"""
WITH s AS (SELECT score, row_number() OVER (ORDER BY score, arrival) AS rn, count(*) OVER () AS n FROM postings WHERE score IS NOT NULL)
SELECT count(*) AS scored, max(score) AS top, {_PICK.format(q='0.5')} AS p50, {_PICK.format(q='0.75')} AS p75, {_PICK.format(q='0.9')} AS p90, count(*) FILTER (score >= 0.17) AS above FROM s
""",
)
def _(t: Tables) -> DataFrame:
    return reports.index_percentiles(t.postings, 0.17, [("p50", 0.5), ("p75", 0.75), ("p90", 0.9)])


@case(
    "rescore_counters",
    f"""
WITH r AS (SELECT score, {S.exclude_reason(P.ExcludeRules())} AS reason FROM postings WHERE score IS NULL OR score > -0.5)
SELECT count(*) FILTER (reason IS NULL) AS rescored, count(reason) AS re_excluded, count(*) FILTER (reason IS NULL AND score >= 0.17) AS above FROM r
""",
)
def _(t: Tables) -> DataFrame:
    rescored = filters.exclude_with_reason(filters.rescore_set(t.postings), P.ExcludeRules())
    return reports.counted(rescored, reports.rescore_metrics(0.17))


_APPLY = f"""
WITH s AS (SELECT arrival, CASE arrival % 4 WHEN 0 THEN 'linkedin' WHEN 2 THEN 'jobbank' ELSE source END AS source, url, title, company, location, description, {S.email('description')} AS mail, ({S.unsuitable()}) IS NULL AS ok FROM postings WHERE score >= 0.3 AND application_status IS NULL),
m AS (SELECT *, CASE WHEN mail IS NOT NULL THEN 'email' WHEN source = 'linkedin' THEN source WHEN source = 'jobbank' THEN 'portal' ELSE 'unknown' END AS method, coalesce(mail, url) AS target FROM s)
"""


def candidates(t: Tables) -> DataFrame:
    src = F.when(c("arrival") % 4 == 0, "linkedin").when(c("arrival") % 4 == 2, "jobbank").otherwise(c("source"))
    p = t.postings.where((c("score") >= 0.3) & c("application_status").isNull()).withColumn("source", src)
    m = filters.with_suitability(p).withColumn("_m", R.apply_method(c("source"), c("url"), c("description")))
    return m.withColumns({"method": c("_m.method"), "target": c("_m.target")}).drop("_m")


@case(
    "batch_report",
    _APPLY
    + """SELECT count(*) AS scanned, count(*) FILTER (NOT ok) AS unsuitable, count(*) FILTER (ok) AS applied, count(*) FILTER (ok AND method = 'email') AS emails, count(*) FILTER (ok AND method IN ('portal', 'linkedin', 'indeed')) AS portals FROM m""",
)
def _(t: Tables) -> DataFrame:
    return reports.counted(candidates(t), reports.batch_metrics())


@case(
    "deadline_counters",
    """
WITH d AS (SELECT date_diff('day', DATE '1996-06-01', deadline) AS left_days FROM postings WHERE deadline >= DATE '1996-06-01' AND (application_status IS NULL OR application_status NOT IN ('applied', 'rejected', 'hidden')))
SELECT count(*) AS listed, count(*) FILTER (left_days <= 3) AS within_3, count(*) FILTER (left_days <= 7) AS within_7 FROM d
""",
)
def _(t: Tables) -> DataFrame:
    return reports.deadline_counters(filters.deadline_list(t.postings, TODAY), TODAY)


@case("distinct_hashes", f"SELECT DISTINCT {S.content_hash()} AS job_hash FROM postings")
def _(t: Tables) -> DataFrame:
    return identity.distinct_hashes(identity.with_identity(t.postings))


# -- ranking ----------------------------------------------------------------------------


@case(
    "dedup_keep_latest",
    f"""
WITH h AS ({_HASHED} postings) SELECT job_hash, arrival, posted_at FROM h QUALIFY row_number() OVER (PARTITION BY job_hash ORDER BY nullif(posted_at, '') DESC NULLS LAST, arrival) = 1
""",
)
def _(t: Tables) -> DataFrame:
    rows = t.identified.select("job_hash", "arrival", "posted_at")
    return identity.dedup_keep_latest(rows)


_COMBINED = "CASE WHEN suitability_score IS NOT NULL THEN coalesce(score, 0) * 0.6 + suitability_score * 0.4 ELSE coalesce(score, 0) END"


@case(
    "dedup_queue",
    f"""
SELECT arrival, title, company FROM postings QUALIFY row_number() OVER (PARTITION BY lower(trim(title)), lower(trim(company)) ORDER BY {_COMBINED} DESC, score DESC NULLS LAST, arrival) = 1
""",
)
def _(t: Tables) -> DataFrame:
    best = R.combined_score(c("score"), c("suitability_score"))
    narrow = t.postings.select("arrival", "title", "company", "score", "suitability_score")
    out = identity.dedup_queue(narrow, best, [c("score").desc_nulls_last(), c("arrival").asc()])
    return out.select("arrival", "title", "company")


@case(
    "rank_by_score",
    "SELECT arrival, row_number() OVER (ORDER BY coalesce(score, 0) DESC, arrival) AS rank FROM postings",
)
def _(t: Tables) -> DataFrame:
    return reports.rank_by_score(t.postings.select("arrival", "score")).select("arrival", "rank")


@case(
    "digest_top_n",
    """
SELECT arrival, score FROM postings WHERE coalesce(score, 0) >= 0.14 AND first_seen >= TIMESTAMP '1995-01-01 00:00:00'
 AND (application_status IS NULL OR application_status NOT IN ('applied', 'rejected', 'hidden')) ORDER BY coalesce(score, 0) DESC, arrival LIMIT 20
""",
)
def _(t: Tables) -> DataFrame:
    return filters.digest_top_n(t.postings, 0.14, F.lit(datetime(1995, 1, 1)), 20).select("arrival", "score")


@case("recent_top_n", "SELECT arrival, CAST(first_seen AS VARCHAR) AS first_seen FROM postings ORDER BY postings.first_seen DESC, arrival LIMIT 50")
def _(t: Tables) -> DataFrame:
    return filters.recent_top_n(t.postings, 50).select("arrival", text("first_seen").alias("first_seen"))


@case(
    "top_suitable_n",
    f"SELECT arrival, score FROM postings WHERE score >= 0.17 AND ({S.unsuitable()}) IS NULL ORDER BY score DESC, arrival LIMIT 25",
)
def _(t: Tables) -> DataFrame:
    return filters.top_suitable_n(t.postings, 0.17, 25).select("arrival", "score")


@case("combined_rank", f"SELECT arrival, round({_COMBINED}, 6) AS combined, row_number() OVER (ORDER BY {_COMBINED} DESC, arrival) AS rank FROM postings")
def _(t: Tables) -> DataFrame:
    s = t.postings.select("arrival", R.combined_score(c("score"), c("suitability_score")).alias("combined"))
    return reports.rank_by_score(s, "combined").select("arrival", r6("combined").alias("combined"), "rank")


@case(
    "score_band",
    "SELECT CASE WHEN score IS NULL THEN 'unscored' WHEN score < 0 THEN 'excluded' WHEN score >= 0.3 THEN 'match' WHEN score >= 0.3::DOUBLE * 0.7::DOUBLE THEN 'near' ELSE 'low' END AS band, count(*) AS n FROM postings GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    return t.postings.groupBy(R.score_band(c("score"), 0.3).alias("band")).agg(F.count("*").alias("n"))


@case(
    "ordered_distinct_terms",
    """
WITH w AS (SELECT trim(p_name) AS term, p_partkey AS position FROM part UNION ALL SELECT upper(p_name), p_partkey + 1000000 FROM part UNION ALL SELECT ' ' || p_type || ' ', p_partkey + 2000000 FROM part)
SELECT trim(term) AS term, position FROM w WHERE trim(term) <> '' QUALIFY row_number() OVER (PARTITION BY lower(trim(term)) ORDER BY position) = 1
""",
)
def _(t: Tables) -> DataFrame:
    p = t.part
    words = (
        p.select(c("p_name").alias("term"), c("p_partkey").alias("position"))
        .unionByName(p.select(F.upper("p_name").alias("term"), (c("p_partkey") + 1000000).alias("position")))
        .unionByName(p.select(F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("term"), (c("p_partkey") + 2000000).alias("position")))
    )
    return identity.ordered_distinct_terms(words, "term", "position")


# -- state ------------------------------------------------------------------------------

_BATCH = """
SELECT arrival, source, title, description FROM arrived
UNION ALL SELECT arrival, source, 'changed ' || title, CASE WHEN source = 'board1' THEN 'short' ELSE description || ' and more' END FROM stored WHERE score >= 0.5
"""


@case(
    "upsert_longest",
    f"""
WITH s AS (SELECT arrival AS id, * FROM (SELECT arrival, source, title, description FROM stored)), b AS (SELECT arrival AS id, * FROM ({_BATCH}))
SELECT coalesce(s.id, b.id) AS id, coalesce(s.title, b.title) AS title, CASE WHEN s.id IS NOT NULL AND length(b.description) > length(s.description) THEN b.description ELSE coalesce(s.description, b.description) END AS description,
 s.id IS NULL AS is_new FROM s FULL JOIN b USING (id)
""",
)
def _(t: Tables) -> DataFrame:
    stored = t.stored.select(c("arrival").alias("id"), "arrival", "source", "title", "description")
    batch = t.derive(_BATCH).withColumn("id", c("arrival"))
    return state.upsert_longest(stored, batch).select("id", "title", "description", "is_new")


_UPSERTED = f"""
WITH s AS (SELECT arrival AS id, * FROM (SELECT arrival, source, title, description FROM stored)), b AS (SELECT arrival AS id, * FROM ({_BATCH}))
SELECT coalesce(s.id, b.id) AS id, coalesce(s.title, b.title) AS title, CASE WHEN s.id IS NOT NULL AND length(b.description) > length(s.description) THEN b.description ELSE coalesce(s.description, b.description) END AS description,
 CASE WHEN s.id IS NULL THEN 1 ELSE 0 END AS inserted FROM s FULL JOIN b USING (id)
"""
BUCKETS = 8


@case("upsert_longest_stored", _UPSERTED)
def _(t: Tables) -> DataFrame:
    """The same on a keyed table: touched buckets are rewritten, then the manifest is swapped."""
    schema = "id bigint, arrival bigint, source string, title string, description string, inserted int"
    table = KeyedTable(t.spark, fresh_folder(t, "upsert"), schema, "id", BUCKETS)
    rows = t.stored.select(c("arrival").alias("id"), "arrival", "source", "title", "description", F.lit(0).alias("inserted"))
    table.append(rows, 0)
    batch = t.derive(_BATCH).withColumns({"id": c("arrival"), "inserted": F.lit(1)})
    table.upsert(state.first_and_longest(batch), 1, lambda both: state.keep_longest(both, table.columns))
    return table.read().select("id", "title", "description", "inserted")


@case(
    "anti_known_hash_stored",
    f"""
WITH a AS ({_HASHED} arrived), k AS ({_HASHED} stored)
SELECT min(arrival) AS arrival, job_hash FROM a WHERE job_hash NOT IN (SELECT job_hash FROM k) GROUP BY job_hash
""",
)
def _(t: Tables) -> DataFrame:
    """The history in a keyed table: filters first, then only the buckets that may hit."""
    table = KeyedTable(t.spark, fresh_folder(t, "hashes"), "job_hash string", "job_hash", BUCKETS)
    table.append(identity.with_identity(t.stored).select("job_hash").distinct(), 0)
    a = identity.with_identity(t.arrived).select("arrival", "job_hash")
    return identity.anti_known_hash(a, table.known(a))


@case(
    "hash_registry",
    f"""
WITH h AS ({_HASHED} postings), a AS (SELECT job_hash, max(first_seen) AS last_alert FROM h WHERE score >= 0.5 GROUP BY job_hash)
SELECT job_hash, source, posted_at, CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_alert AS VARCHAR) AS last_alert FROM h LEFT JOIN a USING (job_hash) QUALIFY row_number() OVER (PARTITION BY job_hash ORDER BY arrival) = 1
""",
)
def _(t: Tables) -> DataFrame:
    rows = t.identified.select("job_hash", "arrival", "source", "posted_at", "first_seen", "score")
    alerts = rows.where(c("score") >= 0.5).select("job_hash", c("first_seen").alias("sent_at"))
    out = identity.hash_registry(rows, alerts)
    return out.select("job_hash", "source", "posted_at", text("first_seen").alias("first_seen"), text("last_alert").alias("last_alert"))


@case("notify_once", "SELECT arrival, score FROM postings WHERE score >= 0.5 AND arrival NOT IN (SELECT arrival FROM stored WHERE score >= 0.5)")
def _(t: Tables) -> DataFrame:
    told = t.stored.where(c("score") >= 0.5).select("arrival")
    return state.notify_once(t.postings, 0.5, told).select("arrival", "score")


@case(
    "alert_when_min",
    f"""
WITH p AS ({S.salary_bounds('arrived')}), m AS (SELECT arrival FROM p WHERE (salary_max IS NULL OR salary_max >= 45000) AND NOT contains(lower(title || ' ' || description), 'retail'))
SELECT arrival FROM m WHERE (SELECT count(*) FROM m) >= 5
""",
)
def _(t: Tables) -> DataFrame:
    f = P.RecordFilter(min_salary=45_000, excluded_keywords=["Retail"])
    return state.alert_when_min(filters.record_filter(with_extracts(t.arrived), f), 5).select("arrival")


@case(
    "status_updates",
    FOLD + "SELECT posting_id, application_status, strftime(applied_at, '%Y-%m-%d %H:%M:%S') AS applied_at, application_notes FROM f",
)
def _(t: Tables) -> DataFrame:
    s = state.status_updates(t.status_events)
    return s.select("posting_id", "application_status", F.date_format("applied_at", "yyyy-MM-dd HH:mm:ss").alias("applied_at"), "application_notes")


@case("rejected_statuses", "SELECT event_id, status FROM status_events WHERE status = 'bogus'")
def _(t: Tables) -> DataFrame:
    return state.reject_statuses(t.status_events).select("event_id", "status")


_UPDATES = """
SELECT user_id AS arrival, value / 100 AS score, CASE WHEN event_type = 'click' THEN props END AS description, event_id AS seq FROM events
"""


@case(
    "score_updates",
    f"""
WITH u AS ({_UPDATES}), n AS (SELECT arrival, arg_max(score, seq) AS s, arg_max(description, seq) FILTER (description IS NOT NULL) AS d FROM u GROUP BY arrival)
SELECT arrival, round(coalesce(s, score), 6) AS score, coalesce(d, description) AS description FROM postings LEFT JOIN n USING (arrival)
""",
)
def _(t: Tables) -> DataFrame:
    out = state.score_updates(t.postings, t.derive(_UPDATES), ["score", "description"])
    return out.select("arrival", r6("score").alias("score"), "description")


@case(
    "suitability_backfill",
    """
WITH f AS (SELECT arrival, 0.25 AS s, CASE WHEN score >= 0.5 THEN 'yes' ELSE 'no' END AS v FROM postings WHERE score IS NOT NULL AND score >= 0)
SELECT arrival, round(CASE WHEN take THEN s ELSE suitability_score END, 6) AS suitability_score, CASE WHEN take THEN v ELSE qualification_verdict END AS qualification_verdict, take AS recomputed
FROM (SELECT p.*, f.s, f.v, (p.suitability_score IS NULL OR p.qualification_verdict IS NULL) AND f.s IS NOT NULL AS take FROM postings p LEFT JOIN f USING (arrival))
""",
)
def _(t: Tables) -> DataFrame:
    results = t.postings.where(c("score") >= 0).select(
        "arrival", F.lit(0.25).alias("suitability_score"), F.when(c("score") >= 0.5, "yes").otherwise("no").alias("qualification_verdict")
    )
    out = state.suitability_backfill(t.postings, results)
    return out.select("arrival", r6("suitability_score").alias("suitability_score"), "qualification_verdict", "recomputed")


# -- the scan ---------------------------------------------------------------------------

QUERY_TEXT = "Python developer for data and lab research, steel widget economy"
SCAN = scan.ScanRules(
    blend=P.BlendRules(keywords=["data", "lab", "research", "python"]),
    pay=P.PayRules(True, 60_000, 0.1),
    place=P.PlaceRules(["nation_1"], 0.05),
    threshold=0.4,
)


def query_row(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.lit(0).alias("query_id"), F.lit(QUERY_TEXT).alias("text"))


def boosts_sql(base: str) -> str:
    fit = f"least({S.keyword_hits(SCAN.blend.keywords)} / 6.0::DOUBLE, 1)"
    s = f"least({base} * 0.6::DOUBLE + {fit} * 0.4::DOUBLE, 1)"
    pay = "coalesce(salary_max, salary_min)"
    s = f"CASE WHEN {pay} > 0 THEN least({s} + least({pay} / 60000.0::DOUBLE, 1) * 0.1::DOUBLE, 1) ELSE {s} END"
    return f"CASE WHEN contains(lower(location), 'nation_1') THEN least({s} + 0.05::DOUBLE, 1) ELSE {s} END"


def _scored(batch: str, known: str) -> str:
    """CTEs of a scan of one table against another, ending in done(..., final)."""
    return (
        f"""WITH h AS ({_HASHED} {batch}), k AS ({_HASHED} {known}),
 seen AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY job_hash ORDER BY nullif(posted_at, '') DESC NULLS LAST, arrival) = 1),
 flagged AS (SELECT *, job_hash IN (SELECT job_hash FROM k) AS cross_duplicate FROM seen),
 judged AS (SELECT * EXCLUDE (score), NOT cross_duplicate AS is_new, CASE WHEN NOT cross_duplicate THEN {S.exclude_reason(P.ExcludeRules())} END AS exclude_reason FROM flagged),
 paid AS ({S.salary_bounds('judged')}),"""
        + S.tfidf(
            "SELECT arrival AS k, description AS t FROM judged WHERE is_new AND exclude_reason IS NULL",
            f"SELECT 0 AS q, '{QUERY_TEXT}' AS t",
        )
        + f""", done AS (SELECT p.*, CASE WHEN is_new AND exclude_reason IS NULL THEN {boosts_sql('coalesce(f.score, 0)')} WHEN exclude_reason IS NOT NULL THEN -1.0 END AS final
 FROM paid p LEFT JOIN tfidf f ON f.k = p.arrival)
"""
    )


_SCORED = _scored("arrived", "stored")
# The streams start with nothing stored, and the given orders come in one micro-batch.
_STREAMED = _scored("postings", "stored WHERE false")


def scanned(t: Tables) -> DataFrame:
    known = identity.with_identity(t.stored).select("id", "job_hash")
    return scan.scan_rows(t.arrived.drop("deadline"), known, query_row(t), SCAN)


@case(
    "incremental_scan",
    _SCORED + "SELECT arrival, cross_duplicate, is_new, exclude_reason, round(final, 6) AS score, coalesce(final >= 0.4, false) AS notify FROM done",
)
def _(t: Tables) -> DataFrame:
    return scanned(t).select("arrival", "cross_duplicate", "is_new", "exclude_reason", r6("score").alias("score"), "notify")


@case(
    "scan_counters",
    _SCORED
    + """SELECT count(*) AS seen, count(*) FILTER (cross_duplicate) AS cross_duplicates, count(*) FILTER (is_new) AS "new", count(*) FILTER (is_new AND exclude_reason IS NOT NULL) AS excluded,
 count(*) FILTER (final >= 0.4) AS notified, count(DISTINCT source) AS sources FROM done""",
)
def _(t: Tables) -> DataFrame:
    """The counters are observed while the rows of the scan are written."""
    known = identity.with_identity(t.stored).select("id", "job_hash")
    _, n = scan.scan_once(t.arrived.drop("deadline"), known, query_row(t), SCAN)
    names = ["seen", "cross_duplicates", "new", "excluded", "notified", "sources"]
    return t.spark.createDataFrame([tuple(getattr(n, name) for name in names)], ", ".join(f"{name} bigint" for name in names))


@case(
    "rescore_all",
    "WITH r AS (SELECT * FROM postings WHERE score IS NULL OR score > -0.5), e AS (SELECT * EXCLUDE (score), "
    + S.exclude_reason(P.ExcludeRules())
    + f" AS exclude_reason FROM r), paid AS ({S.salary_bounds('e')}),"
    + S.tfidf("SELECT arrival AS k, description AS t FROM e WHERE exclude_reason IS NULL", f"SELECT 0 AS q, '{QUERY_TEXT}' AS t")
    + f"""SELECT p.arrival, p.exclude_reason, round(CASE WHEN exclude_reason IS NULL THEN {boosts_sql('coalesce(f.score, 0)')} ELSE -1.0 END, 6) AS score FROM paid p LEFT JOIN tfidf f ON f.k = p.arrival""",
)
def _(t: Tables) -> DataFrame:
    out = scan.rescore(filters.rescore_set(t.postings), query_row(t), SCAN)
    return out.select("arrival", "exclude_reason", r6("score").alias("score"))


# -- streams ------------------------------------------------------------------------------


def _stream_scan(t: Tables, rounds: int | None = None) -> DataFrame:
    folder = fresh_folder(t, "scan")
    orders = t.spark.readStream.schema(t.orders.schema).option("pathGlobFilter", "orders.parquet").parquet(t.folder)
    state_ = scan.ScanState(t.spark, f"{folder}/state")
    run = scan.scan_micro_batch(state_, query_row(t), SCAN)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        run(t.postings_of(batch), batch_id)

    if rounds:
        scan.run_periodically(orders, on_batch, f"{folder}/checkpoint", 0.5, rounds)
    else:
        scan.run_stream(orders, on_batch, f"{folder}/checkpoint").awaitTermination()
    return scan.current_postings(state_)


@case("incremental_scan_stream", _STREAMED + "SELECT id, arrival, exclude_reason, round(final, 6) AS score FROM done")
def _(t: Tables) -> DataFrame:
    return _stream_scan(t).select("id", "arrival", "exclude_reason", r6("score").alias("score"))


@case("periodic_trigger", _STREAMED + "SELECT source, count(*) AS postings FROM done GROUP BY source")
def _(t: Tables) -> DataFrame:
    out = _stream_scan(t, rounds=2)
    return out.groupBy("source").agg(F.count("*").alias("postings"))


@case("status_updates_stream", FOLD + "SELECT posting_id, application_status, strftime(applied_at, '%Y-%m-%d %H:%M:%S') AS applied_at, application_notes FROM f")
def _(t: Tables) -> DataFrame:
    """Status events arriving as a stream, folded from the log that the batches append."""
    folder = fresh_folder(t, "status")
    events = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        t.status_events_of(batch).write.mode("overwrite").parquet(f"{folder}/log/batch={batch_id}")

    scan.run_stream(events, on_batch, f"{folder}/checkpoint").awaitTermination()
    log = t.spark.read.parquet(f"{folder}/log").drop("batch")
    s = state.status_updates(log)
    return s.select("posting_id", "application_status", F.date_format("applied_at", "yyyy-MM-dd HH:mm:ss").alias("applied_at"), "application_notes")
