"""Queries over filters, predicates and scalar extraction."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import params as P
from gleaner.functions import answers as A
from gleaner.functions import dates as D
from gleaner.functions import money as M
from gleaner.functions import rules as R
from gleaner.functions import text as X
from gleaner.operators import documents as DOC
from gleaner.operators import filters, identity, state
from gleaner.plans import sqltext as S
from gleaner.plans.cases import Tables, case, first_in, has_any, r6, sql_list, sql_text, text

c = F.col
FILTER = P.RecordFilter(
    min_salary=45_000, max_salary=90_000, required_skills=["python", "SQL"], excluded_skills=["Rust"],
    job_types=["full_time"], excluded_keywords=["retail", "Anodized"],
)
RULES = P.ExcludeRules(
    phrases=["Economy", "red widget"], max_years=3, provinces=["ON"], companies=["company 7", "Company 31"],
    title_pattern="^senior .*clerk$",
)


def with_extracts(df: DataFrame) -> DataFrame:
    pay = M.salary_from_text(c("description"))
    return df.withColumns({"_pay": pay, "skills": X.skills(c("title"), c("description"), c("company"))}).withColumns(
        {"salary_min": c("_pay.min"), "salary_max": c("_pay.max"), "job_type": F.lit("")}
    ).drop("_pay")


@case(
    "job_filter",
    f"""
WITH p AS ({S.salary_bounds('postings')}), q AS (SELECT *, {S.skills()} AS sk FROM p)
SELECT arrival, salary_min, salary_max FROM q WHERE (salary_max IS NULL OR salary_max >= 45000) AND (salary_min IS NULL OR salary_min <= 90000)
 AND list_contains(sk, 'Python') AND list_contains(sk, 'SQL') AND NOT list_contains(sk, 'Rust')
 AND NOT contains(lower(title || ' ' || description), 'retail') AND NOT contains(lower(title || ' ' || description), 'anodized')
""",
)
def _(t: Tables) -> DataFrame:
    return filters.record_filter(with_extracts(t.postings), FILTER).select("arrival", "salary_min", "salary_max")


@case(
    "exclude_with_reason",
    f"""
WITH r AS (SELECT *, {S.exclude_reason(RULES)} AS exclude_reason FROM postings)
SELECT arrival, exclude_reason, CASE WHEN exclude_reason IS NOT NULL THEN -1.0 ELSE score END AS score FROM r
""".replace("''' || list_filter(['economy', 'red widget'], lambda v: contains(lower(title || ' ' || description), v))[1] ||",
            "''' || CASE list_filter(['economy', 'red widget'], lambda v: contains(lower(title || ' ' || description), v))[1] WHEN 'economy' THEN 'Economy' ELSE 'red widget' END ||"),
)
def _(t: Tables) -> DataFrame:
    return filters.exclude_with_reason(t.postings, RULES).select("arrival", "exclude_reason", "score")


@case("closed_posting", f"SELECT arrival, {S.closed('description')} AS closed FROM postings")
def _(t: Tables) -> DataFrame:
    return t.postings.select("arrival", R.is_closed(c("description")).alias("closed"))


@case(
    "phrase_exclude",
    f"""
SELECT doc_id, {first_in('lower(text)', ['privacy policy', 'all rights', 'the', 'de la'])} AS any_case, {first_in('text', ['Privacy Policy', 'The ', 'DE'])} AS exact_case FROM documents
""",
)
def _(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id",
        R.matched_phrase(c("text"), ["privacy policy", "all rights", "the", "de la"]).alias("any_case"),
        R.matched_phrase(c("text"), ["Privacy Policy", "The ", "DE"], True).alias("exact_case"),
    )


@case("credential_block", f"SELECT arrival, {S.credential('body')} AS reason FROM study_texts")
def _(t: Tables) -> DataFrame:
    return t.study_texts.select("arrival", R.credential_block(c("body")).alias("reason"))


@case(
    "max_years_required",
    f"""
SELECT arrival, {S.years(S.FULL)} AS years, coalesce({S.years(S.FULL)} > 2, false) AS over_limit, {S.years(S.FULL, P.EXPERIENCE_YEARS_PATTERN)} AS experience FROM postings
""",
)
def _(t: Tables) -> DataFrame:
    body = X.title_and_text(c("title"), c("description"))
    years = R.max_years(body)
    return t.postings.select(
        "arrival",
        years.alias("years"),
        F.coalesce(years > 2, F.lit(False)).alias("over_limit"),
        R.max_years(body, P.EXPERIENCE_YEARS_PATTERN).alias("experience"),
    )


@case("extract_province", f"SELECT arrival, location, {S.province('location')} AS province FROM postings")
def _(t: Tables) -> DataFrame:
    return t.postings.select("arrival", "location", R.extract_province(c("location")).alias("province"))


@case(
    "company_blocklist",
    f"SELECT arrival, {has_any('lower(company)', ['company 7', 'company 31'])} AS blocked, {has_any('lower(company)', P.SPAM_COMPANIES)} AS spam FROM postings",
)
def _(t: Tables) -> DataFrame:
    return t.postings.select(
        "arrival",
        R.company_blocked(c("company"), ["Company 7", "company 31"]).alias("blocked"),
        R.company_blocked(c("company"), P.SPAM_COMPANIES).alias("spam"),
    )


@case(
    "title_regex_exclude",
    "SELECT arrival, regexp_matches(title, '(?i)^senior .*(clerk|associate)$') AS matched, false AS broken FROM postings",
)
def _(t: Tables) -> DataFrame:
    return t.postings.select(
        "arrival",
        R.title_matches(c("title"), "^senior .*(clerk|associate)$").alias("matched"),
        R.title_matches(c("title"), "([a-z").alias("broken"),
    )


@case("domain_gate", f"SELECT arrival, {S.domain_gate()} AS reason FROM postings")
def _(t: Tables) -> DataFrame:
    return t.postings.select("arrival", R.domain_gate(c("title"), c("description")).alias("reason"))


@case("suitability_cascade", f"SELECT arrival, {S.unsuitable('domain')} AS reason FROM postings")
def _(t: Tables) -> DataFrame:
    return filters.with_suitability(t.postings, "domain", "reason").select("arrival", "reason")


CHANNELS = "CASE arrival % 4 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'indeed' WHEN 2 THEN 'jobbank' ELSE source END"


@case(
    "detect_method",
    f"""
WITH s AS (SELECT arrival, {CHANNELS} AS source, url, {S.email('description')} AS mail FROM postings)
SELECT arrival, CASE WHEN mail IS NOT NULL THEN 'email' WHEN source IN ('linkedin', 'indeed') THEN source WHEN source = 'jobbank' THEN 'portal' ELSE 'unknown' END AS method,
 coalesce(mail, url) AS target FROM s
""",
)
def _(t: Tables) -> DataFrame:
    s = t.postings.withColumn("source", F.expr(CHANNELS))
    m = R.apply_method(c("source"), c("url"), c("description"))
    return s.select("arrival", m.alias("_m")).select("arrival", "_m.method", "_m.target")


@case(
    "location_allow",
    f"SELECT arrival, location = '' OR {has_any('lower(location)', ['nation_1', 'ontario', 'bc'])} AS allowed FROM postings",
)
def _(t: Tables) -> DataFrame:
    return t.postings.select("arrival", R.location_allowed(c("location"), ["nation_1", "ontario", "bc"]).alias("allowed"))


TODAY, MIN_DATE = date(1996, 6, 1), date(1995, 1, 1)
_OPEN = "(application_status IS NULL OR application_status NOT IN ('applied', 'rejected', 'hidden'))"
_QUEUE = f"""score >= 0.17 AND score > -0.5 AND {_OPEN} AND (deadline IS NULL OR deadline >= DATE '1996-06-01')
 AND coalesce(nullif(posted_at, ''), CAST(first_seen AS VARCHAR)) >= '1995-01-01'"""


@case("queue_candidates", f"SELECT arrival, score, application_status, CAST(deadline AS VARCHAR) AS deadline FROM postings WHERE {_QUEUE}")
def _(t: Tables) -> DataFrame:
    q = filters.queue_candidates(t.postings, 0.17, None, TODAY, MIN_DATE)
    return q.select("arrival", "score", "application_status", text("deadline").alias("deadline"))


FAR, UNI = ["nation_1", "nation_2"], ["company 4"]


@case(
    "queue_static_filters",
    f"""
SELECT arrival, coalesce(qualification_verdict = 'no', false) AS hidden_by_verdict,
 ({S.unsuitable()}) IS NULL AND coalesce(qualification_verdict, '') <> 'no' AND NOT {S.closed('description')} AND source <> 'board4'
 AND NOT {has_any('lower(location)', FAR)} AND NOT {has_any('lower(company)', UNI)} AS keep FROM postings WHERE {_QUEUE}
""",
)
def _(t: Tables) -> DataFrame:
    q = filters.queue_candidates(t.postings, 0.17, None, TODAY, MIN_DATE)
    flags = filters.queue_static_flags(q, "none", ["Board4"], FAR, UNI)
    return flags.select("arrival", "hidden_by_verdict", "keep")


@case("unnotified_above", "SELECT arrival, score FROM postings WHERE NOT notified AND score >= 0.5")
def _(t: Tables) -> DataFrame:
    return filters.unnotified_above(t.postings, 0.5).select("arrival", "score")


@case(
    "suitability_candidates",
    f"""
SELECT arrival, score FROM postings WHERE score >= 0.17 AND (suitability_score IS NULL OR qualification_verdict IS NULL) AND {_OPEN} ORDER BY score DESC, arrival LIMIT 50
""",
)
def _(t: Tables) -> DataFrame:
    return filters.suitability_candidates(t.postings, 0.17, 50).select("arrival", "score")


@case("rescore_set", "SELECT arrival, score FROM postings WHERE score IS NULL OR score > -0.5")
def _(t: Tables) -> DataFrame:
    return filters.rescore_set(t.postings).select("arrival", "score")


@case(
    "deadline_list",
    f"SELECT arrival, CAST(deadline AS VARCHAR) AS deadline FROM postings WHERE deadline >= DATE '1996-06-01' AND {_OPEN}",
)
def _(t: Tables) -> DataFrame:
    return filters.deadline_list(t.postings, TODAY).select("arrival", text("deadline").alias("deadline"))


# status history folded by plain SQL
FOLD = """
WITH v AS (SELECT *, row_number() OVER (PARTITION BY posting_id ORDER BY ts, event_id) AS n FROM status_events WHERE status IS NULL OR status <> 'bogus'),
cl AS (SELECT posting_id, coalesce(max(n) FILTER (status IS NULL), 0) AS cleared, max(n) AS last FROM v GROUP BY posting_id),
f AS (SELECT v.posting_id, any_value(v.status) FILTER (v.n = cl.last) AS application_status,
 max(v.ts) FILTER (v.status = 'applied' AND v.n > cl.cleared) AS applied_at,
 arg_max(v.notes, v.n) FILTER (v.status IS NOT NULL AND v.notes IS NOT NULL AND v.n > cl.cleared) AS application_notes
 FROM v JOIN cl USING (posting_id) GROUP BY v.posting_id)
"""


@case(
    "applications_list",
    FOLD + "SELECT posting_id, application_status, strftime(applied_at, '%Y-%m-%d %H:%M:%S') AS applied_at FROM f WHERE application_status IS NOT NULL",
)
def _(t: Tables) -> DataFrame:
    s = state.applications(state.status_updates(t.status_events))
    return s.select("posting_id", "application_status", F.date_format("applied_at", "yyyy-MM-dd HH:mm:ss").alias("applied_at"))


NOW = datetime(2024, 3, 15, 12, 0, 0)


@case(
    "follow_up",
    FOLD
    + """SELECT posting_id, CAST(floor((epoch_us(TIMESTAMP '2024-03-15 12:00:00') - epoch_us(applied_at)) / 86400000000) AS BIGINT) AS days_ago
 FROM f WHERE application_status = 'applied' AND applied_at < TIMESTAMP '2024-03-15 12:00:00' - INTERVAL 7 DAY""",
)
def _(t: Tables) -> DataFrame:
    s = state.status_updates(t.status_events)
    s = s.withColumn("applied_at", c("applied_at").cast("timestamp"))
    return filters.follow_up(s, F.lit(NOW).cast("timestamp")).select("posting_id", "days_ago")


LOOKUPS = """
SELECT DISTINCT substring(sha256(source || ':' || url), 1, CAST(CASE arrival % 5 WHEN 0 THEN 64 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 5 ELSE 8 END AS INT)) AS lookup FROM postings
"""


@case(
    "lookup_by_prefix",
    f"""
WITH ids AS (SELECT {S.ID} AS id FROM postings), keys AS ({LOOKUPS}),
p AS (SELECT lookup, count(*) AS n, min(id) AS id FROM keys k JOIN ids i ON length(lookup) BETWEEN 4 AND 63 AND substring(i.id, 1, length(lookup)) = lookup GROUP BY lookup)
SELECT lookup, id FROM p WHERE n = 1 UNION ALL SELECT lookup, lookup FROM keys WHERE length(lookup) = 64
""",
)
def _(t: Tables) -> DataFrame:
    ids = t.identified
    size = F.when(c("arrival") % 5 == 0, 64).when(c("arrival") % 5 == 1, 3).when(c("arrival") % 5 == 2, 4).when(c("arrival") % 5 == 3, 5).otherwise(8)
    keys = ids.select(F.substring("id", F.lit(1), size).alias("lookup"))
    return identity.lookup_by_prefix(ids, keys)


@case(
    "search_filter",
    """
SELECT arrival, 'text' AS mode FROM postings WHERE contains(lower(title), 'company 1') OR contains(lower(company), 'company 1') OR contains(lower(source), 'company 1') OR contains(coalesce(application_status, ''), 'company 1')
UNION ALL SELECT arrival, 'none' FROM postings WHERE application_status IS NULL OR application_status <> 'hidden'
UNION ALL SELECT arrival, 'facets' FROM postings WHERE contains(lower(title), 'data') AND source IN ('board1', 'board3') AND coalesce(score, 0) >= 0.3 AND application_status IS NOT NULL
""",
)
def _(t: Tables) -> DataFrame:
    p = t.postings
    a = filters.search_filter(p, " Company 1").withColumn("mode", F.lit("text"))
    b = filters.search_filter(p).withColumn("mode", F.lit("none"))
    d = filters.search_filter(p, "data", ["board1", "board3"], 0.3, "tracked").withColumn("mode", F.lit("facets"))
    return a.unionByName(b).unionByName(d).select("arrival", "mode")


# -- scalar functions -------------------------------------------------------------------


@case(
    "tokenize_terms",
    f"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({sql_list(P.STOP_WORDS)}, w)), ' ') AS terms FROM documents",
)
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(X.tokens(c("text")), " ").alias("terms"))


@case(
    "ngram_terms",
    """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents)
SELECT doc_id, CAST(len(w) + greatest(len(w) - 1, 0) AS BIGINT) AS n, array_to_string(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), '|') AS terms FROM w
""",
)
def _(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", X.tokens(c("text"), []).alias("_w"))
    grams = words.select("doc_id", X.with_bigrams(c("_w")).alias("_g"))
    return grams.select("doc_id", F.size("_g").cast("bigint").alias("n"), F.array_join("_g", "|").alias("terms"))


@case("normalize_key", f"SELECT doc_id, {S.norm('text')} AS key FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.normalize_key(c("text")).alias("key"))


@case("content_hash", f"SELECT arrival, {S.content_hash()} AS job_hash FROM postings")
def _(t: Tables) -> DataFrame:
    return t.postings.select("arrival", X.content_hash(c("title"), c("company"), c("location")).alias("job_hash"))


@case(
    "posting_id",
    f"""SELECT arrival, {S.ID} AS id, sha256('{{"title":"' || title || '","company":"' || company || '"}}') AS version FROM postings""",
)
def _(t: Tables) -> DataFrame:
    return t.postings.select(
        "arrival",
        X.posting_id(c("source"), c("url")).alias("id"),
        F.sha2(F.to_json(F.struct("title", "company")), 256).alias("version"),
    )


@case(
    "canonical_url",
    f"""
SELECT 'p' || page_id AS k, {S.search_url("regexp_replace(url, '(?i);jsessionid=[^?#&/]*', '', 'g')", ['source'])} AS board, {S.search_url('url', P.SEARCH_API_STRIP_PARAMS)} AS search,
 CASE WHEN regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '\\d+/*$') THEN 'https://www.linkedin.com/jobs/view/' || regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(\\d+)/*$', 1) || '/' ELSE url END AS view FROM pages
UNION ALL SELECT 'o' || arrival, {S.search_url("regexp_replace(url, '(?i);jsessionid=[^?#&/]*', '', 'g')", ['source'])}, {S.search_url('url', P.SEARCH_API_STRIP_PARAMS)},
 CASE WHEN regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '\\d+/*$') THEN 'https://www.linkedin.com/jobs/view/' || regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(\\d+)/*$', 1) || '/' ELSE url END FROM postings
""",
)
def _(t: Tables) -> DataFrame:
    urls = t.pages.select(F.concat(F.lit("p"), "page_id").alias("k"), "url").unionByName(
        t.postings.select(F.concat(F.lit("o"), "arrival").alias("k"), "url")
    )
    u = c("url")
    return urls.select(
        "k",
        X.canonical_board_url(u).alias("board"),
        X.canonical_search_url(u).alias("search"),
        X.canonical_view_url(u).alias("view"),
    )


@case(
    "parse_number",
    f"""
WITH n AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '$' || CAST(o_custkey AS VARCHAR) WHEN 1 THEN CAST(o_custkey AS VARCHAR) || 'k' WHEN 2 THEN CAST(o_custkey AS VARCHAR) || ',500.75' WHEN 3 THEN '1.5K' WHEN 4 THEN ',' ELSE CAST(o_custkey AS VARCHAR) END AS s FROM orders)
SELECT o_orderkey, {S.number('s')} AS n FROM n
""",
)
def _(t: Tables) -> DataFrame:
    k = c("o_custkey").cast("string")
    m = c("o_orderkey") % 6
    s = (
        F.when(m == 0, F.concat(F.lit("$"), k)).when(m == 1, F.concat(k, F.lit("k")))
        .when(m == 2, F.concat(k, F.lit(",500.75"))).when(m == 3, F.lit("1.5K")).when(m == 4, F.lit(",")).otherwise(k)
    )
    return t.orders.select("o_orderkey", M.parse_number(s).alias("n"))


@case(
    "parse_salary",
    f"""
WITH s AS (SELECT arrival, CASE arrival % 6 WHEN 0 THEN 'CA$' || (arrival % 90) || 'k - ' || (arrival % 50) || 'k' WHEN 1 THEN '£' || (arrival % 40) || '/hr' WHEN 2 THEN '€' || arrival || ',5 to 10 per hour'
 WHEN 3 THEN '' WHEN 4 THEN 'C$ by agreement' ELSE description END AS s FROM postings),
n AS (SELECT *, {S.numbers('s')} AS nums, regexp_extract(s, 'CA\\$|C\\$|[£€$]') AS sign FROM s)
SELECT arrival, least(nums[1], nums[-1]) AS lo, greatest(nums[1], nums[-1]) AS hi, CASE sign WHEN 'CA$' THEN 'CAD' WHEN 'C$' THEN 'CAD' WHEN '£' THEN 'GBP' WHEN '€' THEN 'EUR' ELSE 'USD' END AS currency,
 regexp_matches(s, '(?i)\\bhour\\b|\\bhr\\b') AS hourly FROM n
""",
)
def _(t: Tables) -> DataFrame:
    a = c("arrival")
    m = a % 6
    s = (
        F.when(m == 0, F.concat(F.lit("CA$"), a % 90, F.lit("k - "), a % 50, F.lit("k")))
        .when(m == 1, F.concat(F.lit("£"), a % 40, F.lit("/hr")))
        .when(m == 2, F.concat(F.lit("€"), a, F.lit(",5 to 10 per hour")))
        .when(m == 3, F.lit("")).when(m == 4, F.lit("C$ by agreement")).otherwise(c("description"))
    )
    p = t.postings.select("arrival", M.parse_salary(s).alias("_p"))
    return p.select("arrival", c("_p.min").alias("lo"), c("_p.max").alias("hi"), "_p.currency", "_p.hourly")


@case("salary_from_text", f"SELECT arrival, salary_min, salary_max FROM ({S.salary_bounds('postings')})")
def _(t: Tables) -> DataFrame:
    p = t.postings.select("arrival", M.salary_from_text(c("description")).alias("_p"))
    return p.select("arrival", c("_p.min").alias("salary_min"), c("_p.max").alias("salary_max"))


DATED = """CASE arrival % 6 WHEN 0 THEN 'Deadline: March ' || CAST(1 + arrival % 28 AS STRING) || 'th, 2026. ' WHEN 1 THEN 'Closing date 5 Sept. 2025 or so. ' WHEN 2 THEN 'Applications close on 31/' || CAST(1 + arrival % 12 AS STRING) || '/2025. '
 WHEN 3 THEN 'Must apply by 2025-02-' || CAST(20 + arrival % 12 AS STRING) || '; deadline: May 1, 2025. ' ELSE '' END || description"""


@case("extract_deadline", f"WITH d AS (SELECT arrival, {DATED} AS body FROM postings) SELECT arrival, CAST({S.deadline('body')} AS VARCHAR) AS deadline FROM d")
def _(t: Tables) -> DataFrame:
    d = t.postings.select("arrival", F.expr(DATED).alias("body"))
    return d.select("arrival", text(D.extract_deadline(c("body"))).alias("deadline"))


@case("extract_skills", f"SELECT arrival, array_to_string({S.skills()}, ',') AS skills FROM postings")
def _(t: Tables) -> DataFrame:
    s = X.skills(c("title"), c("description"), c("company"))
    return t.postings.select("arrival", F.array_join(s, ",").alias("skills"))


@case("extract_emails", f"SELECT doc_id, {S.email('text')} AS email FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.first_email(c("text")).alias("email"))


@case(
    "first_name_line",
    r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r]'), lambda s: trim(s, E' \t')), lambda s: s <> '')[1] AS line FROM documents)
SELECT doc_id, CASE WHEN len(regexp_split_to_array(line, '\s+')) BETWEEN 2 AND 5 AND NOT regexp_matches(line, '[@:|]|\d{4}') THEN line ELSE 'Sam Example' END AS name FROM l
""",
)
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.first_name_line(c("text")).alias("name"))


def phrases_sql() -> str:
    kept = [(k, P.KEYWORD_PHRASES.get(k, k)) for k in P.FOCUS_KEYWORDS if P.KEYWORD_PHRASES.get(k, k)]
    hits = ", ".join(f"CASE WHEN contains(lower{S.FULL}, {sql_text(k)}) THEN {sql_text(v)} END" for k, v in kept)
    found = f"list_filter([{hits}], lambda x: x IS NOT NULL)"
    distinct = f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"
    return f"CASE WHEN len({distinct}) > 0 THEN array_to_string({distinct}, ', ') ELSE {sql_text(', '.join(P.DEFAULT_PHRASES))} END"


@case("keyword_phrases", f"SELECT arrival, {phrases_sql()} AS phrases FROM postings")
def _(t: Tables) -> DataFrame:
    return t.postings.select("arrival", X.keyword_phrases(c("title"), c("description")).alias("phrases"))


def letter_sql() -> str:
    pick = "CASE " + " ".join(
        f"WHEN {has_any('lower(title)', words)} THEN {sql_text(body)}"
        for words, body in zip(P.LETTER_KEYWORDS, P.LETTER_BODIES, strict=True)
    ) + f" ELSE {sql_text(P.LETTER_FALLBACK)} END"
    for name, value in (("title", "trim(title)"), ("company", "trim(company)"), ("profile", sql_text(P.DEFAULT_PROFILE_LINE)), ("keywords", phrases_sql()), ("name", "'Robin Doe'")):
        pick = f"replace({pick}, '{{{name}}}', {value})"
    return pick


@case("pick_template", f"SELECT arrival, {letter_sql()} AS letter FROM postings")
def _(t: Tables) -> DataFrame:
    return t.postings.select(
        "arrival", DOC.letter_body(c("title"), c("company"), c("description"), F.lit("Robin Doe")).alias("letter")
    )


@case(
    "compose_description",
    "SELECT arrival, 'Division: ' || source || CASE WHEN coalesce(application_status, '') <> '' THEN chr(10) || 'Department: ' || application_status ELSE '' END || chr(10) || 'Location: ' || location AS description FROM postings",
)
def _(t: Tables) -> DataFrame:
    return t.postings.select(
        "arrival",
        X.labelled_lines(("Division", c("source")), ("Department", c("application_status")), ("Location", c("location"))).alias("description"),
    )


@case(
    "format_cells",
    f"""
WITH p AS ({S.salary_bounds('postings')})
SELECT arrival, {S.salary_cell('N/A', ' – ')} AS alert_cell, {S.salary_cell('—', '–')} AS digest_cell, coalesce(printf('%.3f', score), '—') AS score_cell, coalesce(substring(posted_at, 1, 10), '') AS posted FROM p
""",
)
def _(t: Tables) -> DataFrame:
    from gleaner.operators.reports import score_cell

    p = t.postings.withColumn("_s", M.salary_from_text(c("description")))
    lo, hi = c("_s.min"), c("_s.max")
    return p.select(
        "arrival",
        M.salary_cell(lo, hi).alias("alert_cell"),
        M.salary_cell(lo, hi, "—", "–").alias("digest_cell"),
        score_cell("score", 3).alias("score_cell"),
        D.date_cell(c("posted_at")).alias("posted"),
    )


@case(
    "days_between",
    """
SELECT arrival, date_diff('day', DATE '1996-06-01', deadline) AS days_left,
 CAST(floor((epoch_us(TIMESTAMP '2024-03-15 12:00:00') - epoch_us(first_seen)) / 86400000000) AS BIGINT) AS days_since FROM postings
""",
)
def _(t: Tables) -> DataFrame:
    return t.postings.select(
        "arrival",
        D.days_until(c("deadline"), F.lit(TODAY)).alias("days_left"),
        D.whole_days_since(c("first_seen").cast("timestamp"), F.lit(NOW).cast("timestamp")).alias("days_since"),
    )


@case(
    "parse_verdict_json",
    r"""
WITH b AS (SELECT arrival, regexp_extract(verdict_raw, '(?s)\{[^}]+\}') AS b FROM answers),
j AS (SELECT arrival, TRY_CAST(nullif(b, '') AS JSON) AS j FROM b)
SELECT arrival, CASE WHEN j IS NOT NULL THEN round(least(greatest(CAST(j->>'suitability' AS DOUBLE), 0), 1), 6) END AS score, j->>'reason' AS reason,
 CASE WHEN lower(trim(j->>'qualified')) IN ('yes', 'borderline', 'no') THEN lower(trim(j->>'qualified')) END AS verdict,
 array_to_string(list_filter(CAST(j->'unmet' AS VARCHAR[]), lambda u: trim(u) <> ''), '|') AS unmet FROM j
""",
)
def _(t: Tables) -> DataFrame:
    a = t.answers.select("arrival", A.parse_verdict(c("verdict_raw")).alias("_v"))
    return a.select("arrival", r6("_v.score").alias("score"), "_v.reason", "_v.verdict", F.array_join("_v.unmet", "|").alias("unmet"))


GAP_SQL = r"""
WITH j AS (SELECT arrival, TRY_CAST(nullif(regexp_extract(gap_raw, '(?s)\{.*\}'), '') AS JSON) AS j FROM answers),
r AS (SELECT arrival, j IS NOT NULL AS parsed,
 list_filter(list_transform(CAST(j->'requirements' AS JSON[]), lambda x: {'requirement': x->>'requirement', 'status': CASE WHEN lower(x->>'status') IN ('covered', 'partial', 'missing') THEN lower(x->>'status') ELSE 'missing' END, 'covered_by': coalesce(x->>'covered_by', '')}), lambda x: trim(x.requirement) <> '') AS reqs,
 list_filter(list_transform(CAST(j->'ats_keywords' AS JSON[]), lambda x: {'keyword': x->>'keyword', 'present': CAST(x->>'present' AS BOOLEAN)}), lambda x: trim(x.keyword) <> '') AS kws,
 CAST(j->'strengths' AS VARCHAR[]) AS strengths, CAST(j->'gaps' AS VARCHAR[]) AS gaps FROM j)
"""


@case(
    "parse_gap_json",
    GAP_SQL + """
SELECT arrival, parsed, array_to_string(list_transform(reqs, lambda x: x.requirement || '/' || x.status || '/' || x.covered_by), '|') AS requirements,
 array_to_string(list_transform(kws, lambda x: x.keyword || '/' || x.present), '|') AS keywords, array_to_string(strengths, '|') AS strengths, array_to_string(gaps, '|') AS gaps FROM r
""",
)
def _(t: Tables) -> DataFrame:
    a = t.answers.select("arrival", A.parse_gap(c("gap_raw")).alias("g"))
    return a.select(
        "arrival",
        c("g").isNotNull().alias("parsed"),
        F.array_join(F.transform("g.requirements", lambda x: F.concat_ws("/", x["requirement"], x["status"], x["covered_by"])), "|").alias("requirements"),
        F.array_join(F.transform("g.ats_keywords", lambda x: F.concat_ws("/", x["keyword"], x["present"].cast("string"))), "|").alias("keywords"),
        F.array_join("g.strengths", "|").alias("strengths"),
        F.array_join("g.gaps", "|").alias("gaps"),
    )


@case(
    "parse_profile_json",
    """
SELECT arrival, 'Name: ' || company || chr(10) || 'Education: ' || title || chr(10) || 'Experience level: entry-level' || chr(10) || 'Experience: ' || source || chr(10) || 'Skills: sql, ' || location || chr(10)
 || 'Certifications: ' || chr(10) || 'Languages: en' || chr(10) || 'Suited for: ' || chr(10) || 'Not suited for: ' AS profile FROM postings
""",
)
def _(t: Tables) -> DataFrame:
    return t.answers.select("arrival", A.profile_text(A.parse_profile(c("profile_raw"))).alias("profile"))


@case(
    "gap_summary_line",
    GAP_SQL + """
, s AS (SELECT arrival, parsed, kws, CASE WHEN len(strengths) > 0 THEN strengths ELSE list_transform(list_filter(reqs, lambda x: x.status = 'covered'), lambda x: x.requirement) END AS st,
 CASE WHEN len(gaps) > 0 THEN gaps ELSE list_transform(list_filter(reqs, lambda x: x.status = 'missing'), lambda x: x.requirement) END AS ga FROM r)
SELECT arrival, CASE WHEN parsed THEN concat_ws(' · ', CASE WHEN len(st) > 0 THEN '✓ ' || array_to_string(st[1:2], '; ') END, CASE WHEN len(ga) > 0 THEN 'gap: ' || array_to_string(ga[1:2], '; ') END,
 CASE WHEN len(kws) > 0 THEN 'ATS ' || len(list_filter(kws, lambda x: x.present)) || '/' || len(kws) END) ELSE 'no analysis' END AS summary FROM s
""",
)
def _(t: Tables) -> DataFrame:
    a = t.answers.select("arrival", A.parse_gap(c("gap_raw")).alias("g"))
    return a.select("arrival", A.summary_line(c("g")).alias("summary"))


@case(
    "gap_counts",
    GAP_SQL + """
SELECT arrival, len(list_filter(reqs, lambda x: x.status = 'covered')) AS covered, len(list_filter(reqs, lambda x: x.status = 'partial')) AS partial, len(list_filter(reqs, lambda x: x.status = 'missing')) AS missing,
 len(list_filter(kws, lambda x: x.present)) AS present, len(kws) AS total,
 array_to_string(CASE WHEN len(cited) = 2 AND cited[1] = cited[2] THEN cited[1:1] ELSE cited END, ',') AS item_ids
FROM (SELECT *, list_transform(list_filter(reqs, lambda x: x.status IN ('covered', 'partial') AND x.covered_by <> ''), lambda x: x.covered_by) AS cited FROM r WHERE parsed)
""",
)
def _(t: Tables) -> DataFrame:
    a = t.answers.select("arrival", A.parse_gap(c("gap_raw")).alias("g")).where(c("g").isNotNull())
    g = c("g")
    return a.select(
        "arrival",
        *[A.status_count(g, s).alias(s) for s in P.GAP_STATUSES],
        A.keywords_present(g).alias("present"),
        A.keywords_total(g).alias("total"),
        F.array_join(A.covered_item_ids(g), ",").alias("item_ids"),
    )


@case(
    "json_array_columns",
    f"""SELECT arrival, CASE WHEN len({S.skills()}) > 0 THEN CAST(to_json({S.skills()}) AS VARCHAR) END AS skills_json, len({S.skills()}) AS n FROM postings""",
)
def _(t: Tables) -> DataFrame:
    s = t.postings.select("arrival", X.skills(c("title"), c("description"), c("company")).alias("_s"))
    stored = s.select("arrival", X.json_array(c("_s")).alias("skills_json"))
    return stored.select("arrival", "skills_json", F.size(X.array_of_json(c("skills_json"))).cast("bigint").alias("n"))


CHECKED = "CASE page_id % 6 WHEN 0 THEN 'indeed' WHEN 1 THEN 'x_icims' WHEN 2 THEN 'jobbank' WHEN 3 THEN source ELSE 'talent' END"
DYING = "body || CASE page_id % 11 WHEN 4 THEN '<p>This job has EXPIRED</p>' WHEN 5 THEN 'Job not found' ELSE '' END"


@case(
    "classify_response",
    f"""
WITH s AS (SELECT page_id, {CHECKED} AS source, url, status, {DYING} AS body FROM responses),
d AS (SELECT *, {first_in('lower(body)', P.DEAD_PHRASES)} AS dead, source LIKE '%\\_icims' ESCAPE '\\' AS portal FROM s),
r AS (SELECT *, CASE WHEN source = 'indeed' OR NOT (source IN ('jobbank', 'talent') OR portal) THEN 'unknown' WHEN status IN (404, 410) THEN 'dead' WHEN portal THEN 'live' WHEN status >= 400 THEN 'unknown' WHEN dead IS NOT NULL THEN 'dead' ELSE 'live' END AS state,
 CASE WHEN source = 'indeed' THEN 'indeed blocks verification' WHEN NOT (source IN ('jobbank', 'talent') OR portal) THEN source || ' not verifiable' WHEN status IN (404, 410) THEN 'HTTP ' || status WHEN portal THEN 'HTTP ' || status || ' (icims)'
  WHEN status = 403 THEN 'HTTP 403 (blocked)' WHEN status >= 400 THEN 'HTTP ' || status WHEN dead IS NOT NULL THEN 'dead phrase: ''' || dead || '''' ELSE 'HTTP ' || status END AS reason FROM d)
SELECT page_id, state, reason, CASE WHEN state = 'live' AND NOT portal THEN {S.main_text('body')} END AS full_text FROM r
""",
)
def _(t: Tables) -> DataFrame:
    s = t.responses.select("page_id", F.expr(CHECKED).alias("source"), "url", "status", F.expr(DYING).alias("body"))
    v = R.response_state(c("source"), c("url"), c("status"), c("body"), X.main_text(c("body")))
    return s.select("page_id", v.alias("_v")).select("page_id", "_v.state", "_v.reason", "_v.full_text")


RENDERED = """
SELECT arrival, url, CASE arrival % 6 WHEN 0 THEN 'Just a moment...' WHEN 1 THEN 'Attention Required! | Shield' ELSE title END AS page_title, arrival % 3 AS apply_count, CASE WHEN arrival % 7 = 3 THEN 1 ELSE 0 END AS expired_count FROM postings
"""


@case(
    "classify_rendered",
    f"""
SELECT arrival, CASE WHEN arrival % 6 IN (0, 1) THEN 'unknown' WHEN expired_count > 0 THEN 'dead' WHEN apply_count > 0 THEN 'live' ELSE 'unknown' END AS state,
 CASE WHEN arrival % 6 IN (0, 1) THEN 'cloudflare challenge' WHEN expired_count > 0 THEN 'expired banner' WHEN apply_count > 0 THEN 'apply button present' ELSE 'no apply button (indeterminate)' END AS reason FROM ({RENDERED})
""",
)
def _(t: Tables) -> DataFrame:
    s = t.derive(RENDERED)
    v = R.rendered_state(c("page_title"), c("apply_count"), c("expired_count"))
    return s.select("arrival", v.alias("_v")).select("arrival", "_v.state", "_v.reason")


@case(
    "tri_state_open",
    f"""
SELECT page_id, CAST(CASE WHEN status IN (404, 410) THEN false WHEN status >= 400 THEN NULL ELSE NOT {S.closed('body')} END AS VARCHAR) AS is_open FROM responses
""",
)
def _(t: Tables) -> DataFrame:
    return t.responses.select("page_id", R.still_open(c("status"), c("body")).cast("string").alias("is_open"))


@case(
    "ascii_fold",
    r"""
SELECT doc_id, regexp_replace(replace(translate(text || ' “x” – y… Ω', '—–•’‘“”·' || chr(160), '---''''""- '), '…', '...'), '[^\x{00}-\x{FF}]', '?', 'g') AS folded FROM documents
""",
)
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.ascii_fold(F.concat("text", F.lit(" “x” – y… Ω"))).alias("folded"))
