"""Queries over sources and sinks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import params as P
from gleaner.functions import money as M
from gleaner.functions import text as X
from gleaner.functions.rules import apply_method
from gleaner.operators import documents as DOC
from gleaner.operators import filters, identity, reports, state
from gleaner.operators.keyed import anti_join
from gleaner.plans import sqltext as S
from gleaner.plans.cases import Tables, case, fresh_folder, r6, sql_list, text
from gleaner.sources import feeds, listings, tables

NAV = {"web": listings.ListingSpec(["nav li"], link="a")}


@case(
    "extract_listings",
    r"""
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="[^"]*">[^<]*</a>')) AS link,
  generate_subscripts(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="[^"]*">[^<]*</a>'), 1) AS idx FROM pages),
b AS (SELECT page_id, idx, regexp_extract(url, '^(https?://[^/?#]*)', 1) || replace(regexp_extract(link, 'href="([^"]*)"', 1), '&amp;', '&') AS url,
  replace(regexp_extract(link, '>([^<]*)<', 1), '&amp;', '&') AS title FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY idx) AS rn FROM b)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY idx) AS BIGINT) AS pos, url, title FROM c WHERE rn = 1
""",
)
def _(t: Tables) -> DataFrame:
    pages = t.pages.select("page_id", F.lit("web").alias("source"), "url", F.col("html").alias("body"))
    return listings.extract_listings(pages, NAV).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "url", "title"
    )


@case(
    "extract_listings_browser",
    """
SELECT arrival AS page_id, CASE arrival % 2 WHEN 0 THEN 'linkedin' ELSE 'indeed' END AS source,
 CASE arrival % 2 WHEN 0 THEN 'https://www.linkedin.com/jobs/view/' || arrival || '/' ELSE 'https://ca.indeed.com/viewjob?jk=k' || arrival END AS url,
 title, company, location, CASE arrival % 2 WHEN 0 THEN '' ELSE trim(description) END AS snippet,
 CASE arrival % 2 WHEN 0 THEN posted_at END AS posted_at, CASE arrival % 2 WHEN 1 THEN 'k' || arrival END AS listing_key
FROM postings
""",
)
def _(t: Tables) -> DataFrame:
    cards = listings.extract_listings(t.board_pages)
    url = F.when(F.col("source") == "linkedin", X.canonical_view_url(F.col("url"))).otherwise(F.col("url"))
    return cards.select(
        "page_id", "source", url.alias("url"), "title", "company", "location", "snippet", "posted_at", "listing_key"
    )


@case(
    "extract_detail_text",
    f"""
SELECT page_id, {S.main_text("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)", ())} AS detail_text FROM pages
""",
)
def _(t: Tables) -> DataFrame:
    pages = t.pages.select("page_id", F.lit("web").alias("source"), "url", F.col("html").alias("body"))
    spec = listings.DetailSpec(["#jobDescriptionId", "article"], paragraphs="main p")
    return listings.extract_detail_text(pages, {"web": spec}).select("page_id", "detail_text")


@case("extract_main_text", f"SELECT page_id, {S.main_text('html')} AS main_text FROM pages")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.main_text(F.col("html")).alias("main_text"))


BOARD_POLICIES = {"board0": "longer", "board1": "replace", "board2": "append", "board3": "longer", "board4": "replace"}


@case(
    "merge_detail_text",
    """
SELECT arrival, CASE
 WHEN source IN ('board0', 'board3') AND length(coalesce(detail_text, '')) > length(description) THEN detail_text
 WHEN source IN ('board1', 'board4') AND coalesce(detail_text, '') <> '' THEN detail_text
 WHEN source = 'board2' AND coalesce(detail_text, '') <> '' THEN description || chr(10) || chr(10) || detail_text
 ELSE description END AS description
FROM postings LEFT JOIN detail_texts USING (url)
""",
)
def _(t: Tables) -> DataFrame:
    merged = listings.merge_detail_text(
        t.postings.select("arrival", "source", "url", "description"), t.detail_texts, BOARD_POLICIES
    )
    return merged.select("arrival", "description")


_JSON = """
WITH j AS (SELECT arrival, CAST(body AS JSON) AS b FROM {table}),
e AS (SELECT arrival, unnest(json_extract({path}, '$[*]')) AS e, generate_subscripts(json_extract({path}, '$[*]'), 1) AS idx FROM j)
"""


def _str(path: str) -> str:
    return f"CASE WHEN json_type(e, '{path}') = 'VARCHAR' THEN json_extract_string(e, '{path}') END"


@case(
    "ingest_results_json",
    _JSON.format(table="search_bodies", path="json_extract(b, '$.results')")
    + f"""
, r AS (SELECT arrival, {_str('$.title')} AS title, {_str('$.redirect_url')} AS u, coalesce({_str('$.description')}, '') AS description,
 coalesce({_str('$.company.display_name')}, '') AS company, coalesce({_str('$.location.display_name')}, '') AS location, {_str('$.created')} AS posted_at FROM e)
SELECT arrival, title, {S.search_url('u', P.SEARCH_API_STRIP_PARAMS)} AS url, description, company, location, posted_at
FROM r WHERE title <> '' AND u <> ''
""",
)
def _(t: Tables) -> DataFrame:
    return feeds.ingest_results(t.search_bodies).drop("pos")


@case(
    "ingest_feed_json",
    _JSON.format(table="feed_bodies", path="b")
    + f"""
, r AS (SELECT arrival, idx, json_extract_string(e, '$.id') AS id, {_str('$.position')} AS title, {_str('$.url')} AS url, coalesce({_str('$.description')}, '') AS d,
 coalesce({_str('$.company')}, '') AS company, coalesce({_str('$.location')}, '') AS location, {_str('$.date')} AS posted_at FROM e WHERE idx > 1)
SELECT arrival, title, url, {S.main_text('d', ())} AS description, company, location, posted_at FROM r
WHERE coalesce(id, '') <> '' AND title <> '' AND url <> '' AND (location = '' OR len(list_filter({sql_list(P.REMOTE_LOCATION_WORDS)}, lambda w: contains(lower(location), w))) > 0)
""",
)
def _(t: Tables) -> DataFrame:
    return feeds.ingest_feed(t.feed_bodies).drop("pos")


PAGED_BASE, PAGED_COMPANY = "https://careers.example.org/site", "Example University"


@case(
    "ingest_postings_json",
    """
WITH j AS (SELECT arrival, "offset", CAST(body AS JSON) AS b FROM paged_bodies),
e AS (SELECT arrival, "offset", CAST(json_extract(b, '$.total') AS BIGINT) AS total, json_array_length(json_extract(b, '$.jobPostings')) AS n, unnest(json_extract(b, '$.jobPostings[*]')) AS e FROM j),
r AS (SELECT arrival, "offset" + n < total AS more, json_extract_string(e, '$.externalPath') AS path, trim(json_extract_string(e, '$.title')) AS title,
 trim(coalesce(json_extract_string(e, '$.locationsText'), '')) AS location, json_extract_string(e, '$.postedOn') AS posted_at FROM e)
SELECT arrival, more, 'https://careers.example.org/site' || path AS url, title, location, title || CASE WHEN location <> '' THEN ' — ' || location ELSE '' END AS description, posted_at
FROM r WHERE path LIKE '/%' AND title <> ''
""",
)
def _(t: Tables) -> DataFrame:
    out = feeds.ingest_postings(t.paged_bodies, PAGED_BASE, PAGED_COMPANY)
    return out.select("arrival", "more", "url", "title", "location", "description", "posted_at")


def _readers(t: Tables) -> dict:
    return {
        "search": lambda spark: feeds.ingest_results(t.search_bodies),
        "feed": lambda spark: feeds.ingest_feed(t.feed_bodies),
        "paged": lambda spark: feeds.ingest_postings(t.paged_bodies, PAGED_BASE, PAGED_COMPANY),
    }


def _union(t: Tables) -> DataFrame:
    return feeds.union_sources([read(t.spark).withColumn("source", F.lit(name)) for name, read in _readers(t).items()])


_UNION_SQL = (
    _JSON.format(table="search_bodies", path="json_extract(b, '$.results')").replace("WITH j", "WITH j1").replace("FROM j)", "FROM j1)").replace("\ne AS", "\ne1 AS")
    + ", j2 AS (SELECT arrival, CAST(body AS JSON) AS b FROM feed_bodies), e2 AS (SELECT arrival, unnest(json_extract(b, '$[*]')) AS e, generate_subscripts(json_extract(b, '$[*]'), 1) AS idx FROM j2)"
    + ", j3 AS (SELECT arrival, CAST(body AS JSON) AS b FROM paged_bodies), e3 AS (SELECT arrival, unnest(json_extract(b, '$.jobPostings[*]')) AS e FROM j3)"
)


@case(
    "union_sources",
    _UNION_SQL
    + f"""
SELECT 'search' AS source, arrival, e->>'title' AS title, CAST(NULL AS BOOLEAN) IS NOT NULL AS paged FROM e1 WHERE json_type(e, '$.title') = 'VARCHAR' AND e->>'title' <> '' AND coalesce(e->>'redirect_url', '') <> ''
UNION ALL SELECT 'feed', arrival, e->>'position', false FROM e2 WHERE idx > 1 AND coalesce(e->>'id', '') <> '' AND e->>'position' <> '' AND coalesce(e->>'url', '') <> ''
 AND (coalesce(e->>'location', '') = '' OR len(list_filter({sql_list(P.REMOTE_LOCATION_WORDS)}, lambda w: contains(lower(e->>'location'), w))) > 0)
UNION ALL SELECT 'paged', arrival, trim(e->>'title'), true FROM e3 WHERE e->>'externalPath' LIKE '/%' AND trim(e->>'title') <> ''
""",
)
def _(t: Tables) -> DataFrame:
    return _union(t).select("source", "arrival", "title", F.col("more").isNotNull().alias("paged"))


@case(
    "gathered_sources",
    _UNION_SQL
    + f"""
, good AS (SELECT 'search' AS source FROM e1 WHERE json_type(e, '$.title') = 'VARCHAR' AND e->>'title' <> '' AND coalesce(e->>'redirect_url', '') <> ''
UNION ALL SELECT 'feed' FROM e2 WHERE idx > 1 AND coalesce(e->>'id', '') <> '' AND e->>'position' <> '' AND coalesce(e->>'url', '') <> ''
 AND (coalesce(e->>'location', '') = '' OR len(list_filter({sql_list(P.REMOTE_LOCATION_WORDS)}, lambda w: contains(lower(e->>'location'), w))) > 0)
UNION ALL SELECT 'paged' FROM e3 WHERE e->>'externalPath' LIKE '/%' AND trim(e->>'title') <> '')
SELECT source, count(*) AS records, 0 AS errors FROM good GROUP BY source UNION ALL SELECT 'moved', 0, 1 UNION ALL SELECT 'spoilt', 0, 1
""",
)
def _(t: Tables) -> DataFrame:
    """Two more sources fail, one when its frame is built and one while its rows are read; the others complete."""
    readers = _readers(t)
    readers["moved"] = lambda spark: spark.read.parquet(fresh_folder(t, "moved"))
    readers["spoilt"] = lambda spark: t.responses.withColumn("title", F.raise_error(F.lit("bad row")).cast("string"))
    return feeds.gathered_counts(feeds.gather_sources(t.spark, readers))


@case(
    "source_errors",
    """
SELECT source, count(*) AS records, count(*) FILTER (status >= 400) AS errors FROM responses GROUP BY source
""",
)
def _(t: Tables) -> DataFrame:
    failed = F.when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    return feeds.source_errors(t.responses.withColumn("_error", failed))


@case(
    "cap_per_source",
    f"""
WITH p AS (SELECT source, arrival, {S.search_url("regexp_replace(url, '(?i);jsessionid=[^?#&/]*', '', 'g')", ('source', 'id', 'utm_source'))} AS url, title,
  arrival // 20 AS page, arrival % 20 AS pos FROM postings),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY source, url ORDER BY page, pos) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY page, pos) AS listing FROM f)
SELECT source, arrival, url, listing, listing <= 40 AS enrich FROM r WHERE listing <= 100
""",
)
def _(t: Tables) -> DataFrame:
    bare = X.drop_query_params(F.regexp_replace("url", P.SESSION_PATH_PARAM, ""), ["source", "id", "utm_source"])
    rows = t.postings.select(
        "source",
        "arrival",
        bare.alias("url"),
        F.floor(F.col("arrival") / 20).alias("page"),
        (F.col("arrival") % 20).alias("pos"),
    )
    return identity.cap_per_source(rows, 100, 40).select("source", "arrival", "url", "listing", "enrich")


@case(
    "crawl_frontier",
    r"""
WITH l AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS path FROM pages),
robots AS (SELECT DISTINCT host, '/fr/' AS prefix FROM l WHERE host LIKE 'blog.%'),
ok AS (SELECT * FROM l WHERE url NOT IN (SELECT url FROM responses WHERE status = 404)
  AND NOT EXISTS (SELECT 1 FROM robots r WHERE r.host = l.host AND starts_with(l.path, r.prefix))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY url) AS slot FROM ok)
SELECT page_id, host, url, slot, (slot - 1) * 2.0::DOUBLE AS start_after FROM ranked WHERE slot <= 100
""",
)
def _(t: Tables) -> DataFrame:
    hosts = t.pages.select(X.host_of(F.col("url")).alias("host"))
    robots = hosts.where(F.col("host").startswith("blog.")).withColumn("prefix", F.lit("/fr/"))
    known = t.responses.where(F.col("status") == 404).select("url")
    out = feeds.crawl_frontier(t.pages.select("page_id", "url"), known, robots, 100, 2.0, ties=["page_id"])
    return out.select("page_id", "host", "url", "slot", "start_after")


@case(
    "read_postings",
    """
SELECT arrival, source, title, company, location, coalesce(CAST(NULL AS VARCHAR), '') AS job_type, posted_at, CAST(first_seen AS VARCHAR) AS first_seen,
 CAST(deadline AS VARCHAR) AS deadline, score, notified, '[]' AS skills, CAST(NULL AS VARCHAR) AS application_notes FROM postings
""",
)
def _(t: Tables) -> DataFrame:
    return tables.conform(t.postings).select(
        "arrival", "source", "title", "company", "location", "job_type", "posted_at",
        text("first_seen").alias("first_seen"), text("deadline").alias("deadline"), "score", "notified",
        F.to_json("skills").alias("skills"), "application_notes",
    )


@case(
    "read_resume_text",
    r"""
SELECT doc_id, CASE WHEN rn = 1 THEN stem ELSE stem || ' (' || parent || ')' END AS label, length(text) AS n FROM (
 SELECT doc_id, text, regexp_extract(path, '([^/]+)\.txt$', 1) AS stem, regexp_extract(path, '([^/]+)/[^/]+$', 1) AS parent,
 row_number() OVER (PARTITION BY regexp_extract(path, '([^/]+)\.txt$', 1) ORDER BY doc_id) AS rn FROM text_files)
""",
)
def _(t: Tables) -> DataFrame:
    out = identity.label_texts(t.text_files, arrival="doc_id")
    return out.select("doc_id", "label", F.length("text").cast("bigint").alias("n"))


def nested_master(t: Tables) -> DataFrame:
    """One master résumé per brand of part: contact, summaries map and its items."""
    content = F.struct("title", "sub", F.array("bullet1", "bullet2").alias("bullets"))
    item = F.struct("id", "section", content.alias("content"), F.array("tag1", "tag2").alias("tags"), "core")
    return t.items.select(
        F.struct(
            F.col("title").alias("name"), F.col("section").alias("location"), F.lit("").alias("phone"),
            F.concat(F.lit("p"), F.col("pos").cast("string"), F.lit("@example.org")).alias("email"),
        ).alias("contact"),
        F.create_map(F.lit("general"), F.concat(F.lit("General "), "tag1"), F.col("tag2"), F.lit("Special")).alias("summaries"),
        F.array(item).alias("items"),
    )


@case(
    "read_master_items",
    "SELECT id, section, title, sub, bullet1 || '|' || bullet2 AS bullets, trim(tag1) || '|' || trim(tag2) AS tags, core FROM items",
)
def _(t: Tables) -> DataFrame:
    out = tables.master_items(nested_master(t))
    return out.select(
        "id", "section", "title", "sub", F.array_join("bullets", "|").alias("bullets"), F.array_join("tags", "|").alias("tags"), "core"
    )


def flat_items(t: Tables) -> DataFrame:
    return t.items.select(
        "pos", "id", "section", "title", "sub",
        F.array("bullet1", "bullet2").alias("bullets"), F.array("tag1", "tag2").alias("tags"), "core",
    )


@case(
    "validate_master_items",
    f"""
SELECT CAST(pos AS VARCHAR) AS subject, unnest(list_filter([CASE WHEN trim(id) = '' THEN 'blank id' END, CASE WHEN trim(title) = '' THEN 'blank title' END,
 CASE WHEN NOT list_contains({sql_list(P.SECTION_TITLES)}, section) THEN 'unknown section' END, CASE WHEN trim(tag1) = '' AND trim(tag2) = '' THEN 'no tag' END], lambda v: v IS NOT NULL)) AS violation FROM items
UNION ALL SELECT id, 'duplicate id' FROM items GROUP BY id HAVING count(*) > 1
""",
)
def _(t: Tables) -> DataFrame:
    return DOC.validate_items(flat_items(t))


@case(
    "master_views",
    """
SELECT pos, CASE WHEN tag1 = 'lab' OR tag2 = 'lab' THEN true ELSE false END AS tagged, core,
 array_to_string(list_filter([title, sub, bullet1, bullet2], lambda s: s <> ''), chr(10)) AS item_text,
 CASE WHEN tag2 = 'lab' THEN 'Special' ELSE 'General ' || tag1 END AS summary
FROM items WHERE tag1 = 'lab' OR tag2 = 'lab' OR core
""",
)
def _(t: Tables) -> DataFrame:
    items = flat_items(t)
    summaries = F.create_map(
        F.lit("general"), F.concat(F.lit("General "), F.get("tags", F.lit(0))),
        F.concat(F.lit("p:"), F.get("tags", F.lit(1))), F.lit("Special"),
    )
    both = DOC.items_for_tags(items, ["lab"]).unionByName(
        DOC.core_items(items).where(~F.arrays_overlap("tags", X.string_array(["lab"])))
    )
    return both.select(
        "pos",
        F.array_contains("tags", "lab").alias("tagged"),
        "core",
        DOC.item_text(F.col("title"), F.col("sub"), F.col("bullets")).alias("item_text"),
        DOC.summary_for(summaries, "p:lab").alias("summary"),
    )


_ROUND3 = "printf('%.3f', score)"


@case(
    "write_ranked_table",
    f"""
WITH m AS (SELECT *, {S.ID} AS id FROM postings WHERE coalesce(score, 0) >= 0.14)
SELECT row_number() OVER (ORDER BY coalesce(score, 0) DESC, arrival) AS rank, {_ROUND3} AS score_cell, substring(id, 1, 8) AS short_id,
 CASE application_status WHEN 'seen' THEN '[~] seen' WHEN 'interested' THEN '[~] interested' WHEN 'applied' THEN '[x] applied' WHEN 'rejected' THEN '[✗] rejected' WHEN 'hidden' THEN '[-] hidden' ELSE '[ ]' END AS status_cell,
 substring(title, 1, 55) AS title, substring(company, 1, 28) AS company, substring(location, 1, 22) AS location, source, '[open](' || url || ')' AS link FROM m
""",
)
def _(t: Tables) -> DataFrame:
    folder = fresh_folder(t, "ranked")
    reports.write_ranked(reports.ranked_table(t.identified, 0.14), folder)
    return t.spark.read.parquet(folder)


@case(
    "append_audit_log",
    f"""
WITH m AS (SELECT *, {S.email('description')} AS mail FROM postings WHERE score >= 0.5)
SELECT arrival, '2024-03-01T00:00:00Z' AS "timestamp", {S.ID} AS job_id, title, CASE WHEN mail IS NOT NULL THEN 'email' ELSE 'unknown' END AS method,
 score AS match_score, suitability_score, 'dry_run' AS action, mail AS recipient, '[]' AS validation_warnings FROM m
""",
)
def _(t: Tables) -> DataFrame:
    c = F.col
    m = t.identified.where(c("score") >= 0.5).select(
        "*", apply_method(c("source"), c("url"), c("description")).alias("_m")
    )
    rows = m.select(
        "arrival",
        F.lit("2024-03-01T00:00:00Z").alias("timestamp"), c("id").alias("job_id"), "title", "company",
        c("_m.method").alias("method"), c("_m.target").alias("target"), c("score").alias("match_score"), "suitability_score",
        F.lit(None).cast("string").alias("letter_path"), F.lit("dry_run").alias("action"),
        F.array().cast("array<string>").alias("validation_warnings"), F.lit(None).cast("string").alias("error"),
    )
    folder = fresh_folder(t, "audit")
    tables.append_audit_log(rows, folder, "arrival")
    log = tables.read_audit_log(t.spark, folder, "arrival bigint")
    return log.select(
        "arrival", "timestamp", "job_id", "title", "method", "match_score", "suitability_score", "action", "recipient",
        F.to_json("validation_warnings").alias("validation_warnings"),
    )


@case(
    "append_alert_log",
    """
WITH m AS (SELECT arrival FROM postings WHERE score >= 0.5 AND contains(lower(title), 'data'))
SELECT arrival, (SELECT count(*) FROM m) AS matched_count, '{"min_score": 0.5}' AS filter_used FROM m
""",
)
def _(t: Tables) -> DataFrame:
    m = t.postings.where((F.col("score") >= 0.5) & F.contains(F.lower("title"), F.lit("data")))
    log = state.alert_log_row(m.select("arrival"), '{"min_score": 0.5}')
    ids = F.explode(F.from_json("jobs_alerted", "array<bigint>")).alias("arrival")
    return log.select(ids, "matched_count", "filter_used")


@case(
    "render_messages",
    f"""
WITH p AS ({S.salary_bounds('postings')}),
q AS (SELECT *, ' (' || CAST(CAST(round_even(score * 100, 0) AS BIGINT) AS VARCHAR) || '%)' AS suffix, 'New match: ' || title AS head, {S.skills()} AS sk FROM p WHERE score >= 0.14)
SELECT arrival, CASE WHEN length(head) + length(suffix) > 63 THEN substring(head, 1, 62 - length(suffix)) || '…' ELSE head END || suffix AS title,
 substring(company || ' — ' || location || chr(10) || substring(url, 1, 80), 1, 255) AS body,
 {S.salary_cell('N/A', ' – ')} AS salary, CASE WHEN len(sk) > 0 THEN array_to_string(sk[1:5], ', ') ELSE 'N/A' END AS skills FROM q
""",
)
def _(t: Tables) -> DataFrame:
    c = F.col
    m = t.postings.where(c("score") >= 0.14).select(
        "arrival",
        reports.notification(c("title"), c("company"), c("location"), c("url"), c("score")).alias("_n"),
        M.salary_from_text(c("description")).alias("_s"),
        X.skills(c("title"), c("description"), c("company")).alias("_k"),
    )
    return m.select(
        "arrival", "_n.title", "_n.body",
        M.salary_cell(c("_s.min"), c("_s.max")).alias("salary"),
        reports.alert_skills(c("_k")).alias("skills"),
    )


_SINCE = datetime(1995, 1, 1)


def _digest(t: Tables) -> DataFrame:
    top = filters.digest_top_n(t.postings, 0.14, F.lit(_SINCE), 20)
    top = top.withColumn("_s", M.salary_from_text(F.col("description")))
    top = top.withColumns({"salary_min": F.col("_s.min"), "salary_max": F.col("_s.max")})
    return reports.digest_entries(reports.rank_by_score(top))


@case(
    "render_digest",
    """
WITH top AS (SELECT * FROM postings WHERE coalesce(score, 0) >= 0.14 AND first_seen >= TIMESTAMP '1995-01-01 00:00:00'
  AND (application_status IS NULL OR application_status NOT IN ('applied', 'rejected', 'hidden')) ORDER BY coalesce(score, 0) DESC, arrival LIMIT 20),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, arrival) AS rank FROM top)
SELECT 'Your top ' || count(*) || ' job(s) — last week' || chr(10) || chr(10) || string_agg(
 rank || '. [' || printf('%.2f', score) || '] ' || title || ' — ' || company || chr(10) || '   ' || location || '  ·  ' || source || chr(10)
 || CASE WHEN deadline IS NOT NULL THEN '   deadline: ' || CAST(deadline AS VARCHAR) || chr(10) ELSE '' END || '   ' || url || chr(10), chr(10) ORDER BY rank) AS digest FROM r
""",
)
def _(t: Tables) -> DataFrame:
    return reports.digest_text(_digest(t), "last week")


@case(
    "report_rows",
    """
SELECT row_number() OVER (ORDER BY coalesce(score, 0) DESC, arrival) AS rank, arrival, source, coalesce(printf('%.3f', score), '—') AS score_cell,
 coalesce(score, 0) >= 0.14 AS above, notified, coalesce(application_status, '') AS status, lower(title || ' ' || company) AS search_text,
 substring(coalesce(nullif(posted_at, ''), CAST(first_seen AS VARCHAR)), 1, 10) AS posted FROM postings
""",
)
def _(t: Tables) -> DataFrame:
    return reports.report_rows(t.postings, 0.14)


@case(
    "export_candidates",
    """
SELECT arrival, score, qualification_verdict, CAST(first_seen AS VARCHAR) AS first_seen FROM postings
WHERE score >= 0.17 AND (qualification_verdict IS NULL OR qualification_verdict <> 'no') AND arrival NOT IN (SELECT arrival FROM stored WHERE notified)
""",
)
def _(t: Tables) -> DataFrame:
    exported = t.stored.where("notified").select("arrival")
    out = filters.export_candidates(t.postings, 0.17, True, exported)
    return out.select("arrival", "score", "qualification_verdict", text("first_seen").alias("first_seen"))
