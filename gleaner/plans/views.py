"""Tables the registered queries read: the given Parquet files and views derived from them.

Each derived view is one SQL text that means the same to Spark and to other SQL engines, so a
check on another engine starts from identical rows.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

POSTINGS = """
SELECT o_orderkey AS arrival,
 'board' || CAST(o_orderkey % 5 AS STRING) AS source,
 'https://' || 'board' || CAST(o_orderkey % 5 AS STRING) || '.example.org/view/' || CAST(o_orderkey AS STRING)
  || CASE WHEN o_orderkey % 2 = 0 THEN ';jsessionid=A' || CAST(o_orderkey % 97 AS STRING) ELSE '' END
  || '?id=' || CAST(o_orderkey AS STRING) || '&utm_source=x' AS url,
 CASE WHEN o_orderkey % 11 = 0 THEN 'Senior ' ELSE '' END || CASE o_orderkey % 6
  WHEN 0 THEN 'Research Assistant' WHEN 1 THEN 'Data Engineer' WHEN 2 THEN 'Retail Associate'
  WHEN 3 THEN 'Lab Technician' WHEN 4 THEN 'Office Clerk' ELSE 'Software Developer' END AS title,
 'Company ' || CAST(o_custkey % 50 AS STRING) AS company,
 n_name || CASE o_orderkey % 4 WHEN 0 THEN ', ON' WHEN 1 THEN ' (BC)' WHEN 2 THEN ', Ontario' ELSE '' END AS location,
 CASE o_orderkey % 5
  WHEN 0 THEN 'Salary $' || CAST(40 + o_orderkey % 30 AS STRING) || ',000 - $' || CAST(70 + o_orderkey % 30 AS STRING) || ',000 per year. '
  WHEN 1 THEN 'Pay $' || CAST(18 + o_orderkey % 20 AS STRING) || '/hr to start. ' ELSE '' END
  || CASE WHEN o_orderkey % 3 = 0 THEN 'Requires ' || CAST(o_orderkey % 8 AS STRING) || '+ years of experience. ' ELSE '' END
  || CASE WHEN o_orderkey % 7 = 0 THEN 'Apply by ' || CAST(CAST(o_orderdate AS DATE) AS STRING) || '. ' ELSE '' END
  || CASE WHEN o_orderkey % 13 = 0 THEN 'This position has been filled. ' ELSE '' END
  || CASE WHEN o_orderkey % 17 = 0 THEN 'Bachelor degree required. ' ELSE '' END
  || CASE WHEN o_orderkey % 10 = 0 THEN 'Contact hr' || CAST(o_orderkey % 7 AS STRING) || '@example.org. ' ELSE '' END
  || 'Python and SQL with ' || p_type || ' ' || p_name AS description,
 CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS posted_at,
 o_orderdate AS first_seen,
 CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderdate AS DATE) END AS deadline,
 CASE WHEN o_orderkey % 19 = 0 THEN -1.0E0 WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) / 100 END AS score,
 CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 11 AS DOUBLE) / 10 END AS suitability_score,
 CASE o_orderkey % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'borderline' WHEN 2 THEN 'no' END AS qualification_verdict,
 CASE o_orderkey % 9 WHEN 0 THEN 'seen' WHEN 1 THEN 'interested' WHEN 2 THEN 'applied' WHEN 3 THEN 'rejected' WHEN 4 THEN 'hidden' END AS application_status,
 o_orderkey % 5 = 0 AS notified
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 JOIN (SELECT * FROM part WHERE p_partkey < 200) AS some_parts ON p_partkey = o_orderkey % 200
"""

STATUS_EVENTS = """
SELECT event_id, user_id AS posting_id, ts,
 CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'interested' WHEN 'purchase' THEN 'applied'
  WHEN 'error' THEN 'bogus' END AS status,
 CASE WHEN event_id % 3 = 0 THEN props END AS notes
FROM events
"""

RESPONSES = """
SELECT page_id, 'board' || CAST(page_id % 5 AS STRING) AS source, url,
 CASE page_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 500 ELSE 200 END AS status, html AS body
FROM pages
"""

# Stored and arriving postings: a cut in time.
STORED = "SELECT * FROM postings WHERE first_seen < TIMESTAMP '1996-01-01 00:00:00'"
ARRIVED = "SELECT * FROM postings WHERE first_seen >= TIMESTAMP '1996-01-01 00:00:00'"

# Master-résumé items: one per part, with blank, unknown and repeated values among them.
ITEMS = """
SELECT p_partkey AS pos,
 CASE WHEN p_partkey % 41 = 0 THEN ' ' WHEN p_partkey % 5 = 0 THEN 'size' || CAST(p_size AS STRING) ELSE 'item' || CAST(p_partkey AS STRING) END AS id,
 CASE p_partkey % 8 WHEN 0 THEN 'education' WHEN 1 THEN 'projects' WHEN 2 THEN 'experience' WHEN 3 THEN 'activities'
  WHEN 4 THEN 'skills' WHEN 5 THEN 'certs' WHEN 6 THEN 'experience' ELSE 'hobbies' END AS section,
 CASE WHEN p_partkey % 37 = 0 THEN '  ' ELSE p_name END AS title,
 CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS sub,
 CASE WHEN p_partkey % 31 = 0 THEN ' ' ELSE lower(p_type) END AS tag1,
 CASE WHEN p_partkey % 4 = 0 THEN 'lab' WHEN p_partkey % 31 = 0 THEN '' ELSE 'service' END AS tag2,
 p_type || ' work' AS bullet1, 'size ' || CAST(p_size AS STRING) AS bullet2,
 p_partkey % 6 = 0 AS core
FROM part
"""

# Answers of an outside model per posting, as raw text.
ANSWERS = """
SELECT arrival,
 CASE WHEN arrival % 29 = 0 THEN 'no answer' ELSE
 'Here it is: {"suitability": ' || CASE arrival % 5 WHEN 0 THEN '1.7' WHEN 1 THEN '-0.2' ELSE '0.' || CAST(arrival % 90 AS STRING) END
  || ', "reason": "' || title || ' at ' || company || '", "qualified": "' || CASE arrival % 4 WHEN 0 THEN 'YES' WHEN 1 THEN 'no' WHEN 2 THEN ' Borderline ' ELSE 'maybe' END
  || '", "unmet": ["' || location || '", " ", "years: ' || CAST(arrival % 8 AS STRING) || '"]} thanks' END AS verdict_raw,
 CASE WHEN arrival % 31 = 0 THEN 'nothing' ELSE
 'Report: {"requirements": [{"requirement": "' || title || '", "status": "' || CASE arrival % 4 WHEN 0 THEN 'covered' WHEN 1 THEN 'Partial' WHEN 2 THEN 'missing' ELSE 'unsure' END
  || '", "covered_by": "' || CASE arrival % 3 WHEN 0 THEN 'bench' WHEN 1 THEN 'coding' ELSE '' END || '"}, {"requirement": "Python", "status": "' || CASE arrival % 2 WHEN 0 THEN 'covered' ELSE 'missing' END
  || '", "covered_by": "coding"}, {"requirement": " ", "status": "covered", "covered_by": "x"}], "ats_keywords": [{"keyword": "sql", "present": ' || CASE arrival % 2 WHEN 0 THEN 'true' ELSE 'false' END
  || ', "where": "coding"}, {"keyword": "lab", "present": ' || CASE arrival % 3 WHEN 0 THEN 'true' ELSE 'false' END || ', "where": ""}], "strengths": '
  || CASE arrival % 5 WHEN 0 THEN '["' || company || '", "teamwork", "writing"]' ELSE '[]' END || ', "gaps": ' || CASE arrival % 7 WHEN 0 THEN '["driving"]' ELSE '[]' END || '}' END AS gap_raw,
 CASE WHEN arrival % 2 = 0 THEN '```json' || chr(10) ELSE '' END || '{"name": "' || company || '", "education": "' || title || '", "skills": ["sql", "' || location || '"], "languages": ["en"], "experience_summary": "' || source || '"}'
  || CASE WHEN arrival % 2 = 0 THEN chr(10) || '```' ELSE '' END AS profile_raw
FROM postings
"""

# Bodies of JSON services, one response per order.
SEARCH_BODIES = """
SELECT arrival,
 CASE WHEN arrival % 43 = 0 THEN '{"results": []}' ELSE
 '{"results": [{"title": "' || title || '", "redirect_url": "' || url || '&utm_medium=api&se=abc", "description": "' || description || '", "company": {"display_name": "' || company
 || '"}, "location": {"display_name": "' || location || '"}, "created": "' || COALESCE(posted_at, 'n/a') || '"}, {"title": "", "redirect_url": "https://x.example.org/1"}, {"title": 5, "redirect_url": "https://x.example.org/2"}, '
 || '{"title": "Second ' || title || '", "redirect_url": "https://x.example.org/v/' || CAST(arrival AS STRING) || '?v=2", "description": 7, "company": "plain", "location": {}, "created": null}]}' END AS body
FROM postings
"""
FEED_BODIES = """
SELECT arrival,
 '[{"legal": "terms"}, {"id": "' || CAST(arrival AS STRING) || '", "position": "' || title || '", "company": "' || company || '", "url": "' || url || '", "description": "<p>' || description || '</p>&amp;<br>more", "date": "'
 || COALESCE(posted_at, 'n/a') || '", "location": "' || CASE arrival % 3 WHEN 0 THEN 'Canada' WHEN 1 THEN 'Worldwide only' ELSE location END || '"}, {"id": "", "position": "no id", "url": "https://x.example.org"}, {"id": 9, "url": "https://x.example.org"}, '
 || '{"id": 7, "position": "Remote ' || title || '", "url": "https://r.example.org/' || CAST(arrival AS STRING) || '", "location": null}]' AS body
FROM postings
"""
PAGED_BODIES = """
SELECT arrival, (arrival % 4) * 20 AS offset,
 '{"total": ' || CAST(20 + arrival % 60 AS STRING) || ', "jobPostings": [{"title": " ' || title || ' ", "externalPath": "/job/' || CAST(arrival AS STRING) || '", "locationsText": "' || location || '", "postedOn": "Posted ' || CAST(arrival % 30 AS STRING)
 || ' Days Ago"}, {"title": "bad path", "externalPath": "job/x"}, {"title": " ", "externalPath": "/job/blank"}, {"title": "Bare", "externalPath": "/job/b' || CAST(arrival AS STRING) || '"}]}' AS body
FROM postings
"""

# Letters to be checked, with claims of several kinds in them.
LETTERS = """
SELECT arrival, 'I apply as ' || title || '. ' || CASE arrival % 6 WHEN 0 THEN 'I have 3 years of lab work and WHMIS.' WHEN 1 THEN 'Strong customer facing service.'
 WHEN 2 THEN 'Hands-on lab experience and bench skills.' WHEN 3 THEN 'Solid laboratory background.' WHEN 4 THEN 'I love numbers.' ELSE 'My lab experience is broad.' END || ' ' || description AS letter
FROM postings
"""

# Texts that name degrees in several ways.
STUDY_TEXTS = """
SELECT arrival, CASE arrival % 9 WHEN 0 THEN 'You are pursuing a Bachelor degree in science.' WHEN 1 THEN 'A Master''s degree is expected.'
 WHEN 2 THEN 'Enrolled in a bachelor degree or master degree programme.' WHEN 3 THEN 'Needs 2 years of university studies.'
 WHEN 4 THEN 'Must hold a college diploma.' WHEN 5 THEN 'There is no degree required.' WHEN 6 THEN 'Eligibility for provincial registration.'
 WHEN 7 THEN 'Working toward a PhD degree, or with a medical degree from any recognised school.' ELSE '' END || ' ' || description AS body
FROM postings
"""

# Saved result pages of two boards, one page with two cards per posting.
BOARD_PAGES = """
SELECT arrival AS page_id, CASE arrival % 2 WHEN 0 THEN 'linkedin' ELSE 'indeed' END AS source, 'https://boards.example.org/search' AS url,
 CASE arrival % 2 WHEN 0 THEN
 '<html><body><ul><li class="x"><div class="base-card"><a class="base-card__full-link" href="/jobs/view/' || CAST(arrival AS STRING) || '"> link </a><h3 class="base-search-card__title">' || title || '</h3><h4 class="base-search-card__subtitle"> ' || company
 || ' </h4><span class="job-search-card__location">' || location || '</span><time datetime="' || COALESCE(posted_at, '') || '">new</time></div></li><li>no link<br></li></ul></body></html>'
 ELSE '<html><body><div class="card job_seen_beacon"><h2 class="jobTitle"><a href="/rc/clk?x=1&amp;jk=k' || CAST(arrival AS STRING) || '&amp;y=2"><span title="' || title || '">cut...</span></a></h2><span data-testid="company-name">' || company
 || '</span><div data-testid="text-location">' || location || '</div><div class="job-snippet"><p>' || description || '</p></div></div><div class="job_seen_beacon"><a class="jcs-JobTitle" href="/nothing">No key</a></div></body></html>' END AS body
FROM postings
"""

# Detail texts fetched for the postings stored since 1995; some empty, some short.
DETAIL_TEXTS = """
SELECT url, CASE arrival % 4 WHEN 0 THEN '' WHEN 1 THEN 'Short text' ELSE description || ' Full text of ' || title END AS detail_text
FROM postings WHERE first_seen >= TIMESTAMP '1995-01-01 00:00:00'
"""

# Text files: one path per document.
TEXT_FILES = """
SELECT doc_id, 'texts/' || source || '/' || lang || '.txt' AS path, text FROM documents
"""

# Check results for queued postings.
VERDICTS = """
SELECT arrival, CASE arrival % 4 WHEN 0 THEN 'dead' WHEN 1 THEN 'live' WHEN 2 THEN 'live' ELSE 'unknown' END AS state,
 CASE arrival % 4 WHEN 1 THEN description || ' Full page text. ' || CASE arrival % 3 WHEN 0 THEN 'Certification required.' ELSE 'Enjoy.' END WHEN 2 THEN 'tiny' END AS full_text
FROM postings WHERE first_seen >= TIMESTAMP '1994-01-01 00:00:00'
"""

DERIVED = {
    "postings": POSTINGS, "status_events": STATUS_EVENTS, "responses": RESPONSES,
    "stored": STORED, "arrived": ARRIVED, "items": ITEMS, "answers": ANSWERS,
    "search_bodies": SEARCH_BODIES, "feed_bodies": FEED_BODIES, "paged_bodies": PAGED_BODIES,
    "letters": LETTERS, "study_texts": STUDY_TEXTS, "board_pages": BOARD_PAGES,
    "detail_texts": DETAIL_TEXTS, "text_files": TEXT_FILES, "verdicts": VERDICTS,
}
GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
# views over other views
ON_POSTINGS = (
    "stored", "arrived", "answers", "search_bodies", "feed_bodies", "paged_bodies", "letters",
    "study_texts", "board_pages", "detail_texts", "verdicts",
)
NEEDS = {name: ("postings",) for name in ON_POSTINGS}


class Tables:
    """Lazy access to the given and the derived tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        # the derived views cast timestamps to text
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name in GIVEN:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in DERIVED:
            return self.derive(DERIVED[name])
        raise AttributeError(name)

    def derive(self, sql: str, **given: DataFrame) -> DataFrame:
        """Run a view text; the tables it names are passed in, no catalog entry is made."""
        used = {
            n: given[n] if n in given else getattr(self, n)
            for n in (*GIVEN, *DERIVED)
            if _names(sql, n)
        }
        sql = sql.replace("{", "{{").replace("}", "}}")
        for name in used:
            sql = _replace_word(sql, name)
        return self.spark.sql(sql, **used)

    def postings_of(self, orders: DataFrame) -> DataFrame:
        """The postings view over other orders, such as a micro-batch."""
        return Tables(orders.sparkSession, self.folder).derive(POSTINGS, orders=orders)

    def status_events_of(self, events: DataFrame) -> DataFrame:
        return Tables(events.sparkSession, self.folder).derive(STATUS_EVENTS, events=events)

    @cached_property
    def identified(self) -> DataFrame:
        from gleaner.operators.identity import with_identity

        return with_identity(self.postings)


def _names(sql: str, name: str) -> bool:
    return re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql) is not None


def _replace_word(sql: str, name: str) -> str:
    return re.sub(rf"(?<=FROM ){name}\b|(?<=JOIN ){name}\b", "{" + name + "}", sql)


def oracle_views(sql: str) -> str:
    """Prefix an oracle text with the derived views it uses."""

    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, ()):
            add(n)
        if name not in order:
            order.append(name)

    for n in DERIVED:
        if _names(sql, n):
            add(n)
    ctes = [f"{n} AS ({DERIVED[n].strip()})" for n in order]
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
