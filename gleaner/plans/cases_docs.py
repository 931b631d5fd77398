"""Queries over per-record documents, prompts and the pluggable source and sink."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import params as P
from gleaner.functions import answers as A
from gleaner.operators import documents as DOC
from gleaner.operators import filters, scoring, state
from gleaner.operators.documents import Item
from gleaner.plans import sqltext as S
from gleaner.plans.cases import Tables, case, r6, sql_list, sql_text
from gleaner.plans.cases_filters import letter_sql
from gleaner.plans.cases_scoring import best_profile_sql
from gleaner.plans.cases_state import _APPLY, candidates, claims_sql, fresh_folder
from gleaner.sources import listings

c = F.col

ITEMS = [
    Item("degree", "education", "BSc Chemistry", "Example College", ["Organic chemistry", "Statistics"], ["education", "science"], True),
    Item("bench", "experience", "Bench assistant", "Example Lab", ["Prepared samples", "Kept records", "Calibrated scales", "Trained peers"], ["lab", "research"]),
    Item("coding", "projects", "Data scripts", "", ["Python and SQL reports"], ["technical", "ai"]),
    Item("shop", "experience", "Shop assistant", "Corner Shop", ["Served customers", "Closed the till"], ["customer-service"]),
    Item("camp", "activities", "Camp guide", "", ["Led groups"], ["leadership", "tutor"]),
    Item("languages", "skills", "Languages", "", ["English, French"], ["languages"]),
    Item("firstaid", "certs", "First aid", "", [], ["certs"]),
    Item("robot", "projects", "Robot arm", "Club", ["Built a gripper"], ["technical", "leadership"]),
    Item("tutor", "activities", "Tutor", "", ["Maths"], ["tutor", "education"]),
    Item("poster", "projects", "Research poster", "", ["Second prize"], ["research", "science"]),
    Item("hobby", "hobbies", "Chess", "", [], ["games"]),
    Item("office", "experience", "Office help", "", ["Filed forms"], ["admin", "customer-service"]),
]
OVERLAY = {"general": {"admin": 2.5}, "technical": {"technical": 4}}
SUMMARIES = {"general": "Reliable and curious.", "research": "Careful at the bench."}


def _items_sql() -> str:
    rows = ", ".join(
        f"({pos}, {sql_text(i.id)}, {sql_text(i.section)}, {sql_text(i.title)}, {sql_text(i.sub)}, {sql_list(i.bullets)}::VARCHAR[], {sql_list(i.tags)}, {str(i.core).lower()})"
        for pos, i in enumerate(ITEMS, 1)
    )
    return f"(VALUES {rows}) AS m(pos, id, section, title, sub, bullets, tags, core)"


def _weights_sql() -> str:
    rows = []
    for name in P.DOCUMENT_PROFILES:
        for tag, w in {**P.TAG_WEIGHTS[name], **OVERLAY.get(name, {})}.items():
            rows.append(f"('{name}', '{tag}', {float(w)}::DOUBLE)")
    return f"(VALUES {', '.join(rows)}) AS w(profile, tag, weight)"


# bench is covered for every third, coding for every second posting
_COVER = "CASE WHEN arrival % 3 = 0 THEN ['bench'] ELSE [] END || CASE WHEN arrival % 2 = 0 THEN ['coding'] ELSE [] END"
_ITEM_CTES = f"""
WITH prof AS ({best_profile_sql('*')}), cov AS (SELECT *, {_COVER} AS covered FROM prof),
mi AS (SELECT * FROM {_items_sql()}), tw AS (SELECT * FROM {_weights_sql()}),
tagged AS (SELECT pos, unnest(tags) AS tag FROM mi),
base AS (SELECT p.profile, mi.pos, coalesce(sum(tw.weight), 0) AS w FROM (SELECT unnest({sql_list(P.DOCUMENT_PROFILES)}) AS profile) p CROSS JOIN mi JOIN tagged USING (pos) LEFT JOIN tw ON tw.profile = p.profile AND tw.tag = tagged.tag GROUP BY ALL),
weighed AS (SELECT cov.arrival, cov.profile, mi.*, base.w + CASE WHEN list_contains(covered, mi.id) THEN 10 ELSE 0 END AS weight FROM cov CROSS JOIN mi JOIN base ON base.profile = cov.profile AND base.pos = mi.pos)
"""


def profiled(t: Tables) -> DataFrame:
    covered = F.concat(
        F.when(c("arrival") % 3 == 0, F.array(F.lit("bench"))).otherwise(F.array().cast("array<string>")),
        F.when(c("arrival") % 2 == 0, F.array(F.lit("coding"))).otherwise(F.array().cast("array<string>")),
    )
    p = t.postings.withColumn("profile", scoring.best_profile(c("title"), c("description")))
    return DOC.weigh_items(p.withColumn("covered", covered), ITEMS, OVERLAY)


@case("items_cross_jobs", _ITEM_CTES + "SELECT arrival, id AS item_id, profile, round(weight, 6) AS weight FROM weighed")
def _(t: Tables) -> DataFrame:
    e = profiled(t).select("arrival", "profile", F.explode_outer("weighed").alias("e"))
    return e.select("arrival", c("e.item.id").alias("item_id"), "profile", r6("e.weight").alias("weight"))


@case("item_weight", _ITEM_CTES + "SELECT arrival, round(sum(weight), 6) AS total, round(max(weight), 6) AS best FROM weighed GROUP BY arrival")
def _(t: Tables) -> DataFrame:
    weights = F.transform("weighed", lambda e: e["weight"])
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    return profiled(t).select("arrival", r6(total).alias("total"), r6(F.array_max(weights)).alias("best"))


_ORDERS = "CASE profile " + " ".join(f"WHEN '{p}' THEN {sql_list(s)}" for p, s in P.SECTION_ORDER.items()) + " END"
_SELECTED = _ITEM_CTES + f"""
, ok AS (SELECT * FROM weighed WHERE core OR (weight > 0 AND NOT (profile = 'customer-service' AND list_has_any(tags, ['technical', 'ai', 'lab', 'research'])))),
kept AS (SELECT * FROM ok QUALIFY core OR row_number() OVER (PARTITION BY arrival, core ORDER BY weight DESC, pos) <= 7),
chosen AS (SELECT *, list_position({_ORDERS}, section) AS so, row_number() OVER (PARTITION BY arrival ORDER BY list_position({_ORDERS}, section), weight DESC, pos) AS at_pos FROM kept WHERE list_contains({_ORDERS}, section))
"""


@case(
    "select_items",
    _SELECTED + "SELECT arrival, at_pos AS position, id AS item_id, section, array_to_string(bullets[1:3], '|') AS bullets FROM chosen",
)
def _(t: Tables) -> DataFrame:
    s = DOC.select_items(profiled(t), 3, P.MAX_OTHER_ITEMS).select("arrival", F.posexplode_outer("chosen").alias("p", "e")).where(c("p").isNotNull())
    return s.select(
        "arrival",
        (c("p") + 1).cast("bigint").alias("position"),
        c("e.item.id").alias("item_id"),
        c("e.item.section").alias("section"),
        F.array_join("e.item.bullets", "|").alias("bullets"),
    )


_TITLES = "CASE section " + " ".join(f"WHEN '{k}' THEN {sql_text(v)}" for k, v in P.SECTION_TITLES.items()) + " END"
NAME, CONTACT = "Robin Doe", "Springfield · robin@example.org"


@case(
    "resumes_batch",
    _SELECTED
    + f""", lines AS (SELECT arrival, profile, at_pos, CASE WHEN lag(section) OVER (PARTITION BY arrival ORDER BY at_pos) IS DISTINCT FROM section THEN '## ' || {_TITLES} || chr(10) ELSE '' END
 || '**' || title || '**' || CASE WHEN sub <> '' THEN ' — ' || sub ELSE '' END || chr(10) || array_to_string(list_transform(bullets[1:3], lambda b: '- ' || b || chr(10)), '') AS block FROM chosen),
texts AS (SELECT arrival, any_value(profile) AS profile, string_agg(block, chr(10) ORDER BY at_pos) AS body FROM lines GROUP BY arrival)
SELECT arrival, '# {NAME}' || chr(10) || '{CONTACT}' || chr(10) || chr(10) || '_Profile: ' || profile || '_' || chr(10) || chr(10) || CASE WHEN profile = 'research' THEN 'Careful at the bench.' ELSE 'Reliable and curious.' END || chr(10) || chr(10)
 || rtrim(body, chr(10)) || chr(10) AS resume FROM texts JOIN postings USING (arrival) WHERE score >= 0.5 AND arrival % 17 <> 0
""",
)
def _(t: Tables) -> DataFrame:
    """A drafting step may change items; here it adds to every 17th record, which is then rejected."""
    top = DOC.select_items(profiled(t).where(c("score") >= 0.5), 3, P.MAX_OTHER_ITEMS)
    added = F.transform(
        "chosen", lambda e: e.withField("item", e["item"].withField("sub", F.concat(e["item"]["sub"], F.lit(" with honours"))))
    )
    drafted = top.withColumn("chosen", F.when(c("arrival") % 17 == 0, added).otherwise(c("chosen")))
    return DOC.tailored_resumes(drafted, ITEMS, NAME, CONTACT, SUMMARIES).select("arrival", "resume")


_PAGE_HEAD = "'# {kind} — ' || title || chr(10) || chr(10) || '- **Company:** ' || company || chr(10) || '- **Location:** ' || location || chr(10) || '- **Source:** ' || source || chr(10) || '- **URL:** ' || url || chr(10) || '- **Generated:** 2024-03-15{note}' || chr(10) || chr(10) || '---' || chr(10) || chr(10)"
BACKING = "Retail assistant with lab courses."


@case(
    "letters_batch",
    f"""
WITH b AS (SELECT *, {letter_sql()} AS body FROM postings WHERE ({S.unsuitable()}) IS NULL)
SELECT arrival, {_PAGE_HEAD.format(kind='Cover Letter', note=' (backend: template)')} || body || chr(10) AS letter, array_to_string({claims_sql('body', BACKING, ['numbers', 'bench work'])}, '; ') AS warnings FROM b
""",
)
def _(t: Tables) -> DataFrame:
    ok = filters.with_suitability(t.postings).where(c("unsuitable_reason").isNull())
    out = DOC.letters(ok, "Robin Doe", BACKING, "2024-03-15", ["numbers", "bench work"])
    return out.select("arrival", "letter", F.array_join("warnings", "; ").alias("warnings"))


@case(
    "prep_questions",
    f"""
SELECT arrival, number, question, '## Interview Prep — ' || title || ' @ ' || company AS heading FROM postings, (SELECT unnest({sql_list(P.PREP_QUESTIONS)}) AS question, unnest(range(1, 11)) AS number) q
""",
)
def _(t: Tables) -> DataFrame:
    rows = DOC.prep_questions(t.postings.select("arrival", "title", "company"))
    sheet = DOC.prep_sheet(c("title"), c("company"))
    return rows.select("arrival", "number", "question", F.get(F.split(sheet, "\n"), F.lit(0)).alias("heading"))


@case(
    "apply_actions",
    _APPLY
    + f""", w AS (SELECT *, len({claims_sql('(title || chr(32) || description)', BACKING, ['widget'])}) > 0 AS warned FROM m WHERE ok)
SELECT arrival, method, CASE WHEN warned THEN 'skipped' ELSE 'manual' END AS action, CASE WHEN NOT warned THEN 'interested' END AS new_status,
 CASE WHEN warned THEN NULL WHEN method = 'email' THEN 'email apply queued to ' || target || ' (SMTP not configured)' ELSE 'cover letter saved, manual submit needed (' || method || ')' END AS note FROM w
UNION ALL SELECT arrival, method, 'dry_run', NULL, NULL FROM w
UNION ALL SELECT arrival, method, CASE method WHEN 'email' THEN 'email' ELSE 'manual' END, CASE method WHEN 'email' THEN 'applied' ELSE 'interested' END, CASE method WHEN 'email' THEN 'auto-emailed to ' || target ELSE 'cover letter saved, manual submit needed (' || method || ')' END FROM w
""",
)
def _(t: Tables) -> DataFrame:
    from gleaner.functions.text import title_and_text

    ok = candidates(t).where(c("unsuitable_reason").isNull())
    w = ok.withColumn("warnings", DOC.claim_warnings(title_and_text(c("title"), c("description")), F.lit(BACKING), ["widget"]))
    runs = [DOC.apply_actions(w, False, True, False), DOC.apply_actions(w, True, False, False), DOC.apply_actions(w, False, False, True)]
    out = runs[0].unionByName(runs[1]).unionByName(runs[2])
    return out.select("arrival", "method", "action", "new_status", "note")


def _prompt_sql(template: str, values: dict[str, str]) -> str:
    out = sql_text(template)
    for name, value in values.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


RESUME_TEXT = "Robin Doe\nBSc Chemistry\n" + "Prepared samples and kept records. " * 120
_LINES = "\n".join(
    f"[{i.id}] ({i.section}) {i.title}" + (f" ({i.sub})" if i.sub else "") + (" — " + " ".join(i.bullets) if i.bullets else "")
    for i in ITEMS
)
_FIELDS = {"title": "title", "company": "company", "location": "location"}


@case(
    "build_prompt_rows",
    f"""
SELECT arrival, {_prompt_sql(P.VERDICT_PROMPT, {'resume': sql_text(RESUME_TEXT), **_FIELDS, 'description': 'description'})} AS verdict_prompt,
 {_prompt_sql(P.GAP_PROMPT, {'items': sql_text(_LINES), **_FIELDS, 'description': 'description'})} AS gap_prompt FROM postings
""",
)
def _(t: Tables) -> DataFrame:
    lines = F.array_join(
        F.transform(DOC.items_literal(ITEMS), lambda i: DOC.item_line(i["id"], i["section"], i["title"], i["sub"], i["bullets"])), "\n"
    )
    fields = [c("title"), c("company"), c("location"), c("description")]
    return t.postings.select(
        "arrival",
        DOC.verdict_prompt(F.lit(RESUME_TEXT), *fields).alias("verdict_prompt"),
        DOC.gap_prompt(lines, *fields).alias("gap_prompt"),
    )


# -- pluggable source and sink: rows only -------------------------------------------------


@case(
    "plug_source",
    "SELECT page_id, title FROM (SELECT page_id, "
    + S.main_text("regexp_extract(html, '(?s)<article[^>]*>.*?<h1[^>]*>(.*?)</h1>', 1)", ())
    + " AS title FROM pages) WHERE title <> ''",
)
def _(t: Tables) -> DataFrame:
    """A new source is one spec: here the headline of every saved page."""
    own = {"web": listings.DetailSpec(["article h1"])}
    pages = t.pages.select("page_id", F.lit("web").alias("source"), "url", F.col("html").alias("body"))
    heads = listings.extract_detail_text(pages, own).select("page_id", c("detail_text").alias("title"))
    return heads.where(c("title") != "")


@case(
    "plug_sink",
    """SELECT count(*) AS matched_count, CAST(to_json(list(arrival ORDER BY arrival)) AS VARCHAR) AS jobs_alerted, '{"min_score": 0.9}' AS filter_used
FROM postings WHERE score >= 0.9 HAVING count(*) > 0""",
)
def _(t: Tables) -> DataFrame:
    """Any callable that takes the matched rows and says whether they were sent."""
    folder = fresh_folder(t, "sink")

    def send(rows: DataFrame) -> bool:
        rows.write.mode("overwrite").json(folder)
        return True

    matched = t.postings.where(c("score") >= 0.9).select("arrival", "title")
    log = state.send_alert(matched, send, json.dumps({"min_score": 0.9}))
    return log.select("matched_count", "jobs_alerted", "filter_used")
