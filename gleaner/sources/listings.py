"""Listing cards and detail texts from saved pages, described by one spec per source."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.sources.markup import Element, parse


@dataclass(frozen=True)
class Field:
    """Where a field is read: the first selector that matches; what stands for absent or blank."""

    selectors: list[str]
    absent: str = ""
    blank: str = ""


@dataclass(frozen=True)
class ListingSpec:
    """How one source lists its records.

    Selectors may end in ``@n`` (n-th match, -1 the last) or ``%name`` (an attribute), and start
    with ``^box `` (look inside the nearest enclosing box). ``items`` are tried in order; the
    first that matches anything is used. An empty ``link`` means the item is the link.
    """

    items: list[str]
    link: str = "a"
    title: list[str] = field(default_factory=list)
    min_title: int = 1
    href_part: str = ""
    fields: Mapping[str, Field] = field(default_factory=dict)
    title_in_link: bool = False
    or_link_text: bool = False
    needs: str = ""
    skip_class: str = ""
    company: str = ""
    location: str = ""
    key_attr: str = ""
    key_pattern: str = ""
    url_form: str = ""


@dataclass(frozen=True)
class DetailSpec:
    """Ordered body selectors; a body shorter than ``min_chars`` is passed over."""

    bodies: list[str]
    min_chars: int = 1
    paragraphs: str = ""
    sections: tuple[str, str] = ("", "")
    first_only: bool = False


# Selectors of the sources' markup.
_JOB_LINK = "a.jobTitle-link"
_DEPARTMENT = ".department, .field--name-field-department"
LISTINGS: dict[str, ListingSpec] = {
    "jobbank": ListingSpec(
        ["article a.resultJobItem"], link="", title=[".noctitle"],
        fields={"company": Field([".business"]), "location": Field([".location"])},
    ),
    "talent": ListingSpec(
        ['article[data-testid="job-card-unified"]'], title=['[class*="JobCard_title"]'],
        min_title=3, href_part="/view",
        fields={
            "company": Field(['[class*="JobCard_company"]'], "Unknown", "Unknown"),
            "location": Field(['[class*="JobCard_location"]']),
            "snippet": Field(['[class*="JobCard_description"]']),
        },
    ),
    "icims": ListingSpec(
        ["a.iCIMS_Anchor"], link="", title=["h3"], or_link_text=True, min_title=3, href_part="/jobs/",
        fields={"snippet": Field(["^.row div.description"])},
    ),
    "uoguelph": ListingSpec(
        ["li.job-tile"], link=_JOB_LINK, company="University of Guelph",
        fields={
            "location": Field([".section-field.location div@-1"]),
            "division": Field([".section-field.facility div@-1"]),
            "department": Field([".section-field.dept div@-1"]),
        },
    ),
    "laurier": ListingSpec(
        ["tr.data-row"], link=_JOB_LINK, company="Wilfrid Laurier University",
        fields={
            "location": Field(["td.colLocation span.jobLocation", "span.jobLocation"]),
            "department": Field(["td.colFacility span.jobFacility", "span.jobFacility"]),
        },
    ),
    "hamiltonhealth": ListingSpec(
        ["tr.data-row"], link=_JOB_LINK, company="Hamilton Health Sciences",
        fields={
            "location": Field(["span.jobLocation"], "Hamilton, ON"),
            "facility": Field(["span.jobFacility"]),
        },
    ),
    "conestoga": ListingSpec(
        ["table.table.table-striped tr"], link="td a", title=["td@1"], company="Conestoga College",
        needs="td@3", skip_class="tableheader",
        fields={
            "requisition": Field(["td a"]), "location": Field(["td@2"]), "closing": Field(["td@3"]),
        },
    ),
    "grandriver": ListingSpec(
        ["li.views-row", "div.view-content article", "table.views-table tbody tr", ".job-listing",
         "div.field--name-title"],
        min_title=4, company="Grand River Hospital",
        fields={
            "location": Field([".location, .views-field-field-location"], "Kitchener/Waterloo, ON"),
            "department": Field([".department, .views-field-field-department"]),
        },
    ),
    "cambridge": ListingSpec(
        ["li.views-row", "div.views-row", "article.job", "table.career-table tbody tr",
         ".job-opportunity"],
        min_title=4, company="Cambridge Memorial Hospital", location="Cambridge, ON",
        fields={"department": Field([".department, .field--name-field-dept"])},
    ),
    "stmarys": ListingSpec(
        ["li.views-row", "div.view-content > div", "article.node--type-job",
         "table.career-table tbody tr", ".job-posting"],
        min_title=4, company="St. Mary's General Hospital", location="Kitchener, ON",
        fields={"department": Field([_DEPARTMENT])},
    ),
    "linkedin": ListingSpec(
        [".base-card, li"], link="a.base-card__full-link", title=[".base-search-card__title"],
        fields={
            "company": Field([".base-search-card__subtitle"]),
            "location": Field([".job-search-card__location"]),
            "posted_at": Field(["time[datetime]%datetime"]),
        },
    ),
    "indeed": ListingSpec(
        ['div.job_seen_beacon, [data-testid="slider_item"]'],
        link="a.jcs-JobTitle, h2.jobTitle a, a[data-jk]",
        title=["span[title]%title"], title_in_link=True, or_link_text=True,
        key_attr="data-jk", key_pattern=r"[?&]jk=([^&]+)",
        url_form="https://ca.indeed.com/viewjob?jk={key}",
        fields={
            "company": Field(['[data-testid="company-name"], span.companyName']),
            "location": Field(['[data-testid="text-location"], div.companyLocation']),
            "snippet": Field(
                ['[data-testid="jobsnippet_footer"] ul li, div.snippet p, div.job-snippet']
            ),
        },
    ),
}
_TALEO = ['span[itemprop="description"] span.jobdescription', "span.jobdescription"]
DETAILS: dict[str, DetailSpec] = {
    "jobbank": DetailSpec(
        ["#jobDescriptionId", ".job-posting-detail-requirements"], paragraphs="main p"
    ),
    "talent": DetailSpec(
        ['[class*="jobDescription"]', '[class*="JobDescription"]', '[class*="description"]', "main"],
        first_only=True,
    ),
    "icims": DetailSpec(
        ["div.iCIMS_JobContent", "div.iCIMS_InfoMsg_Job", '[class*="JobDescription"]', "main"],
        first_only=True,
    ),
    "uoguelph": DetailSpec(_TALEO, first_only=True),
    "laurier": DetailSpec(_TALEO, first_only=True),
    "hamiltonhealth": DetailSpec(_TALEO, first_only=True),
    "conestoga": DetailSpec([], min_chars=31, sections=("h2", "div.col-12")),
    "grandriver": DetailSpec(
        ["div.field--name-body", "div.job-description", "main article", ".views-field-body"],
        min_chars=51, first_only=True,
    ),
    "cambridge": DetailSpec(
        ["div.field--name-body", "div.job-description", "main article", ".entry-content"],
        min_chars=51, first_only=True,
    ),
    "stmarys": DetailSpec(
        ["div.field--name-body", "div.job-description", "main article"],
        min_chars=51, first_only=True,
    ),
    "linkedin": DetailSpec(
        ["div.show-more-less-html__markup", "div.description__text",
         "div.jobs-description-content__text", "section.description"],
        min_chars=30,
    ),
    "indeed": DetailSpec(
        ["div#jobDescriptionText", "div.jobsearch-jobDescriptionText",
         'div[data-testid="jobDescriptionText"]', "div.jobDescription"],
        min_chars=30,
    ),
}

LISTING_SCHEMA = (
    "page_id bigint, source string, pos int, url string, title string, company string,"
    "location string, snippet string, posted_at string, listing_key string,"
    "extra map<string,string>, error string"
)
DETAIL_SCHEMA = "page_id bigint, source string, url string, detail_text string, posted_at string, error string"
LISTING_ARROW = pa.schema(
    [("page_id", pa.int64()), ("source", pa.string()), ("pos", pa.int32())]
    + [(n, pa.string()) for n in ("url", "title", "company", "location", "snippet", "posted_at", "listing_key")]
    + [("extra", pa.map_(pa.string(), pa.string())), ("error", pa.string())]
)
# What a Python worker holds at once: bytes of a batch of pages, and pages whose cards leave together.
BATCH_BYTES, PAGES_AT_ONCE = 8 << 20, 500
_PLAIN = ("company", "location", "snippet", "posted_at")


def _pick(node: Element, selector: str) -> str | None:
    """Text (or attribute) a selector of the spec form points at; null when nothing matches."""
    selector, _, attribute = selector.partition("%")
    selector, _, index = selector.partition("@")
    if selector.startswith("^"):
        box, _, selector = selector[1:].partition(" ")
        node = node.ancestor(box)
        if node is None:
            return None
    if index:
        found = node.find(selector)
        n = int(index)
        hit = found[n] if -len(found) <= n < len(found) else None
    else:
        hit = node.first(selector)
    if hit is None:
        return None
    return hit.attrs.get(attribute, "").strip() if attribute else hit.text()


def _read_field(node: Element, f: Field) -> str:
    for s in f.selectors:
        value = _pick(node, s)
        if value is not None:
            return value or f.blank
    return f.absent


def read_cards(html: str, page_url: str, spec: ListingSpec) -> Iterator[dict]:
    tree = parse(html)
    try:
        yield from _cards(tree, page_url, spec)
    finally:
        tree.drop()


def _cards(tree: Element, page_url: str, spec: ListingSpec) -> Iterator[dict]:
    items = next((found for s in spec.items if (found := tree.find(s))), [])
    seen: set[str] = set()
    for item in items:
        if spec.skip_class and spec.skip_class in item.attrs.get("class", "").split():
            continue
        if spec.needs and _pick(item, spec.needs) is None:
            continue
        link = item.first(spec.link) if spec.link else item
        href = link.attrs.get("href", "") if link is not None else ""
        if not href or spec.href_part not in href:
            continue
        key = link.attrs.get(spec.key_attr, "") if spec.key_attr else ""
        if spec.key_pattern:
            if not key:
                m = re.search(spec.key_pattern, href)
                key = m[1] if m else ""
            if not key:
                continue
        url = spec.url_form.format(key=key) if spec.url_form else urljoin(page_url, href)
        if url in seen:
            continue
        seen.add(url)
        box = link if spec.title_in_link else item
        title = next((t for s in spec.title if (t := _pick(box, s))), "")
        if not title and (spec.or_link_text or not spec.title):
            title = link.text()
        if len(title) < max(spec.min_title, 1):
            continue
        values = {n: _read_field(item, f) for n, f in spec.fields.items()}
        yield {
            "url": url,
            "title": title,
            "company": values.get("company", spec.company),
            "location": values.get("location", spec.location),
            "snippet": values.get("snippet", ""),
            "posted_at": values.get("posted_at") or None,
            "listing_key": key or None,
            "extra": {k: v for k, v in values.items() if k not in _PLAIN and v},
        }


def read_detail(html: str, spec: DetailSpec) -> tuple[str, str | None]:
    tree = parse(html)
    try:
        return _detail(tree, spec)
    finally:
        tree.drop()


def _detail(tree: Element, spec: DetailSpec) -> tuple[str, str | None]:
    text = ""
    if spec.sections[0]:
        boxes = [n.ancestor(spec.sections[1]) for n in tree.find(spec.sections[0])]
        parts = [b.text() for b in boxes if b is not None]
        text = "\n\n".join(p for p in parts if len(p) >= spec.min_chars)
    for selector in spec.bodies:
        node = tree.first(selector)
        if node is None:
            continue
        found = node.text()
        text = found if len(found) >= spec.min_chars else ""
        if text or spec.first_only or spec.paragraphs:
            break
    else:
        if spec.paragraphs:
            text = " ".join(p.text() for p in tree.find(spec.paragraphs)).strip()
    stamp = tree.first("time[datetime]")
    return text, (stamp.attrs["datetime"] or None) if stamp is not None else None


NO_SPEC = "no spec for this source"


def parse_listings(responses: DataFrame, specs: Mapping[str, ListingSpec] = LISTINGS) -> DataFrame:
    """Every card of every listing page, and a row with an ``error`` for a page that has no spec or
    cannot be read. One parser pass per page, pages stay where they are."""
    specs = dict(specs)
    names = LISTING_ARROW.names

    def read(page: tuple) -> Iterator[dict]:
        page_id, source, url, body = page
        try:
            if source not in specs:
                raise LookupError(NO_SPEC)
            cards = list(read_cards(body or "", url or "", specs[source]))
        except (LookupError, ValueError) as e:
            yield {"page_id": page_id, "source": source, "url": url, "error": str(e)}
            return
        for pos, card in enumerate(cards, 1):
            yield {"page_id": page_id, "source": source, "pos": pos, **card, "extra": list(card["extra"].items())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                pages = zip(*(c.to_pylist() for c in batch.slice(at, PAGES_AT_ONCE).columns))
                rows = [row for page in pages for row in read(page)]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], f.type) for n, f in zip(names, LISTING_ARROW)], schema=LISTING_ARROW)

    return _pages(responses).mapInArrow(run, LISTING_SCHEMA)


def _pages(responses: DataFrame) -> DataFrame:
    """The columns that the parsers read, in batches bounded by bytes, as pages may be long."""
    responses.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return responses.select("page_id", "source", "url", "body")


def extract_listings(responses: DataFrame, specs: Mapping[str, ListingSpec] = LISTINGS) -> DataFrame:
    """The cards alone; ``page_errors(parse_listings(...))`` tells what is missing."""
    return parse_listings(responses, specs).where("error IS NULL").drop("error")


def parse_details(responses: DataFrame, specs: Mapping[str, DetailSpec] = DETAILS) -> DataFrame:
    """One row per detail page; those without a spec, or not readable, have an ``error``."""
    specs = dict(specs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            rows = []
            for page_id, source, url, body in pages.itertuples(index=False):
                try:
                    if source not in specs:
                        raise LookupError(NO_SPEC)
                    rows.append((page_id, source, url, *read_detail(body or "", specs[source]), None))
                except (LookupError, ValueError) as e:
                    rows.append((page_id, source, url, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["page_id", "source", "url", "detail_text", "posted_at", "error"])

    return _pages(responses).mapInPandas(run, DETAIL_SCHEMA)


def extract_detail_text(responses: DataFrame, specs: Mapping[str, DetailSpec] = DETAILS) -> DataFrame:
    return parse_details(responses, specs).where("error IS NULL").drop("error")


def page_errors(parsed: DataFrame) -> DataFrame:
    """(page_id, source, url, error) of the pages that a parser could not use."""
    return parsed.where("error IS NOT NULL").select("page_id", "source", "url", "error")


# -- joining details back ---------------------------------------------------------------

# How a source's detail text meets its listing row.
MERGE_POLICY = {
    "talent": "longer", "icims": "longer", "uoguelph": "replace", "laurier": "replace",
    "hamiltonhealth": "replace", "cambridge": "replace", "grandriver": "replace",
    "stmarys": "replace", "conestoga": "append",
}

def fallback_description(snippet: Column, title: Column, company: Column, location: Column) -> Column:
    made = F.concat(title, F.lit(" at "), X.text_of(company), F.lit(". "), X.text_of(location))
    return F.coalesce(F.when(snippet != "", snippet), made)


def merge_detail_text(
    listings: DataFrame, details: DataFrame, policies: Mapping[str, str] = MERGE_POLICY
) -> DataFrame:
    """Detail text joined on url: keep the longer, replace, or append to the row's
    own header lines. ``listings`` has one row per url, ``details`` too."""
    j = listings.join(details.select("url", "detail_text"), "url", "left")
    own, found = X.text_of(F.col("description")), X.text_of(F.col("detail_text"))
    policy = F.create_map(*[F.lit(x) for kv in policies.items() for x in kv])[F.col("source")]
    merged = (
        F.when((policy == "longer") & (F.length(found) > F.length(own)), found)
        .when((policy == "replace") & (found != ""), found)
        .when(
            (policy == "append") & (found != ""),
            F.concat_ws("\n\n", F.when(own != "", own), found),
        )
        .otherwise(own)
    )
    return j.withColumn("description", merged).drop("detail_text")
