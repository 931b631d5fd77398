"""Column predicates and first-match cascades. A cascade returns the reason, null when it passes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import params as P
from gleaner.functions.text import (
    contains_any,
    first_contained,
    first_email,
    first_hit,
    first_title_word,
    let,
    term_alternation,
    text_of,
    title_and_text,
)


def is_closed(description: Column, phrases: Iterable[str] = P.CLOSED_PHRASES) -> Column:
    return let(F.lower(text_of(description)), lambda d: contains_any(d, phrases))


def matched_phrase(text: Column, phrases: Iterable[str], case_sensitive: bool = False) -> Column:
    phrases = list(phrases)
    if case_sensitive:
        return first_contained(text, phrases)
    return let(
        F.lower(text), lambda t: first_hit((F.contains(t, F.lit(p.lower())), p) for p in phrases)
    )


def credential_block(text: Column) -> Column:
    body = text_of(text)
    return (
        F.when(body.rlike(P.EDUCATION_YEARS_PATTERN), F.lit(P.REASON_EDUCATION))
        .when(body.rlike(P.CREDENTIAL_PATTERN), F.lit(P.REASON_CREDENTIAL))
        .when(
            body.rlike(P.NAMED_DEGREE_PATTERN) & _degree_outside_study(body), F.lit(P.REASON_DEGREE)
        )
    )


def _degree_outside_study(body: Column) -> Column:
    """Some named degree whose 25 preceding characters do not speak of ongoing study."""
    pieces = F.split(body, P.NAMED_DEGREE_PATTERN)
    degrees = F.regexp_extract_all(body, F.lit(P.NAMED_DEGREE_PATTERN), F.lit(0))
    # context before match i = the text up to it; a short piece reaches into earlier matches,
    # and 25 characters can span no more than the two matches before (each has ten or more)
    def before(i: Column) -> Column:
        earlier = F.concat(
            F.coalesce(F.get(pieces, i - 2), F.lit("")),
            F.coalesce(F.get(degrees, i - 2), F.lit("")),
            F.coalesce(F.get(pieces, i - 1), F.lit("")),
            F.coalesce(F.get(degrees, i - 1), F.lit("")),
            F.get(pieces, i),
        )
        return F.substring(
            earlier, F.greatest(F.length(earlier) - P.DEGREE_CONTEXT + 1, F.lit(1)), F.length(earlier)
        )

    flags = F.transform(degrees, lambda d, i: ~F.rlike(before(i), F.lit(P.IN_PROGRESS_PATTERN)))
    return F.exists(flags, lambda f: f)


def max_years(text: Column, pattern: str = P.YEARS_PATTERN) -> Column:
    found = F.regexp_extract_all(text_of(text), F.lit(pattern), F.lit(1))
    return F.array_max(F.transform(found, lambda y: y.try_cast("bigint")))


def extract_province(location: Column) -> Column:
    loc = text_of(location)
    low = F.lower(loc)
    codes = sorted(set(P.PROVINCES.values()))
    named = let(
        low, lambda p: first_hit((F.contains(p, F.lit(n)), code) for n, code in P.PROVINCES.items())
    )
    in_brackets = F.regexp_extract(loc, r"\(([A-Z]{2})\)", 1)
    after_comma = F.regexp_extract(loc, r",\s*([A-Z]{2})\b", 1)
    return F.coalesce(
        named,
        F.when(in_brackets.isin(codes), in_brackets),
        F.when(after_comma.isin(codes), after_comma),
        F.when(loc.rlike(r"\bON\b"), F.lit("ON")),
    )


def company_blocked(company: Column, blocked: Iterable[str]) -> Column:
    return contains_any(F.lower(text_of(company)), [b.lower() for b in blocked])


def compiles(pattern: str) -> bool:
    """Does the engine that runs the pattern accept it? Asked of Java, whose rules differ from re."""
    from pyspark.errors import IllegalArgumentException
    from pyspark import SparkContext

    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile("(?i)" + pattern)
    except IllegalArgumentException:
        return False
    return True


def title_matches(title: Column, pattern: str) -> Column:
    """Case-insensitive search; a pattern that does not compile matches nothing."""
    if not pattern or not compiles(pattern):
        return F.lit(False)
    return text_of(title).rlike("(?i)" + pattern)


def exclude_reason(
    title: Column, description: Column, company: Column, location: Column, rules: P.ExcludeRules
) -> Column:
    def cascade(text: Column) -> Column:
        steps = [F.when(is_closed(description), F.lit("posting closed"))]
        if rules.phrases:
            hit = matched_phrase(text, rules.phrases, rules.case_sensitive)
            steps.append(F.concat(F.lit("matched phrase: '"), hit, F.lit("'")))
        steps.append(credential_block(text))
        if rules.max_years > 0:
            note = F.lit(f" years experience (max allowed: {rules.max_years})")
            steps.append(let(max_years(text), lambda y: _above(y, rules.max_years, note)))
        if rules.provinces:
            steps.append(let(extract_province(location), lambda p: _outside(p, rules.provinces)))
        if rules.companies:
            steps.append(
                F.when(
                    company_blocked(company, rules.companies),
                    F.concat(F.lit("blocked company: '"), text_of(company), F.lit("'")),
                )
            )
        if rules.title_pattern:
            steps.append(
                F.when(
                    title_matches(title, rules.title_pattern), F.lit("title matches exclude pattern")
                )
            )
        return F.coalesce(*steps)

    return let(title_and_text(title, description), cascade)


def _above(years: Column, limit: int, note: Column) -> Column:
    return F.when(years > limit, F.concat(F.lit("requires "), years.cast("string"), note))


def _outside(province: Column, allowed: Iterable[str]) -> Column:
    return F.when(
        ~province.isin(list(allowed)), F.concat(F.lit("out-of-province ("), province, F.lit(")"))
    )


def domain_gate(
    title: Column,
    description: Column,
    off_terms: Iterable[str] = P.OFF_DOMAIN_TERMS,
    on_terms: Iterable[str] = P.ON_DOMAIN_TERMS,
) -> Column:
    off, on = term_alternation(off_terms), term_alternation(on_terms)

    def gate(text: Column) -> Column:
        off_term = F.lower(F.regexp_extract(text, f"({off})", 1))
        found = let(
            off_term,
            lambda o: F.when(
                (o != "") & ~text_of(title).rlike(on),
                F.concat(F.lit("non-medical domain ('"), o, F.lit("')")),
            ),
        )
        return F.coalesce(found, F.when(~text.rlike(on), F.lit("no pre-med relevance signal")))

    return let(title_and_text(title, description), gate)


def unsuitable_reason(
    title: Column,
    description: Column,
    company: Column,
    location: Column,
    gate: str = "none",
    home_province: str = P.HOME_PROVINCE,
    max_experience: int = P.MAX_EXPERIENCE_YEARS,
) -> Column:
    low_title, low_text = F.lower(text_of(title)), F.lower(text_of(description))

    def titled(label: str, words: list[str]) -> Column:
        hit = let(low_title, lambda t: first_title_word(t, words))
        return F.concat(F.lit(f"{label} '"), hit, F.lit("'"))

    def cascade(combined: Column) -> Column:
        steps = [
            F.when(
                company_blocked(company, P.SPAM_COMPANIES),
                F.concat(F.lit("spam company '"), text_of(company), F.lit("'")),
            ),
            F.when(
                text_of(title).rlike(P.COURSE_CODE_PATTERN), F.lit("course-code teaching posting")
            ),
            titled("senior title", P.SENIOR_TITLE_WORDS),
            titled("regulated-profession title", P.REGULATED_TITLE_WORDS),
            titled("declined role type", P.DECLINED_TITLE_WORDS),
            F.when(
                text_of(title).rlike(P.GRADUATE_TITLE_PATTERN),
                F.lit("requires graduate/degree standing (title)"),
            ),
            F.when(
                contains_any(combined, P.LICENCE_PHRASES),
                F.lit("requires professional licence/credential"),
            ),
            let(extract_province(location), lambda p: _outside(p, [home_province])),
            let(
                max_years(combined, P.EXPERIENCE_YEARS_PATTERN),
                lambda y: _above(y, max_experience, F.lit(" yrs experience")),
            ),
            credential_block(combined),
        ]
        if gate != "none":
            steps.append(domain_gate(title, description))
        return F.coalesce(*steps)

    return let(F.concat(low_title, F.lit(" "), low_text), cascade)


def apply_method(source: Column, url: Column, description: Column) -> Column:
    """struct(method, target): contact address if any, else the channel of the source."""
    address = first_email(description)
    method = F.when(address.isNotNull(), F.lit("email"))
    for board in P.BOARD_SOURCES:
        method = method.when(source == board, F.lit(board))
    method = method.when(source.isin(P.PORTAL_SOURCES), F.lit("portal")).otherwise(F.lit("unknown"))
    return F.struct(method.alias("method"), F.coalesce(address, url).alias("target"))


def location_allowed(location: Column, words: Iterable[str] = P.REMOTE_LOCATION_WORDS) -> Column:
    return (text_of(location) == "") | contains_any(F.lower(text_of(location)), words)


def not_terminal(status: Column, terminal: Iterable[str] = P.TERMINAL_STATUSES) -> Column:
    return status.isNull() | ~status.isin(list(terminal))


def score_band(score: Column, threshold: float) -> Column:
    return (
        F.when(score.isNull(), F.lit("unscored"))
        .when(score < 0, F.lit("excluded"))
        .when(score >= threshold, F.lit("match"))
        .when(score >= threshold * 0.7, F.lit("near"))
        .otherwise(F.lit("low"))
    )


def combined_score(score: Column, suitability: Column) -> Column:
    base = F.coalesce(score, F.lit(0.0))
    return F.when(suitability.isNotNull(), base * 0.6 + suitability * 0.4).otherwise(base)


# -- state of a fetched page ----------------------------------------------------------


def _http(status: Column) -> Column:
    return F.concat(F.lit("HTTP "), status.cast("string"))


def response_state(
    source: Column,
    url: Column,
    status: Column,
    body: Column,
    page_text: Column,
    verifiable: Iterable[str] = P.VERIFIABLE_SOURCES,
    blocking: Iterable[str] = P.UNVERIFIABLE_SOURCES,
) -> Column:
    """struct(state, reason, full_text) of a re-fetched posting."""
    portal = source.endswith(P.PORTAL_SUFFIX)
    dead = let(F.lower(text_of(body)), lambda b: first_contained(b, P.DEAD_PHRASES))

    def out(state: str, reason: Column, text: Column | None = None) -> Column:
        text = F.lit(None).cast("string") if text is None else text
        return F.struct(F.lit(state).alias("state"), reason.alias("reason"), text.alias("full_text"))

    return (
        F.when(text_of(url) == "", out("unknown", F.lit("no url")))
        .when(
            source.isin(list(blocking)),
            out("unknown", F.concat(source, F.lit(" blocks verification"))),
        )
        .when(
            ~(source.isin(list(verifiable)) | portal),
            out("unknown", F.concat(source, F.lit(" not verifiable"))),
        )
        .when(status.isin(404, 410), out("dead", _http(status)))
        .when(portal, out("live", F.concat(_http(status), F.lit(" (icims)"))))
        .when(status == 403, out("unknown", F.lit("HTTP 403 (blocked)")))
        .when(status >= 400, out("unknown", _http(status)))
        .when(
            dead.isNotNull(), out("dead", F.concat(F.lit("dead phrase: '"), dead, F.lit("'")))
        )
        .otherwise(out("live", _http(status), page_text))
    )


def rendered_state(title: Column, apply_count: Column, expired_count: Column) -> Column:
    def out(state: str, reason: str) -> Column:
        return F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"))

    return (
        F.when(
            contains_any(F.lower(text_of(title)), P.CHALLENGE_TITLES),
            out("unknown", "cloudflare challenge"),
        )
        .when(expired_count > 0, out("dead", "expired banner"))
        .when(apply_count > 0, out("live", "apply button present"))
        .otherwise(out("unknown", "no apply button (indeterminate)"))
    )


def still_open(status: Column, body: Column) -> Column:
    """True, false or null (could not tell)."""
    return (
        F.when(status.isin(404, 410), F.lit(False))
        .when(status >= 400, F.lit(None).cast("boolean"))
        .otherwise(~is_closed(body))
    )
