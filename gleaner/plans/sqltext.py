"""SQL fragments shared by the oracle texts (DuckDB dialect, patterns free of look-behind)."""

from __future__ import annotations

from gleaner import params as P
from gleaner.plans.cases import first_in, has_any, sql_list, sql_text


def rx(pattern: str) -> str:
    return sql_text(pattern)


def norm(c: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), "
        "'\\s+', ' ', 'g'))"
    )


def content_hash(prefix: str = "") -> str:
    p = prefix
    return f"substring(sha256({norm(p + 'title')} || '|' || {norm(p + 'company')} || '|' || {norm(p + 'location')}), 1, 16)"


ID = "sha256(source || ':' || url)"

CREDENTIAL_RE2 = (
    r"(?i)(?:must (?:have|possess|hold)|requires?|required[:\s]|minimum of|completion of)"
    r"[\w\s,'/-]{0,40}?(?:designation|(?:college|university|post-?secondary)\s+diploma)"
    r"|(?:^|[^ ]|(?:^|[^o]) |(?:^|[^n])o )(?:degree|designation)\s+(?:is\s+)?(?:required|mandatory)"
    r"|eligibility for\s+[\w\s]{0,30}?(?:registration|certification|licen[cs]e)"
)


def credential(t: str) -> str:
    pieces = f"regexp_split_to_array({t}, {rx(P.NAMED_DEGREE_PATTERN)})"
    found = f"regexp_extract_all({t}, {rx(P.NAMED_DEGREE_PATTERN)})"
    # text before the i-th degree is everything up to it
    open_degree = (
        f"len(list_filter(range(1, len({found}) + 1), lambda i: NOT regexp_matches("
        f"right(array_to_string(list_transform(range(1, i + 1), lambda k: "
        f"CASE WHEN k > 1 THEN {found}[k - 1] ELSE '' END || {pieces}[k]), ''), 25), "
        f"{rx(P.IN_PROGRESS_PATTERN)}))) > 0"
    )
    return (
        f"CASE WHEN regexp_matches({t}, {rx(P.EDUCATION_YEARS_PATTERN)}) THEN {sql_text(P.REASON_EDUCATION)} "
        f"WHEN regexp_matches({t}, {rx(CREDENTIAL_RE2)}) THEN {sql_text(P.REASON_CREDENTIAL)} "
        f"WHEN regexp_matches({t}, {rx(P.NAMED_DEGREE_PATTERN)}) THEN CASE WHEN {open_degree} THEN {sql_text(P.REASON_DEGREE)} END END"
    )


def years(t: str, pattern: str = P.YEARS_PATTERN) -> str:
    return (
        f"list_max(list_transform(regexp_extract_all({t}, {rx(pattern)}, 1), "
        "lambda y: TRY_CAST(y AS BIGINT)))"
    )


def province(c: str) -> str:
    names = " ".join(
        f"WHEN contains(lower({c}), {sql_text(n)}) THEN '{code}'" for n, code in P.PROVINCES.items()
    )
    codes = sql_list(sorted(set(P.PROVINCES.values())))
    bracket = f"regexp_extract({c}, '\\(([A-Z]{{2}})\\)', 1)"
    comma = f"regexp_extract({c}, ',\\s*([A-Z]{{2}})\\b', 1)"
    return (
        f"CASE {names} WHEN list_contains({codes}, {bracket}) THEN {bracket} "
        f"WHEN list_contains({codes}, {comma}) THEN {comma} "
        f"WHEN regexp_matches({c}, '\\bON\\b') THEN 'ON' END"
    )


def closed(c: str) -> str:
    return has_any(f"lower({c})", P.CLOSED_PHRASES)


FULL = "(title || ' ' || description)"


def exclude_reason(rules: P.ExcludeRules) -> str:
    """Cascade for the given rules over posting columns."""
    y, prov = years(FULL), province("location")
    steps = [f"WHEN {closed('description')} THEN 'posting closed'"]
    if rules.phrases:
        hit = first_in(f"lower{FULL}", [p.lower() for p in rules.phrases])
        steps.append(f"WHEN {hit} IS NOT NULL THEN 'matched phrase: ''' || {hit} || ''''")
    cred = credential(FULL)
    steps.append(f"WHEN ({cred}) IS NOT NULL THEN {cred}")
    if rules.max_years:
        steps.append(
            f"WHEN {y} > {rules.max_years} THEN 'requires ' || {y} || ' years experience (max allowed: {rules.max_years})'"
        )
    if rules.provinces:
        steps.append(
            f"WHEN NOT list_contains({sql_list(rules.provinces)}, {prov}) THEN 'out-of-province (' || {prov} || ')'"
        )
    if rules.companies:
        steps.append(
            f"WHEN {has_any('lower(company)', [c.lower() for c in rules.companies])} THEN 'blocked company: ''' || company || ''''"
        )
    if rules.title_pattern:
        steps.append(
            f"WHEN regexp_matches(title, {rx('(?i)' + rules.title_pattern)}) THEN 'title matches exclude pattern'"
        )
    return "CASE " + " ".join(steps) + " END"


def _alternation(terms) -> str:
    return r"(?i)(?:^|[^a-z])(" + "|".join(t.replace(".", r"\.") for t in terms) + ")"


def domain_gate() -> str:
    off, on = rx(_alternation(P.OFF_DOMAIN_TERMS)), rx(_alternation(P.ON_DOMAIN_TERMS))
    term = f"lower(regexp_extract({FULL}, {off}, 1))"
    return (
        f"CASE WHEN {term} <> '' AND NOT regexp_matches(title, {on}) THEN 'non-medical domain (''' || {term} || ''')' "
        f"WHEN NOT regexp_matches({FULL}, {on}) THEN 'no pre-med relevance signal' END"
    )


def unsuitable(gate: str = "none") -> str:
    low, both = "lower(title)", f"lower{FULL}"
    prov, y = province("location"), years(both, P.EXPERIENCE_YEARS_PATTERN)

    def word(label: str, words) -> str:
        return " ".join(
            f"WHEN regexp_matches({low}, '(^|[^a-z]){w}($|[^a-z])') THEN {sql_text(label + ' ' + chr(39) + w + chr(39))}"
            for w in words
        )

    graduate = (
        r"(?i)(?:^|[^a-z])(?:ph\.?\s?d|doctoral|post-?doc|master'?s|m\.?sc|graduate student|bs/ms|ms/phd)(?:$|[^a-z])"
    )
    cred = credential(both)
    steps = [
        f"WHEN {has_any('lower(company)', P.SPAM_COMPANIES)} THEN 'spam company ''' || company || ''''",
        f"WHEN regexp_matches(title, {rx(P.COURSE_CODE_PATTERN)}) THEN 'course-code teaching posting'",
        word("senior title", P.SENIOR_TITLE_WORDS),
        word("regulated-profession title", P.REGULATED_TITLE_WORDS),
        word("declined role type", P.DECLINED_TITLE_WORDS),
        f"WHEN regexp_matches(title, {rx(graduate)}) THEN 'requires graduate/degree standing (title)'",
        f"WHEN {has_any(both, P.LICENCE_PHRASES)} THEN 'requires professional licence/credential'",
        f"WHEN {prov} <> 'ON' THEN 'out-of-province (' || {prov} || ')'",
        f"WHEN {y} > 2 THEN 'requires ' || {y} || ' yrs experience'",
        f"WHEN ({cred}) IS NOT NULL THEN {cred}",
    ]
    if gate != "none":
        g = domain_gate()
        steps.append(f"WHEN ({g}) IS NOT NULL THEN {g}")
    return "CASE " + " ".join(steps) + " END"


def _escaped(k: str) -> str:
    return "".join("\\" + c if c in r".+*?()[]{}^$|\\" else c for c in k)


def word_hit(hay: str, keyword: str) -> str:
    return f"regexp_matches({hay}, {rx(chr(92) + 'b' + _escaped(keyword.lower()) + chr(92) + 'b')})"


def skills(hay: str = "lower(title || ' ' || description || ' ' || company)") -> str:
    """Comma list of the first ten skills; aliases first."""
    pairs = [*P.SKILL_ALIASES.items(), *((s, s) for s in P.SKILLS)]
    cases = ", ".join(f"CASE WHEN {word_hit(hay, k)} THEN {sql_text(v)} END" for k, v in pairs)
    kept = f"list_filter([{cases}], lambda s: s IS NOT NULL)"
    # first occurrence of each skill, in order
    return (
        f"list_filter({kept}, lambda s, i: list_position({kept}, s) = i)"
    )


def keyword_hits(words, title_weight: float = 2.0) -> str:
    parts = [
        f"CASE WHEN {word_hit('lower(title)', k)} THEN {title_weight} WHEN {word_hit('lower(description)', k)} THEN 1.0 ELSE 0.0 END"
        for k in words
    ]
    return "CAST(" + (" + ".join(parts) or "0.0") + " AS DOUBLE)"


def number(c: str) -> str:
    """Cut number of a token made of digits, commas, dots and k."""
    bare = f"lower(replace({c}, ',', ''))"
    digits = f"regexp_replace({bare}, 'k$', '')"
    value = f"CASE WHEN regexp_matches({digits}, '^(\\d+\\.?\\d*|\\.\\d+)$') THEN TRY_CAST({digits} AS DOUBLE) END"
    return f"CAST(trunc(({value}) * CASE WHEN {bare} LIKE '%k' THEN 1000 ELSE 1 END) AS BIGINT)"


def numbers(c: str) -> str:
    return (
        f"list_filter(list_transform(regexp_extract_all({c}, {rx(P.NUMBER_PATTERN)}), lambda x: {number('x')}), "
        "lambda v: v IS NOT NULL)"
    )


def salary_bounds(table: str, columns: str = "*") -> str:
    """SELECT of a postings-like table with salary_min and salary_max from the description."""
    snip = f"regexp_extract(description, {rx(P.MONEY_PATTERN)})"
    return (
        f"SELECT t.*, lo * f AS salary_min, hi * f AS salary_max FROM (SELECT s.*, "
        "CASE WHEN len(nums) > 0 THEN least(nums[1], nums[-1]) END AS lo, "
        "CASE WHEN len(nums) > 0 THEN greatest(nums[1], nums[-1]) END AS hi, "
        f"CASE WHEN regexp_matches(win, {rx(P.HOURLY_NEARBY)}) OR regexp_matches(snip, {rx(P.HOURLY_IN_AMOUNT)}) "
        "OR least(nums[1], nums[-1]) < 1000 THEN 2080 ELSE 1 END AS f FROM "
        f"(SELECT a.*, {numbers('snip')} AS nums, substring(description, greatest(instr(description, snip) - 20, 1), "
        "instr(description, snip) - greatest(instr(description, snip) - 20, 1) + len(snip) + 20) AS win FROM "
        f"(SELECT {columns}, {snip} AS snip FROM {table}) a) s) t"
    )


def dollars(c: str) -> str:
    return f"coalesce('$' || format('{{:,}}', {c}), '?')"


def salary_cell(missing: str, dash: str) -> str:
    return (
        f"CASE WHEN salary_min IS NULL AND salary_max IS NULL THEN '{missing}' WHEN salary_min = salary_max THEN {dollars('salary_min')} "
        f"ELSE {dollars('salary_min')} || '{dash}' || {dollars('salary_max')} END"
    )


def deadline(c: str) -> str:
    month = (
        "CASE lower(substring({m}, 1, 3)) "
        + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.MONTH_NUMBER.items())
        + " END"
    )
    t = "(?i)" + P.DEADLINE_TRIGGER
    iso = t + r"(\d{4})-(\d{1,2})-(\d{1,2})"
    mf = t + rf"({P.MONTH_NAMES})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})"
    df = t + rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+({P.MONTH_NAMES})\.?,?\s+(\d{{4}})"
    sl = t + r"(\d{1,2})/(\d{1,2})/(\d{4})"

    def g(p: str, n: int) -> str:
        return f"regexp_extract({c}, {rx(p)}, {n})"

    def day(y: str, m: str, d: str) -> str:
        return f"TRY_CAST({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"

    return (
        f"CASE WHEN regexp_matches({c}, {rx(iso)}) THEN {day(g(iso, 1), g(iso, 2), g(iso, 3))} "
        f"WHEN regexp_matches({c}, {rx(mf)}) THEN {day(g(mf, 3), month.format(m=g(mf, 1)), g(mf, 2))} "
        f"WHEN regexp_matches({c}, {rx(df)}) THEN {day(g(df, 3), month.format(m=g(df, 2)), g(df, 1))} "
        f"WHEN regexp_matches({c}, {rx(sl)}) THEN {day(g(sl, 3), g(sl, 2), g(sl, 1))} END"
    )


def email(c: str) -> str:
    blocked = " AND ".join(f"NOT contains(a, {sql_text(b)})" for b in P.BLOCKED_ADDRESS_PARTS)
    found = f"list_transform(regexp_extract_all({c}, {rx(P.EMAIL_PATTERN)}), lambda x: lower(x))"
    return f"list_filter({found}, lambda a: {blocked})[1]"


# The references that the given pages hold, written for this check alone.
PAGE_REFERENCES = {"&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def main_text(c: str, tags=tuple(P.DROPPED_TAGS)) -> str:
    for tag in tags:
        c = f"regexp_replace({c}, '(?is)<{tag}\\b.*?(?:</{tag}\\s*>|\\z)', ' ', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for entity, sign in PAGE_REFERENCES.items():
        c = f"replace({c}, {sql_text(entity)}, {sql_text(sign)})"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def search_url(c: str, strip) -> str:
    """Drop named query parameters (no repeated keys, every parameter has a value)."""
    frag = f"regexp_extract({c}, '(#.+)$', 1)"
    bare = f"regexp_replace({c}, '#.*$', '')"
    base = f"regexp_replace({bare}, '\\?.*$', '')"
    query = f"regexp_extract({bare}, '\\?(.*)$', 1)"
    keep = (
        f"array_to_string(list_filter(string_split({query}, '&'), lambda p: p <> '' AND NOT list_contains({sql_list(strip)}, "
        "lower(regexp_extract(p, '^([^=]*)', 1)))), '&')"
    )
    return f"{base} || CASE WHEN {keep} <> '' THEN '?' || {keep} ELSE '' END || {frag}"


def tfidf(docs: str, queries: str) -> str:
    """CTEs ending in tfidf(q, k, score): pairs that share a term, by the plain definition.

    ``docs`` selects (k, t), ``queries`` selects (q, t).
    """
    words = (
        f"list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({sql_list(P.STOP_WORDS)}, w))"
    )
    grams = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
 d_tok AS (SELECT k, {words} AS w FROM ({docs})),
 q_tok AS (SELECT q, {words} AS w FROM ({queries})),
 d_tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest({grams}) AS term FROM d_tok) GROUP BY ALL),
 q_tf AS (SELECT q, term, count(*) AS tf FROM (SELECT q, unnest({grams}) AS term FROM q_tok) GROUP BY ALL),
 size AS (SELECT count(*) AS n FROM d_tok WHERE len(w) > 0),
 freq AS (SELECT term, count(*) AS df FROM d_tf GROUP BY term),
 q_w AS (SELECT q, term, (1 + ln(tf)) * (ln((2 + n) / (2.0 + coalesce(df, 0))) + 1) AS w FROM q_tf LEFT JOIN freq USING (term), size),
 q_len AS (SELECT q, sqrt(sum(w * w)) AS len FROM q_w GROUP BY q),
 d_w AS (SELECT ql.q, d.k, d.term, (1 + ln(d.tf)) * (ln((2 + n) / (1.0 + df + CASE WHEN qw.term IS NULL THEN 0 ELSE 1 END)) + 1) AS w, qw.w AS qw
   FROM q_len ql CROSS JOIN d_tf d JOIN freq USING (term) CROSS JOIN size LEFT JOIN q_w qw ON qw.q = ql.q AND qw.term = d.term),
 tfidf AS (SELECT q, k, sum(w * qw) / (sqrt(sum(w * w)) * any_value(len)) AS score FROM d_w JOIN q_len USING (q) GROUP BY q, k HAVING count(qw) > 0)
"""
