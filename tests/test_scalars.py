"""Scalar extraction and rules on hand-made cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from gleaner import params as P
from gleaner.functions import answers as A
from gleaner.functions import dates as D
from gleaner.functions import money as M
from gleaner.functions import rules as R
from gleaner.functions import text as X

C = F.col("s")


@pytest.mark.parametrize(
    "text,expected",
    [
        ("$50,000 - $60,000 a year", (50000, 60000)),
        ("Pay: $25/hr", (52000, 52000)),
        ("CA$50k to $60k", (50000, 60000)),
        ("$25", (52000, 52000)),
        ("$80,000", (80000, 80000)),
        ("$60,000 – $50,000", (50000, 60000)),
        ("hourly wage of $1,200 for all", (2496000, 2496000)),
        ("no money here", (None, None)),
        ("", (None, None)),
    ],
)
def test_salary_from_text(one, text, expected):
    assert tuple(one(M.salary_from_text(C), s=text)) == expected


@pytest.mark.parametrize(
    "text,expected",
    [
        ("$50k", (50000, 50000, "USD", False)),
        ("C$20 - C$25 per hour", (20, 25, "CAD", True)),
        ("£1,000.99", (1000, 1000, "GBP", False)),
        (",", (None, None, "USD", False)),
        ("€30 to 10 hr", (10, 30, "EUR", True)),
    ],
)
def test_parse_salary(one, text, expected):
    assert tuple(one(M.parse_salary(C), s=text)) == expected


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Apply by 2026-01-15.", date(2026, 1, 15)),
        ("Deadline: January 5th, 2026", date(2026, 1, 5)),
        ("closing date 15 Sept. 2026", date(2026, 9, 15)),
        ("Applications close on 31/12/2026", date(2026, 12, 31)),
        ("apply by 2026-02-30, deadline: May 1, 2026", None),
        ("May 1, 2026 is a day", None),
        ("due by: 1 may 2026 ... apply by 2026-03-04", date(2026, 3, 4)),
    ],
)
def test_deadline(one, text, expected):
    assert one(D.extract_deadline(C), s=text) == expected


@pytest.mark.parametrize(
    "text,expected",
    [
        ("minimum of three (3) years of college education", P.REASON_EDUCATION),
        ("A degree is required", P.REASON_CREDENTIAL),
        ("There is no degree required", None),
        ("high school diploma", None),
        ("pursuing a bachelor's degree", None),
        ("pursuing a bachelor's degree, or holding a master's degree", P.REASON_DEGREE),
        ("bachelor degree, pursuing a master degree", P.REASON_DEGREE),
        # the second degree stands 25 characters after the first, which is still in its context
        ("enrolled in a md degree, md degree", None),
        ("", None),
    ],
)
def test_credential_block(one, text, expected):
    assert one(R.credential_block(C), s=text) == expected


def test_credential_context_matches_brute_force(spark):
    import re

    def plain(text):
        if re.search(P.EDUCATION_YEARS_PATTERN, text):
            return P.REASON_EDUCATION
        if re.search(P.CREDENTIAL_PATTERN, text):
            return P.REASON_CREDENTIAL
        for m in re.finditer(P.NAMED_DEGREE_PATTERN, text):
            if not re.search(P.IN_PROGRESS_PATTERN, text[max(0, m.start() - 25) : m.start()]):
                return P.REASON_DEGREE
        return None

    words = ["enrolled ", "md degree ", "m.d. degree", " ", "x" * 12, "studying ", "phd degree "]
    texts = [
        "".join(words[i // len(words) ** k % len(words)] for k in range(4))
        for i in range(len(words) ** 4)
    ]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = df.select("s", R.credential_block(C).alias("r")).collect()
    assert [r["r"] for r in got] == [plain(r["s"]) for r in got]


@pytest.mark.parametrize(
    "place,expected",
    [
        ("Kitchener, Ontario", "ON"),
        ("Flin Flon (MB)", "MB"),
        ("Guelph, ON, CA, N1G 2W1", "ON"),
        ("Guelph ON N1G", "ON"),
        ("Québec city", "QC"),
        ("Paris (FR)", None),
        ("LONDON", None),
        ("", None),
    ],
)
def test_province(one, place, expected):
    assert one(R.extract_province(C), s=place) == expected


def test_exclusion_order_and_reasons(one):
    rules = P.ExcludeRules(phrases=["Night Shift"], companies=["acme"])

    def reason(title="Clerk", text="", company="Shop", place="Guelph, ON"):
        cols = [F.col(x) for x in ("t", "d", "c", "l")]
        return one(R.exclude_reason(*cols, rules), t=title, d=text, c=company, l=place)

    assert reason(text="This position has been filled. night shift") == "posting closed"
    assert reason(text="A night shift") == "matched phrase: 'Night Shift'"
    assert reason(text="3 years and 10+ yrs") == "requires 10 years experience (max allowed: 2)"
    assert reason(place="Calgary, AB") == "out-of-province (AB)"
    assert reason(company="ACME Ltd") == "blocked company: 'ACME Ltd'"
    assert reason(title="CH250 (C): Lab") == "title matches exclude pattern"
    assert reason(place="Somewhere") is None


def test_suitability_words(one):
    def reason(title, text="", gate="none"):
        cols = [F.col(x) for x in ("t", "d", "c", "l")]
        return one(R.unsuitable_reason(*cols, gate), t=title, d=text, c="Shop", l="Guelph, ON")

    assert reason("Team Lead") == "senior title 'lead'"
    assert reason("Leader of games") is None
    assert reason("Pharmacy Technician") == "regulated-profession title 'pharmacy technician'"
    assert reason("French Teacher") == "declined role type 'teacher'"
    assert reason("Student, PhD") == "requires graduate/degree standing (title)"
    assert reason("Helper", "must be certified") == "requires professional licence/credential"
    assert reason("Helper", "4 years of relevant experience") == "requires 4 yrs experience"
    assert reason("Helper", "nice", "domain") == "no pre-med relevance signal"
    assert reason("Welding helper", "", "domain") == "non-medical domain ('welding')"
    assert reason("Hospital welding helper", "", "domain") is None


def test_skills_order_and_limit(one):
    s = X.skills(F.col("t"), F.col("d"), F.lit(""))
    assert one(s, t="JS dev", d="Python, node and k8s; c++ dev") == ["JavaScript", "Kubernetes", "Node.js", "Python"]
    assert one(s, t="collaborate", d="goal restful") == []
    assert len(one(s, t="", d=" ".join(P.SKILLS))) > 10
    assert len(one(X.skills(F.col("t"), F.col("d"), F.lit(""), limit=10), t="", d=" ".join(P.SKILLS))) == 10


def test_page_text_decodes_and_drops(one):
    page = "<p>d&eacute;j&agrave;&nbsp;vu &#8211; it&rsquo;s &hellip; &amp;amp;</p><script>let x = 1"
    assert one(X.main_text(C), s=page) == "déjà vu – it’s … &amp;"
    assert len(one(X.main_text(C), s="<p>" + "word " * 5000)) == 24_999


def test_references_without_semicolon_stay(one):
    page = "<h1>a &amp b &ampfoo; &#38 &copy=1</h1><p>x&amp;&amp;&#38;&lt;&amp</p>"
    assert one(X.main_text(C), s=page) == "a &amp b &ampfoo; &#38 &copy=1 x&&&<&amp"


def test_amounts_beyond_a_long_are_null(one):
    pay = one(M.salary_from_text(C), s="$9,000,000,000,000,000,000/hr")
    assert pay["min"] is None and pay["max"] is None


def test_patterns_are_checked_by_java(one):
    from gleaner.functions.rules import title_matches

    assert one(title_matches(C, "(?P<x>senior)"), s="senior") is False
    assert one(title_matches(C, "(?<x>senior)"), s="Senior clerk") is True
    assert one(title_matches(C, "("), s="(") is False


@pytest.mark.parametrize(
    "url,board,search",
    [
        ("https://a.org/p/1;jsessionid=AB.c?source=x&id=2", "https://a.org/p/1?id=2", None),
        ("https://a.org/p?b=1&a=2&b=3#f", "https://a.org/p?b=1&b=3&a=2#f", None),
        ("https://a.org/p?UTM_Source=q&se=1&flag", None, "https://a.org/p?flag="),
        ("https://a.org/p?q=a%20b~*", "https://a.org/p?q=a+b~%2A", None),
        ("https://a.org/p?source=x", "https://a.org/p", None),
    ],
)
def test_urls(one, url, board, search):
    if board:
        once = one(X.canonical_board_url(C), s=url)
        assert once == board and one(X.canonical_board_url(C), s=once) == board
    if search:
        assert one(X.canonical_search_url(C), s=url) == search


def test_view_url(one):
    f = X.canonical_view_url(C)
    assert one(f, s="https://x.org/jobs/view/dev-at-acme-123/?ref=1") == P.VIEW_URL_PREFIX + "123/"
    assert one(f, s="https://x.org/jobs/") == "https://x.org/jobs/"


def test_identity(one):
    h = X.content_hash(F.col("a"), F.col("b"), F.col("c"))
    assert one(h, a=" Lab  Tech! ", b="ACME, Inc.", c="Guelph") == one(h, a="lab tech", b="acme inc", c="guelph")
    assert one(X.normalize_key(C), s="Québec – LAB_1 ") == "québec lab_1"


def test_small_text_helpers(one):
    assert one(X.first_email(C), s="noreply@a.org then HR@Firm.com") == "hr@firm.com"
    assert one(X.first_name_line(C), s="\n  Robin Doe \nx") == "Robin Doe"
    assert one(X.first_name_line(C), s="robin@x.org is mail") == P.DEFAULT_NAME
    assert one(X.ascii_fold(C), s="“a” – b… Ω") == '"a" - b... ?'
    assert one(X.main_text(C), s="<nav>x</nav><p>a &amp;<br> b</p><script>1</script>") == "a & b"
    assert one(D.date_cell(C), s="2026-01-05T10:00:00Z") == "2026-01-05"
    assert one(D.date_cell(C), s="Posted 3 Days Ago") == "Posted 3 D"
    # values that look like placeholders are not filled again
    assert one(X.fill(F.lit("{title} at {company}"), {"title": C, "company": F.lit("Y")}), s="{company}") == "{company} at Y"


def test_claims(one):
    from gleaner.operators.documents import claim_warnings

    letter = "I have 3 years of lab experience, lab skills and retail work."
    w = one(claim_warnings(C, F.lit("retail job"), ["skills"]), s=letter)
    assert w == [
        "claims specific years of professional/lab experience",
        "claims lab experience/background (not in resume)",
        "forbidden phrase in config: 'skills'",
    ]


def test_verdict_answer(one):
    f = A.parse_verdict(C)
    v = one(f, s='x {"suitability": 3, "reason": 5, "qualified": "Yes ", "unmet": ["a", ""]} y')
    assert (v["score"], v["reason"], v["verdict"], v["unmet"]) == (1.0, "5", "yes", ["a"])
    v = one(f, s='{"qualified": "perhaps", "unmet": "none"}')
    assert (v["score"], v["verdict"], v["unmet"]) == (0.5, None, [])
    assert one(f, s="nothing") is None


def test_gap_answer(one):
    raw = 'ok {"requirements":[{"requirement":"R1","status":"COVERED","covered_by":"a"},{"requirement":"R2","status":"odd"}],"ats_keywords":[{"keyword":"sql","present":true}]} end'
    assert one(A.summary_line(A.parse_gap(C)), s=raw) == "✓ R1 · gap: R2 · ATS 1/1"
    assert one(A.covered_item_ids(A.parse_gap(C)), s=raw) == ["a"]
    assert one(A.parse_gap(C), s="} {") is None


def test_notification(one):
    from gleaner.operators.reports import notification

    n = one(notification(C, F.lit(""), F.lit("Guelph"), F.lit("u" * 300), F.lit(0.215)), s="T" * 80)
    assert len(n["title"]) == 63 and n["title"].endswith("… (22%)")
    assert n["body"].startswith("Unknown — Guelph\n" + "u" * 80) and len(n["body"]) < 255
