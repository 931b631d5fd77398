"""Column functions over the JSON answers of outside models, and over the gap reports in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import params as P
from gleaner.functions.text import strip, text_of

VERDICT_SCHEMA = "suitability variant, reason variant, qualified variant, unmet variant"
GAP_SCHEMA = (
    "requirements array<struct<requirement:string,status:string,covered_by:string>>,"
    "ats_keywords array<struct<keyword:string,present:boolean,where:string>>,"
    "strengths array<string>, gaps array<string>"
)
PROFILE_SCHEMA = (
    "name string, education string, skills array<string>, certifications array<string>,"
    "languages array<string>, experience_level string, experience_summary string,"
    "target_roles array<string>, avoid_roles array<string>"
)


def _variant_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def parse_verdict(raw: Column) -> Column:
    """struct(score, reason, verdict, unmet) from the first flat {...} block; null without one."""
    block = F.regexp_extract(text_of(raw), r"(?s)(\{[^}]+\})", 1)
    j = F.from_json(block, VERDICT_SCHEMA)
    score = F.coalesce(F.try_variant_get(j["suitability"], "$", "double"), F.lit(0.5))
    verdict = F.lower(strip(_variant_text(j["qualified"])))
    items = F.coalesce(
        F.try_variant_get(j["unmet"], "$", "array<string>"), F.array().cast("array<string>")
    )
    return F.when(
        F.try_parse_json(block).isNotNull() & (block != ""),
        F.struct(
            F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"),
            F.coalesce(_variant_text(j["reason"]), F.lit("")).alias("reason"),
            F.when(verdict.isin(P.VERDICTS), verdict).alias("verdict"),
            F.filter(items, lambda u: strip(u) != "").alias("unmet"),
        ),
    )


def parse_gap(raw: Column) -> Column:
    """Gap report from the text between the first '{' and the last '}'; null when not JSON."""
    block = F.regexp_extract(text_of(raw), r"(?s)(\{.*\})", 1)
    j = F.from_json(block, GAP_SCHEMA)

    def known(status: Column) -> Column:
        low = F.lower(status)
        return F.when(low.isin(P.GAP_STATUSES), low).otherwise(F.lit("missing"))

    def some(c: Column, kind: str) -> Column:
        return F.coalesce(c, F.array().cast(kind))

    reqs = F.transform(
        F.filter(
            some(j["requirements"], "array<struct<requirement:string,status:string,covered_by:string>>"),
            lambda r: strip(text_of(r["requirement"])) != "",
        ),
        lambda r: F.struct(
            r["requirement"].alias("requirement"),
            known(r["status"]).alias("status"),
            text_of(r["covered_by"]).alias("covered_by"),
        ),
    )
    kws = F.transform(
        F.filter(
            some(j["ats_keywords"], "array<struct<keyword:string,present:boolean,where:string>>"),
            lambda k: strip(text_of(k["keyword"])) != "",
        ),
        lambda k: F.struct(
            k["keyword"].alias("keyword"),
            F.coalesce(k["present"], F.lit(False)).alias("present"),
            text_of(k["where"]).alias("where"),
        ),
    )

    def lines(c: Column) -> Column:
        return F.filter(some(c, "array<string>"), lambda s: strip(text_of(s)) != "")

    return F.when(
        F.try_parse_json(block).isNotNull() & (block != ""),
        F.struct(
            reqs.alias("requirements"),
            kws.alias("ats_keywords"),
            lines(j["strengths"]).alias("strengths"),
            lines(j["gaps"]).alias("gaps"),
        ),
    )


def covered_item_ids(report: Column) -> Column:
    cited = F.filter(
        report["requirements"],
        lambda r: r["status"].isin("covered", "partial") & (r["covered_by"] != ""),
    )
    return F.array_distinct(F.transform(cited, lambda r: r["covered_by"]))


def status_count(report: Column, status: str) -> Column:
    return F.size(F.filter(report["requirements"], lambda r: r["status"] == status)).cast("bigint")


def keywords_present(report: Column) -> Column:
    return F.size(F.filter(report["ats_keywords"], lambda k: k["present"])).cast("bigint")


def keywords_total(report: Column) -> Column:
    return F.size(report["ats_keywords"]).cast("bigint")


def summary_line(report: Column, max_each: int = 2) -> Column:
    def by_status(status: str) -> Column:
        return F.transform(
            F.filter(report["requirements"], lambda r: r["status"] == status),
            lambda r: r["requirement"],
        )

    def part(label: str, own: Column, fallback: Column) -> Column:
        chosen = F.when(F.size(own) > 0, own).otherwise(fallback)
        text = F.concat(F.lit(label), F.array_join(F.slice(chosen, 1, max_each), "; "))
        return F.when(F.size(chosen) > 0, text)

    total = keywords_total(report)
    ats = F.concat(
        F.lit("ATS "), keywords_present(report).cast("string"), F.lit("/"), total.cast("string")
    )
    line = F.concat_ws(
        " · ",
        part("✓ ", report["strengths"], by_status("covered")),
        part("gap: ", report["gaps"], by_status("missing")),
        F.when(total > 0, ats),
    )
    return F.when(line != "", line).otherwise(F.lit("no analysis"))


def parse_profile(raw: Column) -> Column:
    """Profile struct from JSON, with or without a code fence; absent fields take defaults."""
    body = strip(F.regexp_replace(strip(text_of(raw)), r"^`+(?:json)?|`+$", ""))
    j = F.from_json(body, PROFILE_SCHEMA)

    def word(name: str, default: str = "") -> Column:
        return F.coalesce(j[name], F.lit(default)).alias(name)

    def words(name: str) -> Column:
        return F.coalesce(j[name], F.array().cast("array<string>")).alias(name)

    return F.when(
        F.try_parse_json(body).isNotNull(),
        F.struct(
            word("name"),
            word("education"),
            words("skills"),
            words("certifications"),
            words("languages"),
            word("experience_level", "entry-level"),
            word("experience_summary"),
            words("target_roles"),
            words("avoid_roles"),
        ),
    )


def profile_text(p: Column) -> Column:
    def row(label: str, c: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), c)

    def joined(name: str) -> Column:
        return F.array_join(p[name], ", ")

    return F.concat_ws(
        "\n",
        row("Name", p["name"]),
        row("Education", p["education"]),
        row("Experience level", p["experience_level"]),
        row("Experience", p["experience_summary"]),
        row("Skills", joined("skills")),
        row("Certifications", joined("certifications")),
        row("Languages", joined("languages")),
        row("Suited for", joined("target_roles")),
        row("Not suited for", joined("avoid_roles")),
    )
