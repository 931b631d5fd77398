"""Per-record documents: item selection, letters, résumés, questions, prompts, claim checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import params as P
from gleaner.functions import text as X
from gleaner.operators.keyed import anti_join


@dataclass(frozen=True)
class Item:
    """One entry of a master résumé."""

    id: str
    section: str
    title: str
    sub: str = ""
    bullets: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    core: bool = False


ITEM_TYPE = (
    "struct<pos:int,id:string,section:string,title:string,sub:string,"
    "bullets:array<string>,tags:array<string>,core:boolean>"
)


def items_literal(items: Sequence[Item]) -> Column:
    """A master résumé describes one person, so it travels as a literal inside the plan."""
    rows = [
        F.struct(
            F.lit(pos).alias("pos"),
            F.lit(i.id).alias("id"),
            F.lit(i.section).alias("section"),
            F.lit(i.title).alias("title"),
            F.lit(i.sub).alias("sub"),
            X.string_array(i.bullets).alias("bullets"),
            X.string_array(i.tags).alias("tags"),
            F.lit(i.core).alias("core"),
        )
        for pos, i in enumerate(items, 1)
    ]
    return F.array(*rows).cast(f"array<{ITEM_TYPE}>")


# -- master résumé tables ---------------------------------------------------------------


def validate_items(items: DataFrame) -> DataFrame:
    """One row per violation: item position and what is wrong; duplicate ids once per id."""
    blank_tags = F.size(F.filter("tags", lambda t: F.trim(t) != "")) == 0
    checks = F.array_compact(
        F.array(
            F.when(F.trim("id") == "", F.lit("blank id")),
            F.when(F.trim("title") == "", F.lit("blank title")),
            F.when(~F.col("section").isin(list(P.SECTION_TITLES)), F.lit("unknown section")),
            F.when(blank_tags, F.lit("no tag")),
        )
    )
    rows = items.select(F.col("pos").cast("string").alias("subject"), F.explode(checks).alias("violation"))
    doubles = (
        items.groupBy("id")
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > 1)
        .select(F.col("id").alias("subject"), F.lit("duplicate id").alias("violation"))
    )
    return rows.unionByName(doubles)


def items_for_tags(items: DataFrame, tags: Sequence[str]) -> DataFrame:
    return items.where(F.arrays_overlap("tags", X.string_array(tags)))


def core_items(items: DataFrame) -> DataFrame:
    return items.where("core")


def summary_for(summaries: Column, profile: str) -> Column:
    def get(name: str) -> Column:
        return F.when(F.try_element_at(summaries, F.lit(name)) != "", F.try_element_at(summaries, F.lit(name)))

    return F.coalesce(get(profile), get("general"), F.lit(""))


def item_text(title: Column, sub: Column, bullets: Column) -> Column:
    parts = F.concat(F.array(title, sub), bullets)
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


def item_line(item_id: Column, section: Column, title: Column, sub: Column, bullets: Column) -> Column:
    return F.concat(
        F.lit("["), item_id, F.lit("] ("), section, F.lit(") "), title,
        F.when(sub != "", F.concat(F.lit(" ("), sub, F.lit(")"))).otherwise(F.lit("")),
        F.when(F.size(bullets) > 0, F.concat(F.lit(" — "), F.array_join(bullets, " "))).otherwise(F.lit("")),
    )


# -- weights and selection --------------------------------------------------------------


def weights_of(profile: str, overlay: Mapping[str, Mapping[str, float]] | None = None) -> dict[str, float]:
    """Tag weights of a profile; an overlay replaces or adds single tags."""
    base = P.TAG_WEIGHTS.get(profile, P.TAG_WEIGHTS["general"])
    return {**base, **((overlay or {}).get(profile, {}))}


def _profile_table(items: Sequence[Item], overlay: Mapping[str, Mapping[str, float]] | None) -> Column:
    """map(profile -> one entry per item): weight without bonus, drop flag, place of its section.

    All of it is known when the plan is made, so a row only looks its profile up.
    """
    def entry(profile: str, item: Item) -> Column:
        weights = weights_of(profile, overlay)
        sections = P.SECTION_ORDER[profile]
        place = sections.index(item.section) + 1 if item.section in sections else None
        return F.struct(
            F.lit(float(sum(weights.get(t, 0.0) for t in item.tags))).alias("weight"),
            F.lit(bool(set(item.tags) & set(P.DROP_TAGS[profile]))).alias("dropped"),
            F.lit(place).cast("int").alias("place"),
        )

    pairs = []
    for profile in P.DOCUMENT_PROFILES:
        pairs += [F.lit(profile), F.array(*[entry(profile, i) for i in items])]
    return F.create_map(*pairs)


def weigh_items(
    df: DataFrame,
    items: Sequence[Item],
    overlay: Mapping[str, Mapping[str, float]] | None = None,
    profile: str = "profile",
    covered: str = "covered",
) -> DataFrame:
    """Adds ``weighed``: every item with its weight for the row's profile, in the row itself."""
    def weigh(item: Column, e: Column) -> Column:
        bonus = F.when(F.array_contains(F.col(covered), item["id"]), P.COVERED_BONUS).otherwise(0.0)
        return F.struct(
            (e["weight"] + bonus).alias("weight"),
            e["dropped"].alias("dropped"),
            e["place"].alias("place"),
            item.alias("item"),
        )

    entries = F.try_element_at(_profile_table(items, overlay), F.col(profile))
    return df.withColumn("weighed", F.zip_with(items_literal(items), entries, weigh))


def select_items(df: DataFrame, max_bullets: int | None = None, max_other: int | None = None) -> DataFrame:
    """Adds ``chosen``: the items to print, in print order, from ``weighed``.

    Core items always stay; others need a positive weight and no dropped tag, and the best
    ``max_other`` stay, or all. Order: section order of the profile, weight, position.
    """
    def ordered(c: Column, by_place: bool) -> Column:
        place = (lambda e: e["place"]) if by_place else (lambda e: F.lit(0))
        keyed = F.transform(
            c,
            lambda e: F.struct(
                place(e).alias("s"), (-e["weight"]).alias("w"), e["item"]["pos"].alias("p"), e.alias("e")
            ),
        )
        return F.transform(F.array_sort(keyed), lambda k: k["e"])

    eligible = F.filter(
        "weighed", lambda e: ~e["item"]["core"] & (e["weight"] > 0) & ~e["dropped"]
    )
    others = ordered(eligible, False)
    others = F.slice(others, 1, max_other) if max_other else others
    core = F.filter("weighed", lambda e: e["item"]["core"])
    printed = F.filter(F.concat(core, others), lambda e: e["place"].isNotNull())
    chosen = F.transform(
        ordered(printed, True),
        lambda e: F.struct(
            e["weight"].alias("weight"),
            (
                e["item"].withField("bullets", F.slice(e["item"]["bullets"], 1, max_bullets))
                if max_bullets
                else e["item"]
            ).alias("item"),
        ),
    )
    return df.withColumn("chosen", chosen)


def render_resume(name: str, contact: str, profile: Column, summary: Column, chosen: Column) -> Column:
    """Markdown of a tailored résumé."""
    titles = F.create_map(*[F.lit(x) for kv in P.SECTION_TITLES.items() for x in kv])

    def block(e: Column, i: Column) -> Column:
        item = e["item"]
        before = F.when(i > 0, F.get(chosen, i - 1)["item"]["section"])
        head = F.when(before.isNull() | (before != item["section"]), F.concat(F.lit("## "), titles[item["section"]]))
        line = F.concat(
            F.lit("**"), item["title"], F.lit("**"),
            F.when(item["sub"] != "", F.concat(F.lit(" — "), item["sub"])).otherwise(F.lit("")),
        )
        bullets = F.transform(item["bullets"], lambda b: F.concat(F.lit("- "), b))
        return F.concat_ws("\n", head, line, F.concat(bullets, X.string_array([""])))

    head = F.concat(
        F.lit(f"# {name}\n{contact}\n\n_Profile: "), profile, F.lit("_\n\n"),
        F.when(summary != "", F.concat(summary, F.lit("\n\n"))).otherwise(F.lit("")),
    )
    body = F.array_join(F.transform(chosen, block), "\n")
    return F.concat(F.rtrim(F.regexp_replace(F.concat(head, body), r"\s+$", "")), F.lit("\n"))


def untraceable_count(chosen: Column, items: Sequence[Item]) -> Column:
    """Lines of the chosen items that no master item has, white space and case aside."""
    exact = {x for i in items for x in (i.title, i.sub, *i.bullets) if x}
    master = {" ".join(x.lower().split()) for x in exact}
    lines = F.flatten(
        F.transform(chosen, lambda e: F.concat(F.array(e["item"]["title"], e["item"]["sub"]), e["item"]["bullets"]))
    )
    # most lines are unchanged, so few are folded
    off = F.filter(lines, lambda x: (x != "") & ~(x.isin(sorted(exact)) | X.fold_space(x).isin(sorted(master))))
    return F.size(off).cast("bigint")


def tailored_resumes(
    df: DataFrame, items: Sequence[Item], name: str, contact: str, summaries: Mapping[str, str], profile: str = "profile"
) -> DataFrame:
    """Adds ``resume`` from ``chosen``; a row with a line that no master item has is rejected."""
    known = F.create_map(*[F.lit(x) for kv in summaries.items() for x in kv])
    summary = F.coalesce(F.try_element_at(known, F.col(profile)), summary_for(known, "general"))
    counted = df.select("*", X.once(untraceable_count(F.col("chosen"), items).alias("_off"), F.col("chosen").alias("_chosen")))
    good = counted.where(F.col("_once._off") == 0).withColumn("chosen", F.col("_once._chosen")).drop("_once")
    return good.withColumn("resume", render_resume(name, contact, F.col(profile), summary, F.col("chosen")))


def anti_untraceable(lines: DataFrame, master: DataFrame, line: str = "line") -> DataFrame:
    """Lines that do not occur among the master lines, white space and case aside."""
    key = "_line"
    own = lines.withColumn(key, X.fold_space(F.col(line)))
    known = master.select(X.fold_space(F.col(line)).alias(key))
    return anti_join(own, known, key).drop(key)


# -- letters ----------------------------------------------------------------------------


def claim_warnings(
    letter: Column,
    reference: Column,
    forbidden: Sequence[str] = (),
    rules: Sequence[tuple[str, str, str | None]] = tuple(P.CLAIM_RULES),
) -> Column:
    """Warnings in rule order: claims the reference text does not back, then forbidden phrases."""
    low_ref, low_letter = F.lower(reference), F.lower(letter)
    hits = []
    for pattern, warning, word in rules:
        found = letter.rlike("(?i)" + pattern)
        if word is not None:
            found &= ~F.contains(low_ref, F.lit(word))
        hits.append(F.when(found, F.lit(warning)))
    for phrase in forbidden:
        if phrase.strip():
            hits.append(
                F.when(
                    F.contains(low_letter, F.lit(phrase.lower())),
                    F.lit(f"forbidden phrase in config: '{phrase}'"),
                )
            )
    return F.array_compact(F.array(*hits))


def pick_template(title: Column) -> Column:
    low = F.lower(X.text_of(title))
    out = F.lit(P.LETTER_FALLBACK)
    for words, body in reversed(list(zip(P.LETTER_KEYWORDS, P.LETTER_BODIES, strict=True))):
        out = F.when(X.contains_any(low, words), F.lit(body)).otherwise(out)
    return out


def letter_body(title: Column, company: Column, description: Column, name: Column, profile: str = P.DEFAULT_PROFILE_LINE) -> Column:
    def or_else(c: Column, default: str) -> Column:
        return F.coalesce(X.blank_to_null(F.trim(X.text_of(c))), F.lit(default))

    return X.fill(
        pick_template(title),
        {
            "title": or_else(title, "this role"),
            "company": or_else(company, "your organization"),
            "profile": F.lit(profile),
            "keywords": X.keyword_phrases(title, description),
            "name": name,
        },
    )


def document_header(kind: str, title: Column, company: Column, location: Column, source: Column, url: Column, stamp: str, note: str = "") -> Column:
    return F.concat(
        F.lit(f"# {kind} — "), title,
        F.lit("\n\n- **Company:** "), X.text_of(company),
        F.lit("\n- **Location:** "), X.text_of(location),
        F.lit("\n- **Source:** "), source,
        F.lit("\n- **URL:** "), url,
        F.lit(f"\n- **Generated:** {stamp}{note}\n\n---\n\n"),
    )


def letters(df: DataFrame, name: str, reference: str, stamp: str, forbidden: Sequence[str] = ()) -> DataFrame:
    """Adds letter and warnings: templated letter with header, and its claim check."""
    c = F.col
    staged = df.withColumn("_body", letter_body(c("title"), c("company"), c("description"), F.lit(name)))
    head = document_header("Cover Letter", c("title"), c("company"), c("location"), c("source"), c("url"), stamp, " (backend: template)")
    return staged.withColumns(
        {
            "letter": F.concat(head, c("_body"), F.lit("\n")),
            "warnings": claim_warnings(c("_body"), F.lit(reference), forbidden),
        }
    ).drop("_body")


def prep_questions(df: DataFrame, questions: Sequence[str] = tuple(P.PREP_QUESTIONS)) -> DataFrame:
    """One row per record and question."""
    return df.select(
        "*", F.posexplode(X.string_array(questions)).alias("_pos", "question")
    ).withColumn("number", (F.col("_pos") + 1).cast("bigint")).drop("_pos")


def prep_sheet(title: Column, company: Column, questions: Sequence[str] = tuple(P.PREP_QUESTIONS)) -> Column:
    head = F.concat(F.lit("## Interview Prep — "), title, F.lit(" @ "), X.text_of(company), F.lit("\n"))
    body = [F.lit(f"## Q{i}: {q}\n\n{P.ANSWER_HINT}\n") for i, q in enumerate(questions, 1)]
    return F.concat_ws("\n", head, *body)


def apply_actions(df: DataFrame, dry_run: bool, unattended: bool, smtp_ready: bool) -> DataFrame:
    """Action, new status and note per candidate with method, target and warnings."""
    warned = F.size("warnings") > 0
    by_email = (F.col("method") == "email") & F.col("target").isNotNull()
    action = F.when(F.lit(dry_run), F.lit("dry_run"))
    action = action.when(warned & F.lit(unattended), F.lit("skipped"))
    action = action.when(by_email & F.lit(smtp_ready), F.lit("email")).otherwise(F.lit("manual"))
    staged = df.withColumn("action", action)
    acted = F.col("action")
    note = (
        F.when(acted == "email", F.concat(F.lit("auto-emailed to "), "target"))
        .when(
            (acted == "manual") & by_email,
            F.concat(F.lit("email apply queued to "), "target", F.lit(" (SMTP not configured)")),
        )
        .when(
            acted == "manual",
            F.concat(F.lit("cover letter saved, manual submit needed ("), "method", F.lit(")")),
        )
    )
    status = F.when(acted == "email", F.lit("applied")).when(acted == "manual", F.lit("interested"))
    return staged.withColumns({"new_status": status, "note": note})


# -- prompts ----------------------------------------------------------------------------


def verdict_prompt(resume: Column, title: Column, company: Column, location: Column, description: Column) -> Column:
    return X.fill(
        F.lit(P.VERDICT_PROMPT),
        {
            "resume": resume,
            "title": X.text_of(title),
            "company": X.text_of(company),
            "location": X.text_of(location),
            "description": X.text_of(description),
        },
    )


def gap_prompt(items: Column, title: Column, company: Column, location: Column, description: Column) -> Column:
    return X.fill(
        F.lit(P.GAP_PROMPT),
        {
            "items": items,
            "title": X.text_of(title),
            "company": X.text_of(company),
            "location": X.text_of(location),
            "description": X.text_of(description),
        },
    )
