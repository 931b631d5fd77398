"""Row filters and eligibility cascades as DataFrame transformations."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import params as P
from gleaner.functions import rules as R
from gleaner.functions import text as X


def record_filter(df: DataFrame, f: P.RecordFilter) -> DataFrame:
    """Pay range overlap (null passes), skills, job types and excluded keywords."""
    cond = F.lit(True)
    if f.min_salary is not None:
        cond &= F.col("salary_max").isNull() | (F.col("salary_max") >= f.min_salary)
    if f.max_salary is not None:
        cond &= F.col("salary_min").isNull() | (F.col("salary_min") <= f.max_salary)
    if f.required_skills or f.excluded_skills:
        have = F.transform(F.coalesce("skills", F.array().cast("array<string>")), F.lower)
        for s in f.required_skills:
            cond &= F.array_contains(have, s.lower())
        for s in f.excluded_skills:
            cond &= ~F.array_contains(have, s.lower())
    if f.job_types:
        kind = X.text_of(F.col("job_type"))
        cond &= (kind == "") | kind.isin(list(f.job_types))
    if f.excluded_keywords:
        hay = F.lower(X.title_and_text(F.col("title"), F.col("description")))
        cond &= ~X.contains_any(hay, [k.lower() for k in f.excluded_keywords])
    return df.where(cond)


def exclude_with_reason(df: DataFrame, rules: P.ExcludeRules) -> DataFrame:
    """exclude_reason (null = keep); excluded rows get the score -1.0."""
    reason = R.exclude_reason(
        F.col("title"), F.col("description"), F.col("company"), F.col("location"), rules
    )
    out = df.withColumn("exclude_reason", reason)
    if "score" in df.columns:
        out = out.withColumn(
            "score", F.when(F.col("exclude_reason").isNotNull(), F.lit(-1.0)).otherwise(F.col("score"))
        )
    return out


def with_suitability(df: DataFrame, gate: str = "none", name: str = "unsuitable_reason") -> DataFrame:
    reason = R.unsuitable_reason(
        F.col("title"), F.col("description"), F.col("company"), F.col("location"), gate
    )
    return df.withColumn(name, reason)


def queue_candidates(
    df: DataFrame,
    threshold: float,
    status: str | None = None,
    today: date | None = None,
    min_date: date | None = None,
    terminal: Iterable[str] = P.TERMINAL_STATUSES,
) -> DataFrame:
    cond = (F.col("score") >= threshold) & (F.col("score") > -0.5)
    s = F.col("application_status")
    cond &= R.not_terminal(s, terminal) if status is None else (s == status)
    if today is not None:
        cond &= F.col("deadline").isNull() | (F.col("deadline") >= F.lit(today))
    if min_date is not None:
        # posted_at is kept as text and compared as text, like relative labels demand
        seen = F.coalesce(X.blank_to_null(F.col("posted_at")), F.col("first_seen").cast("string"))
        cond &= seen >= F.lit(min_date.isoformat())
    return df.where(cond)


def queue_static_flags(
    df: DataFrame,
    gate: str = "none",
    exclude_sources: Sequence[str] = (),
    far: Sequence[str] = (),
    companies: Sequence[str] = (),
) -> DataFrame:
    """hidden_by_verdict and keep per row of the queue scan; one projection."""
    staged = with_suitability(df, gate)
    hidden = F.coalesce(F.col("qualification_verdict") == "no", F.lit(False))
    keep = F.col("unsuitable_reason").isNull() & ~hidden & ~R.is_closed(F.col("description"))
    if exclude_sources:
        keep &= ~F.lower(X.text_of(F.col("source"))).isin([s.lower() for s in exclude_sources])
    if far:
        keep &= ~X.contains_any(F.lower(X.text_of(F.col("location"))), [f.lower() for f in far])
    if companies:
        keep &= ~R.company_blocked(F.col("company"), companies)
    return staged.withColumns({"hidden_by_verdict": hidden, "keep": keep})


def search_filter(
    df: DataFrame,
    query: str = "",
    sources: Sequence[str] | None = None,
    only_above: float | None = None,
    status: str | None = None,
) -> DataFrame:
    """Free text over title, company, source and status; without text 'hidden' rows stay out.

    ``status`` may be 'tracked', 'untracked' or one status; ``sources`` keeps the ticked ones.
    """
    q = query.lower().strip()
    own = F.col("application_status")
    if q:
        cond = X.any_of(
            F.contains(F.lower(X.text_of(F.col(c))), F.lit(q)) for c in ("title", "company", "source")
        ) | F.contains(X.text_of(own), F.lit(q))
    else:
        cond = own.isNull() | (own != "hidden")
    if sources is not None:
        cond &= F.col("source").isin(list(sources))
    if only_above is not None:
        cond &= F.coalesce("score", F.lit(0.0)) >= only_above
    if status == "tracked":
        cond &= own.isNotNull()
    elif status == "untracked":
        cond &= own.isNull()
    elif status:
        cond &= own == status
    return df.where(cond)


def deadline_list(df: DataFrame, on_or_after: date | None = None) -> DataFrame:
    cond = F.col("deadline").isNotNull() & R.not_terminal(F.col("application_status"))
    if on_or_after is not None:
        cond &= F.col("deadline") >= F.lit(on_or_after)
    return df.where(cond)


def suitability_candidates(df: DataFrame, threshold: float, limit: int) -> DataFrame:
    todo = F.col("suitability_score").isNull() | F.col("qualification_verdict").isNull()
    return (
        df.where((F.col("score") >= threshold) & (F.col("score") > -0.5) & todo)
        .where(R.not_terminal(F.col("application_status")))
        .orderBy(F.col("score").desc(), F.col("arrival").asc())
        .limit(limit)
    )


def follow_up(df: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Applied longer than ``days`` ago, with the whole days since."""
    from gleaner.functions.dates import whole_days_since

    stale = (F.col("application_status") == "applied") & (
        F.col("applied_at") < now - F.make_interval(days=F.lit(days))
    )
    return df.where(stale).withColumn("days_ago", whole_days_since(F.col("applied_at"), now))


def rescore_set(df: DataFrame) -> DataFrame:
    return df.where(F.col("score").isNull() | (F.col("score") > -0.5))


def unnotified_above(df: DataFrame, threshold: float) -> DataFrame:
    return df.where(~F.col("notified") & (F.col("score") >= threshold))


def export_candidates(df: DataFrame, threshold: float, gated: bool, exported: DataFrame) -> DataFrame:
    from gleaner.operators.keyed import anti_join

    cond = F.col("score") >= threshold
    if gated:
        v = F.col("qualification_verdict")
        cond &= v.isNull() | (v != "no")
    return anti_join(df.where(cond), exported, "arrival")


def digest_top_n(df: DataFrame, threshold: float, since: Column, n: int) -> DataFrame:
    score = F.coalesce("score", F.lit(0.0))
    return (
        df.where((score >= threshold) & (F.col("first_seen") >= since))
        .where(R.not_terminal(F.col("application_status")))
        .orderBy(score.desc(), F.col("arrival").asc())
        .limit(n)
    )


def recent_top_n(df: DataFrame, n: int | None) -> DataFrame:
    """Newest first; without ``n`` every row, unordered (order the sink's partitions instead)."""
    if n is None:
        return df
    return df.orderBy(F.col("first_seen").desc(), F.col("arrival").asc()).limit(n)


def top_suitable_n(df: DataFrame, threshold: float, n: int, gate: str = "none") -> DataFrame:
    """The limit counts eligible rows, so eligibility comes before the top-k."""
    ok = with_suitability(df.where(F.col("score") >= threshold), gate)
    return (
        ok.where(F.col("unsuitable_reason").isNull())
        .drop("unsuitable_reason")
        .orderBy(F.col("score").desc(), F.col("arrival").asc())
        .limit(n)
    )
