"""Counters, ranked rows and text cells for reports, digests and notifications."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import params as P
from gleaner.functions import dates as D
from gleaner.functions import money as M
from gleaner.functions import text as X
from gleaner.operators.keyed import global_rank

MISSING = "—"


def score_cell(score: str, digits: int) -> Column:
    shown = F.when(F.col(score).isNotNull(), F.format_string(f"%.{digits}f", score))
    return F.coalesce(shown, F.lit(MISSING))


def rank_by_score(df: DataFrame, score: str = "score", tie: str = "arrival") -> DataFrame:
    order = [F.coalesce(score, F.lit(0.0)).desc(), F.col(tie).asc()]
    return global_rank(df, order)


def with_rank(df: DataFrame, score: str = "score", key: str = "arrival") -> DataFrame:
    """``df`` with ``rank``. Only the score and the unique key are sorted; the wide rows meet their rank by key."""
    return df.join(rank_by_score(df.select(score, key), score, key).select(key, "rank"), key)


def write_ranked(df: DataFrame, path: str) -> None:
    """Rows in order of ``rank``: every file holds a range of ranks, the files' names are in that order."""
    df.repartitionByRange("rank").sortWithinPartitions("rank").write.mode("overwrite").parquet(path)


def report_counters(df: DataFrame, threshold: float) -> DataFrame:
    above = F.coalesce("score", F.lit(0.0)) >= threshold
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(above).alias("above"),
        F.count_if("notified").alias("notified"),
        F.count_if(F.col("application_status").isNotNull()).alias("tracked"),
        F.count_distinct("source").alias("sources"),
    )


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("postings"))


# Bins that one round of a selection tells apart in each range.
SELECT_BINS = 1 << 10


def select_positions(df: DataFrame, value: str, positions: Sequence[int], bins: int = SELECT_BINS) -> dict[int, float]:
    """The values at 0-based ``positions`` of the ascending order of a column of numbers, without a sort.

    Each round counts the values of the ranges that hold a wanted position in ``bins`` bins, with the least and the
    largest value of each bin, and keeps the bin of the position, until its values are all one. The ends
    of a range lie in different bins, so every round narrows it. A round moves one row per bin and
    task. Infinite values and NaN stand at the ends, as in a sort; nulls are left out.
    """
    v, big = F.col(value), float("inf")
    finite = ~F.isnan(v) & (F.abs(v) < big)
    n = df.agg(
        F.count_if(v == -big).alias("low"), F.count_if(finite).alias("n"), F.count_if(v == big).alias("high"),
        F.min(F.when(finite, v)).alias("least"), F.max(F.when(finite, v)).alias("most"),
    ).first()
    found, ranges = {}, {}
    for p in positions:
        at = p - n["low"]
        if at < 0:
            found[p] = -big
        elif at >= n["n"]:
            found[p] = big if at < n["n"] + n["high"] else float("nan")
        else:
            ranges[p] = (n["least"], n["most"], at)
    while ranges:
        found |= {p: lo for p, (lo, hi, _) in ranges.items() if lo == hi}
        ranges = {p: r for p, r in ranges.items() if r[0] < r[1]}
        if not ranges:
            break
        wanted = sorted({(lo, hi) for lo, hi, _ in ranges.values()})  # disjoint: bins of disjoint ranges
        place = F.lit(None)
        for i, (lo, hi) in enumerate(wanted):
            # halves first, as the difference of two large numbers can be infinite
            step = (v / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2) * (bins - 1)
            bin_ = F.when(v == hi, bins - 1).when(v == lo, 0).otherwise(F.least(F.floor(F.coalesce(F.nanvl(step, F.lit(0.0)), F.lit(0.0))), F.lit(bins - 2)))
            place = F.when(v.between(lo, hi), F.struct(F.lit(i).alias("range"), bin_.cast("int").alias("bin"))).otherwise(place)
        counts = df.where(finite).select(v.alias("v"), place.alias("p")).where("p IS NOT NULL").groupBy("p")
        rows = sorted(counts.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=lambda r: r["p"])
        narrowed = {}
        for p, (lo, hi, at) in ranges.items():
            before = 0
            for r in rows:
                if r["p"]["range"] == wanted.index((lo, hi)):
                    if at < before + r["n"]:
                        narrowed[p] = (r["lo"], r["hi"], at - before)
                        break
                    before += r["n"]
        ranges = narrowed
    return found


def index_percentiles(df: DataFrame, threshold: float, quantiles: Sequence[tuple[str, float]], score: str = "score") -> DataFrame:
    """Top, counts and exact index percentiles: element int(n*q) of the ascending scores."""
    scored = df.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("_v"))
    counters = scored.agg(F.count("*").alias("scored"), F.max("_v").alias("top"), F.count_if(F.col("_v") >= threshold).alias("above")).first()
    n = counters["scored"]
    at = {name: int(n * q) for name, q in quantiles}
    values = select_positions(scored, "_v", sorted({p for p in at.values() if p < n}))
    row = (n, counters["top"], *[values.get(at[name]) for name, _ in quantiles], counters["above"])
    picks = ", ".join(f"{name} double" for name, _ in quantiles)
    return df.sparkSession.createDataFrame([row], ", ".join(x for x in ("scored bigint, top double", picks, "above bigint") if x))


def deadline_counters(df: DataFrame, today: date) -> DataFrame:
    left = D.days_until(F.col("deadline"), F.lit(today))
    return df.agg(
        F.count("*").alias("listed"),
        F.count_if(left <= 3).alias("within_3"),
        F.count_if(left <= 7).alias("within_7"),
    )


def scan_metrics() -> dict[str, Column]:
    """Counters of the flagged rows of a scan, to be observed on the pass that writes them."""
    return {
        "seen": F.count("*"),
        "cross_duplicates": F.count_if("cross_duplicate"),
        "new": F.count_if("is_new"),
        "excluded": F.count_if(F.col("is_new") & F.col("exclude_reason").isNotNull()),
        "notified": F.count_if("notify"),
        # as many entries as there are sources
        "sources": F.size(F.collect_set("source")).cast("bigint"),
    }


def rescore_metrics(threshold: float) -> dict[str, Column]:
    """Counters of a rescoring, over rows with exclude_reason and score."""
    kept = F.col("exclude_reason").isNull()
    return {
        "rescored": F.count_if(kept),
        "re_excluded": F.count_if(~kept),
        "above": F.count_if(kept & (F.col("score") >= threshold)),
    }


def batch_metrics() -> dict[str, Column]:
    """Counters of an application batch, over rows with unsuitable_reason and method."""
    ok = F.col("unsuitable_reason").isNull()
    return {
        "scanned": F.count("*"),
        "unsuitable": F.count_if(~ok),
        "applied": F.count_if(ok),
        "emails": F.count_if(ok & (F.col("method") == "email")),
        "portals": F.count_if(ok & F.col("method").isin("portal", "linkedin", "indeed")),
    }


def counted(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """One row of counters over rows that are not written; where they are, ``observe`` the same metrics."""
    return df.agg(*[m.alias(name) for name, m in metrics.items()])


def ranked_table(df: DataFrame, threshold: float) -> DataFrame:
    """Rows of the Markdown table of matches."""
    matches = df.where(F.coalesce("score", F.lit(0.0)) >= threshold)
    ranked = with_rank(matches.select("id", "arrival", "score", "application_status", "title", "company", "location", "source", "url"))
    status = F.col("application_status")
    box = F.create_map(*[F.lit(x) for kv in P.STATUS_BOX.items() for x in kv])

    def cell(c: str, width: int) -> Column:
        text = F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(MISSING))
        return F.replace(F.substring(text, 1, width), F.lit("|"), F.lit("\\|"))

    return ranked.select(
        "rank",
        score_cell("score", 3).alias("score_cell"),
        F.substring("id", 1, 8).alias("short_id"),
        F.when(status.isNotNull(), F.concat(F.coalesce(box[status], F.lit("[ ]")), F.lit(" "), status))
        .otherwise(F.lit("[ ]"))
        .alias("status_cell"),
        cell("title", 55).alias("title"),
        cell("company", 28).alias("company"),
        cell("location", 22).alias("location"),
        "source",
        F.concat(F.lit("[open]("), "url", F.lit(")")).alias("link"),
    )


def report_rows(df: DataFrame, threshold: float) -> DataFrame:
    narrow = df.select(
        "arrival", "score", "notified", "application_status", "title", "company", "source",
        F.coalesce(X.blank_to_null(F.col("posted_at")), F.col("first_seen").cast("string")).alias("_when"),
    )
    score = F.coalesce("score", F.lit(0.0))
    return with_rank(narrow).select(
        "rank",
        "arrival",
        "source",
        score_cell("score", 3).alias("score_cell"),
        (score >= threshold).alias("above"),
        "notified",
        X.text_of(F.col("application_status")).alias("status"),
        F.lower(F.concat_ws(" ", X.text_of(F.col("title")), X.text_of(F.col("company")))).alias("search_text"),
        D.date_cell(F.col("_when")).alias("posted"),
    )


def notification(title: Column, company: Column, location: Column, url: Column, score: Column) -> Column:
    """struct(title, body) of a desktop notification."""
    suffix = F.concat(F.lit(" ("), F.format_string("%.0f", F.rint(score * 100)), F.lit("%)"))
    head = F.concat(F.lit("New match: "), title)
    room = F.lit(P.NOTIFY_TITLE_MAX) - F.length(suffix)
    cut = F.when(
        F.length(head) > room, F.concat(F.substring(head, F.lit(1), room - 1), F.lit("…"))
    ).otherwise(head)

    def or_unknown(c: Column) -> Column:
        return F.coalesce(F.when(c != "", c), F.lit("Unknown"))

    body = F.concat(
        or_unknown(company), F.lit(" — "), or_unknown(location), F.lit("\n"), F.substring(url, 1, 80)
    )
    return F.struct(
        F.concat(cut, suffix).alias("title"), F.substring(body, 1, P.NOTIFY_BODY_MAX).alias("body")
    )


def alert_skills(skills: Column) -> Column:
    return F.when(F.size(skills) > 0, F.array_join(F.slice(skills, 1, 5), ", ")).otherwise(F.lit("N/A"))


def digest_entries(top: DataFrame) -> DataFrame:
    """Text block per row of an already limited digest."""
    score = score_cell("score", 2)
    deadline = F.when(
        F.col("deadline").isNotNull(), F.concat(F.lit("   deadline: "), F.col("deadline").cast("string"))
    )
    block = F.concat_ws(
        "\n",
        F.concat(F.col("rank").cast("string"), F.lit(". ["), score, F.lit("] "), "title", F.lit(" — "), "company"),
        F.concat(F.lit("   "), "location", F.lit("  ·  "), "source"),
        deadline,
        F.concat(F.lit("   "), "url"),
        F.lit(""),
    )
    cell = M.salary_cell(F.col("salary_min"), F.col("salary_max"), MISSING, "–")
    return top.select("rank", "arrival", block.alias("entry"), cell.alias("salary"))


def digest_text(entries: DataFrame, period: str) -> DataFrame:
    """The whole digest as one text; the input is a top-n, so the text is bounded by n."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "entry")))
    head = F.concat(
        F.lit("Your top "), F.count("*").cast("string"), F.lit(f" job(s) — {period}\n\n")
    )
    return entries.agg(
        F.concat(head, F.array_join(F.transform(listed, lambda e: e["entry"]), "\n")).alias("digest")
    )
