"""Keyed operators, state and scoring against brute force, hot keys included."""

import math
import os
import random
import re
import time
from collections import Counter, defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gleaner import params as P
from gleaner import session
from gleaner.operators import documents as DOC
from gleaner.operators import identity, keyed, reports, scoring, state


def tokens(text):
    return [w for w in re.findall(r"[^\W]{2,}", text.lower()) if w not in P.STOP_WORDS]


def terms(text):
    w = tokens(text)
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def cosine(query, docs):
    corpus = [terms(query)] + [terms(d) for d in docs if tokens(d)]
    n = len(corpus)
    df = Counter(t for c in corpus for t in c)
    vec = [{t: (1 + math.log(f)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, f in c.items()} for c in corpus]
    norm = [math.sqrt(sum(v * v for v in x.values())) for x in vec]
    q, out, at = vec[0], [], 1
    for d in docs:
        if not tokens(d):
            out.append(0.0)
            continue
        x = vec[at]
        out.append(sum(v * q.get(t, 0) for t, v in x.items()) / (norm[0] * norm[at]))
        at += 1
    return out


DOCS = ["lab work with python", "python python data lab lab", "", "the of", "cooking and baking", "data lab python data lab"] + [f"word{i} python" for i in range(40)]
QUERIES = ["python data lab", "baking bread", "zebra"]


@pytest.mark.parametrize("block", [1_000, 1])
def test_tfidf_is_the_definition(spark, monkeypatch, block):
    """Also where every query has a row of its own in the index."""
    monkeypatch.setattr(scoring, "QUERY_BLOCK", block)
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string").repartition(5)
    qs = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, text string")
    got = defaultdict(float, {(r["query_id"], r["doc_id"]): r["score"] for r in scoring.tfidf_cosine(docs, qs).collect()})
    for q, text in enumerate(QUERIES):
        for d, want in enumerate(cosine(text, DOCS)):
            assert got[q, d] == pytest.approx(want, abs=1e-9)


def test_tfidf_reads_each_text_once_and_ends_on_odd_rows(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([*enumerate(DOCS), (100, None), (101, "! ?"), (102, "lab"), (102, "lab")], "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    qs = spark.createDataFrame([("a", "lab"), ("b", ""), ("c", None)], "query_id string, text string")
    out = scoring.tfidf_cosine(docs, qs)
    assert "text" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["query_id"] for r in out.collect()} == {"a"}
    assert scoring.tfidf_cosine(docs.where("false"), qs).count() == 0 == scoring.tfidf_cosine(docs, qs.where("false")).count()


def test_score_order(spark):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    q = spark.createDataFrame([(0, "python data lab")], "query_id int, text string")
    s = {r["doc_id"]: r["base"] for r in scoring.score_against(docs, q).collect()}
    assert len(s) == len(DOCS) and s[2] == s[3] == 0.0 and s[1] > 0.3 > s[10]


def hot_rows(n=3000):
    """A third of all rows share one key."""
    rng = random.Random(7)
    return [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(50)}", rng.choice(["", None, "2026-01-01", "2026-01-02"]), rng.randrange(9)) for i in range(n)]


def test_dedup_against_loop(spark):
    rows = hot_rows()
    want = {}
    for i, key, posted, _ in rows:
        kept = want.get(key)
        if kept is None or (posted and (not kept[1] or posted > kept[1])):
            want[key] = (i, posted)
    df = spark.createDataFrame(rows, "arrival long, job_hash string, posted_at string, score long").repartition(7)
    got = {r["job_hash"]: (r["arrival"], r["posted_at"]) for r in identity.dedup_keep_latest(df).collect()}
    assert got == want


def test_hot_group_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame(hot_rows(), "arrival long, job_hash string, posted_at string, score long")
    plan = identity.dedup_keep_latest(df)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_anti_known_hash_lets_empty_through(spark):
    batch = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, ""), (5, None), (6, "b")], "arrival long, job_hash string")
    known = spark.createDataFrame([("b",), ("",)], "job_hash string")
    assert sorted(r["arrival"] for r in identity.anti_known_hash(batch, known).collect()) == [1, 3, 4, 5]


def test_cap_per_source_is_whole_for_small_sources(spark):
    rows = [("big", f"u{i // 2}", i // 10, i % 10) for i in range(500)] + [("small", "x", 0, 0)]
    df = spark.createDataFrame(rows, "source string, url string, page int, pos int")
    got = identity.cap_per_source(df, 100, 40).collect()
    big = [r for r in got if r["source"] == "big"]
    assert len(big) == 100 and sum(r["enrich"] for r in big) == 40 and len({r["url"] for r in big}) == 100
    assert len(got) == 101


def test_global_rank_over_ties(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "arrival long, k string, p string, score double".replace("double", "long"))
    got = {r["arrival"]: r["rank"] for r in reports.rank_by_score(df.repartition(9).select("arrival", F.col("score").cast("double").alias("score"))).collect()}
    want = [a for a, *_ in sorted(rows, key=lambda r: (-r[3], r[0]))]
    assert [a for a, _ in sorted(got.items(), key=lambda x: x[1])] == want
    assert sorted(got.values()) == list(range(1, len(rows) + 1))


def test_index_percentiles(spark):
    scores = [0.1, 0.2, 0.3, 0.4, None]
    df = spark.createDataFrame(list(enumerate(scores)), "arrival long, score double")
    r = reports.index_percentiles(df, 0.25, [("p50", 0.5), ("p75", 0.75), ("p90", 0.9)]).first()
    assert (r["scored"], r["top"], r["p50"], r["p75"], r["p90"], r["above"]) == (4, 0.4, 0.3, 0.4, 0.4, 2)


@pytest.mark.parametrize("bins", [2, 3, 1024])
def test_selection_against_sort(spark, bins):
    r = random.Random(bins)
    values = [r.choice([0.5, 0.25, -1.0, r.random(), r.random() * 1e-9, 1e300 * r.random(), -1e308, 1e308]) for _ in range(300)]
    values += [math.inf, -math.inf, -math.inf, math.nan, 0.0]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(4)
    want = sorted(values, key=lambda v: (math.isnan(v), v))
    got = reports.select_positions(df, "v", [*range(0, 305, 19), 0, 1, 2, 302, 303, 304], bins)
    for p, v in got.items():
        assert v == want[p] or math.isnan(v) and math.isnan(want[p])


def test_selection_sorts_nothing(spark):
    df = spark.createDataFrame([(0.5,)] * 50 + [(0.25,)] * 50, "score double")
    r = reports.index_percentiles(df, 0.5, [("p50", 0.5), ("p49", 0.49), ("end", 1.0)]).first()
    assert tuple(r) == (100, 0.5, 0.5, 0.25, None, 50)
    assert tuple(reports.index_percentiles(df.where("false"), 0.5, [("p50", 0.5)]).first()) == (0, None, None, 0)


def test_only_scores_and_keys_are_ranked(spark):
    df = spark.createDataFrame([(i, float(i % 7), f"text {i}") for i in range(500)], "arrival long, score double, title string")
    out = reports.with_rank(df.repartition(6))
    got = {r["arrival"]: (r["rank"], r["title"]) for r in out.collect()}
    want = sorted(range(500), key=lambda i: (-(i % 7), i))
    assert got == {i: (n + 1, f"text {i}") for n, i in enumerate(want)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "rangepartitioning" in line and "title" in line]


@pytest.mark.parametrize("blend", [True, False])
def test_variants_by_the_full_score(spark, blend):
    """Every record with every variant, scored one by one."""
    chain = scoring.Chain(
        P.BlendRules(keywords=["lab", "data"]) if blend else None, P.FocusRules(keywords=["python"]), P.PayRules(True, 100, 0.1), P.PlaceRules(["guelph"], 0.05)
    )
    docs = spark.createDataFrame(
        [(i, f"Title {i % 3} lab", d, 50 * (i % 4) or None, None, ["Guelph, ON", None, "Bern"][i % 3]) for i, d in enumerate(DOCS)],
        "doc_id long, title string, description string, salary_min long, salary_max long, location string",
    )
    labels = [("b", "python data lab"), ("a", "baking bread"), ("c", "zebra")]
    variants = spark.createDataFrame(labels, "label string, text string")
    want = {}
    for label, text in labels:
        base = dict(enumerate(cosine(text, DOCS)))
        given = docs.join(spark.createDataFrame(list(base.items()), "doc_id long, _base double"), "doc_id")
        for r in scoring.apply_boosts(given, "_base", chain.blend, chain.focus, chain.pay, chain.place).collect():
            want[r["doc_id"], label] = round(r["score"], 9)
    pairs = scoring.variant_scores(docs, variants, text="description", chain=chain, digits=9)
    dense = scoring.variant_scores(docs, variants, text="description", chain=chain, dense=True, digits=9)
    assert {(r["doc_id"], r["label"]): r["score"] for r in dense.collect()} == want
    sparse = {(r["doc_id"], r["label"]): r["score"] for r in pairs.collect()}
    assert sparse and all(want[k] == v for k, v in sparse.items()) and len(sparse) < len(want)
    best = {r["doc_id"]: (r["best_label"], r["best_score"]) for r in scoring.best_variant(pairs, docs, variants, chain=chain, digits=9).collect()}
    assert best == {d: min(((-want[d, x], x) for x in "abc"))[::-1][:1] + (max(want[d, x] for x in "abc"),) for d in range(len(DOCS))}
    for r in scoring.variant_summary(pairs, docs, variants, 0.3, chain=chain, digits=9).collect():
        mine = [want[d, r["label"]] for d in range(len(DOCS))]
        assert r["avg_score"] == pytest.approx(sum(mine) / len(mine)) and r["above"] == sum(s >= 0.3 for s in mine)
        assert r["wins"] == sum(b[0] == r["label"] for b in best.values())


def test_upsert_longest(spark):
    old = spark.createDataFrame([("1", 1, "t", "abc"), ("2", 2, "t", "abcdef")], "id string, arrival long, title string, description string")
    new = spark.createDataFrame([("1", 3, "new", "abcde"), ("1", 4, "new", "abcdefg"), ("2", 5, "new", "xyz"), ("3", 6, "new", "q"), ("3", 7, "later", "qq")], old.schema)
    got = {r["id"]: (r["title"], r["description"], r["is_new"]) for r in state.upsert_longest(old, new).collect()}
    assert got == {"1": ("t", "abcdefg", False), "2": ("t", "abcdef", False), "3": ("new", "qq", True)}


def test_status_fold_against_loop(spark):
    rng = random.Random(3)
    events = [
        (i, 1 if i % 3 == 0 else rng.randrange(20), datetime(2026, 1, 1 + i // 40, 0, i % 40), rng.choice(["seen", "applied", None, "bogus", "hidden"]), rng.choice([None, f"n{i}"]))
        for i in range(600)
    ]
    want = {}
    for i, p, ts, status, notes in events:
        if status == "bogus":
            continue
        s = want.setdefault(p, [None, None, None])
        if status is None:
            s[:] = [None, None, None]
            continue
        s[0] = status
        if status == "applied":
            s[1] = ts
        if notes is not None:
            s[2] = notes
    df = spark.createDataFrame(events, "event_id long, posting_id long, ts timestamp, status string, notes string").repartition(6)
    got = {r[0]: list(r[1:]) for r in state.status_updates(df).collect()}
    assert got == want
    assert state.reject_statuses(df).count() == sum(e[3] == "bogus" for e in events)


def test_prefix_lookup(spark):
    ids = spark.createDataFrame([("abcd1",), ("abcd2",), ("beef0",), ("cafe",)], "id string")
    keys = spark.createDataFrame([("abcd",), ("beef",), ("bee",), ("cafe",), ("abcd2",), ("zzzz",)], "lookup string")
    got = {r["lookup"]: r["id"] for r in identity.lookup_by_prefix(ids, keys).collect()}
    assert got == {"beef": "beef0", "cafe": "cafe", "abcd2": "abcd2"}


def test_alert_needs_minimum_and_log_stays_whole(spark):
    df = spark.range(1000).withColumnRenamed("id", "arrival")
    assert state.alert_when_min(df, 1001).count() == 0 and state.alert_when_min(df, 1000).count() == 1000
    log = state.alert_log_row(df, "{}", chunk=100)
    ids = log.select(F.explode(F.from_json("jobs_alerted", "array<bigint>")).alias("i"))
    assert ids.distinct().count() == 1000 and log.count() > 5
    assert {r["matched_count"] for r in log.collect()} == {1000}


def test_backfill_keeps_complete_rows(spark):
    df = spark.createDataFrame([(1, 0.5, "yes"), (2, 0.4, None), (3, None, None)], "arrival long, suitability_score double, qualification_verdict string")
    res = spark.createDataFrame([(1, 0.9, "no"), (2, 0.8, "no")], df.schema)
    got = {r[0]: tuple(r[1:]) for r in state.suitability_backfill(df, res).collect()}
    assert got == {1: (0.5, "yes", False), 2: (0.8, "no", True), 3: (None, None, False)}


def test_items_selection(spark):
    items = [DOC.Item("core", "skills", "Core", tags=["x"], core=True)] + [
        DOC.Item(f"i{n}", "projects", f"P{n}", tags=["technical"] if n % 2 else ["leadership"], bullets=["a", "b", "c"]) for n in range(12)
    ]
    df = spark.createDataFrame([(1, "technical", ["i0"]), (2, "customer-service", [])], "arrival long, profile string, covered array<string>")
    out = DOC.select_items(DOC.weigh_items(df, items), max_bullets=2, max_other=7).collect()
    first = {r["arrival"]: [e["item"]["id"] for e in r["chosen"]] for r in out}
    # the covered item leads, odd (technical) items follow, seven in all, then the core skill
    assert first[1] == ["i0", "i1", "i3", "i5", "i7", "i9", "i11", "core"]
    assert all(len(e["item"]["bullets"]) <= 2 for r in out for e in r["chosen"])
    # no projects section and no technical items for this profile
    assert first[2] == ["core"]


def test_categories_and_profiles(one):
    title, text = F.col("t"), F.col("d")
    best = scoring.best_category(title, text, P.CATEGORIES)
    assert one(best, t="Data technician", d="lab research") == "laboratory"
    assert one(best, t="Collaborator", d="lab research data") is None
    profile = scoring.best_profile(title, text)
    assert one(profile, t="Clerk", d="available daily") == "general"
    assert one(profile, t="Developer", d="python and data, customer") == "technical"


def test_profile_resolution():
    assert scoring.resolve_profile(P.PROFILES, "bench").name == "bench"
    assert scoring.resolve_profile(P.PROFILES, "nope").name == "wide"
    assert scoring.category_keywords(P.CATEGORIES, ["LABORATORY"]) == ["lab", "research", "technician", "laboratory", "science"]


def test_boosts_are_capped(spark):
    df = spark.createDataFrame([(0.9, 70_000, None, "Guelph, ON", "lab data python", "")], "base double, salary_max long, salary_min long, location string, title string, description string")
    out = scoring.apply_boosts(df, "base", None, P.FocusRules(["lab", "data"]), P.PayRules(True, 35_000, 0.1), P.PlaceRules(["guelph"], 0.1))
    assert out.first()["score"] == 1.0
    blend = P.BlendRules(keywords=["lab"])
    out = scoring.apply_boosts(df, "base", blend, P.FocusRules(), P.PayRules(), P.PlaceRules())
    assert out.first()["score"] == pytest.approx(0.6 * 0.9 + 0.4 * 2 / 6)


def test_frequent_terms_are_looked_up_not_shuffled(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"common words here w{i % 7} x{i}") for i in range(60)], "doc_id long, text string")
    query = spark.createDataFrame([(0, "common w3 x5 other")], "query_id int, text string")

    def scores(hot_terms: int) -> dict:
        monkeypatch.setattr(scoring, "HOT_TERMS", hot_terms)
        return {r["doc_id"]: round(r["score"], 12) for r in scoring.tfidf_cosine(docs, query).collect()}

    none_hot, some_hot, all_hot = scores(1), scores(20), scores(10**9)
    assert len(none_hot) == 60 and none_hot == some_hot == all_hot


def test_facts_of_a_row_are_counted_in_its_task(spark):
    """Also of terms that differ in their lowest bits only, in slices, and beside rows without words."""
    rows = [(1, [5, 6, 5, 7, 6, 5]), (2, []), (3, None), (None, [7]), (1, [6, -1]), (4, [2**40, 2**40, 2**40])]
    words = spark.createDataFrame(rows, "doc_id long, _words array<long>").coalesce(1)
    whole = [tuple(r) for r in scoring.term_facts(words, "doc_id").collect()]
    want = Counter((at, k, w) for at, (k, ws) in enumerate(rows) for w in ws or [])
    assert sorted((repr(k), t, tf) for k, t, tf in whole if t in {w for _, ws in rows for w in ws or []}) == sorted((repr(k), w, n) for (_, k, w), n in want.items())
    pairs = Counter(k for k, ws in rows for _ in (ws or [])[1:])
    assert Counter({k: sum(tf for k2, t, tf in whole if k2 == k) for k in (1, 4)}) == Counter({1: 8 + pairs[1], 4: 3 + pairs[4]})
    assert (4, 2) in {(k, tf) for k, _, tf in whole}  # the pair of a word with itself, twice
    parts = [tuple(r) for part in range(3) for r in scoring.term_facts(words, "doc_id", part, 3).collect()]
    assert sorted(map(repr, parts)) == sorted(map(repr, whole))


def test_tfidf_in_slices_is_the_definition(spark, monkeypatch):
    for name, value in {"SLICE_WORDS": 0, "SLICES": 3, "SAMPLE": 2, "QUERY_TERMS": 0, "HOT_TERMS": 20}.items():
        monkeypatch.setattr(scoring, name, value)
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string").repartition(5)
    qs = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, text string")
    got = defaultdict(float, {(r["query_id"], r["doc_id"]): r["score"] for r in scoring.tfidf_cosine(docs, qs).collect()})
    for q, text in enumerate(QUERIES):
        for d, want in enumerate(cosine(text, DOCS)):
            assert got[q, d] == pytest.approx(want, abs=1e-9)


def test_best_variant_shuffles_no_pairs_and_keeps_no_facts(spark, monkeypatch):
    """Disk of the whole job: written tables stay smaller than the facts, nothing is dealt by record and variant."""
    written = []

    def stored(df, **options):
        out = session.stored(df, **options)
        written.extend(out.inputFiles())
        return out

    monkeypatch.setattr(scoring, "stored", stored)
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(3_000)}" for _ in range(200))) for i in range(400)], "doc_id long, text string").coalesce(1)
    variants = spark.createDataFrame([(f"v{i}", f"w{i} w{i + 1} w7") for i in range(20)], "label string, text string")
    best = scoring.best_variant(scoring.variant_scores(docs, variants), docs, variants)
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", best._jdf.queryExecution().executedPlan().toString())
    assert dealt and all(len(keys.split(", ")) == 2 for keys in dealt)  # one key and the number of partitions
    facts = sum(len(terms(r["text"])) for r in docs.collect())
    assert sum(os.path.getsize(f.removeprefix("file:")) for f in written) < 8 * facts  # a fact's term alone
    assert best.count() == 400


def test_stored_leaves_no_shuffle_files(spark):
    def files() -> int:
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    spark._jvm.System.gc()
    time.sleep(2)
    before, setting = files(), spark.conf.get(session.CLEANUP)
    out = session.stored(spark.range(10_000).groupBy((F.col("id") % 997).alias("k")).count(), cleanup=True)
    deadline = time.time() + 20
    while files() > before and time.time() < deadline:
        time.sleep(0.2)
    assert files() <= before and out.count() == 997 and spark.conf.get(session.CLEANUP) == setting


def test_items_are_chosen_once_before_untraceable_ones_are_rejected(spark):
    items = [DOC.Item("a", "skills", "Tools", "Here", ["Lathe work", "Mill work"], ["lab"], True)]
    df = spark.createDataFrame([(1,), (2,), (3,)], "arrival long").withColumn("profile", F.lit("general"))
    df = DOC.weigh_items(df.withColumn("covered", F.array().cast("array<string>")), items)
    df = DOC.select_items(df)
    title = F.when(F.col("arrival") == 2, "Invented").when(F.col("arrival") == 3, "tools ").otherwise(F.col("chosen")[0]["item"]["title"])
    df = df.withColumn("chosen", F.transform("chosen", lambda e: e.withField("item", e["item"].withField("title", title))))
    out = DOC.tailored_resumes(df, items, "N", "C", {}).select("arrival", "resume")
    assert sorted(r.arrival for r in out.collect()) == [1, 3]
    # the choice stands in the plan once: the condition on it is not moved below with a copy of it
    assert out._jdf.queryExecution().optimizedPlan().toString().count("array_sort") <= 2
