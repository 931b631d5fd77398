"""Mixes against a plain version of the same rule."""

import hashlib
import math
import random
import re

import pytest

from gleaner.llm import mixing


def plain_mix(rows, weights=(3, 1, 2), share=1.5, cap=2.0):
    """{(doc_id, source, size): (target, taken)} for distinct units with their number of rows."""
    units = {}
    for d, t, s in rows:
        key = (d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
        units[key] = units.get(key, 0) + 1
    sizes = {}
    for (_, s, size), n in units.items():
        sizes[s] = sizes.get(s, 0) + size * n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, words = set(), share * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        level = (words - sum(cap * sizes[s] for s in full)) / sum(w[s] for s in rest) if rest else math.inf
        more = {s for s in rest if cap * sizes[s] <= level * w[s]}
        if not more:
            break
        full |= more
    target = {s: cap * sizes[s] if s in full else level * w[s] for s in order}
    out = {}
    for s in order:
        mine = [(d, size, n, size * n) for (d, src, size), n in units.items() if src == s]
        ratio = target[s] / sizes[s] if sizes[s] else 0
        whole = math.floor(ratio)
        missing = target[s] - whole * sizes[s] if ratio > whole else 0
        chosen = set()
        if missing > 0:
            # certain copies, the largest first, until every other probability is below 1
            rest = sorted((x for x in mine if x[3]), key=lambda x: x[3])
            while missing * rest[-1][3] >= sum(x[3] ** 2 for x in rest):
                most = rest[-1][3]
                gone = [x for x in rest if x[3] == most]
                rest = rest[: -len(gone)]
                chosen |= {x[:2] for x in gone}
                missing -= most * len(gone)
            scale, mean = missing / sum(x[3] ** 2 for x in rest), missing / sum(x[3] for x in rest)

            def q(x):
                u = (int(hashlib.md5(f"mix:{'' if x[0] is None else x[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                p = scale * x[3]
                r = (u / (1 - u)) / (p / (1 - p)) * (mean / (1 - mean))
                return r / (1 + r)

            ranked = sorted(rest, key=lambda x: (q(x), x[0] is not None, x[0] or 0, x[1]))
            for _ in range(3):
                through, now = 0, []
                for x in [x for x in ranked if x[:2] not in chosen and x[3] <= missing]:
                    through += x[3]
                    if through > missing:
                        break
                    now.append(x)
                chosen |= {x[:2] for x in now}
                missing -= sum(x[3] for x in now)
            fits = [(abs(x[3] - missing), i, x) for i, x in enumerate(ranked) if x[:2] not in chosen and abs(x[3] - missing) < missing]
            if fits:
                chosen.add(min(fits)[2][:2])
        for d, size, *_ in mine:
            out[(d, s, size)] = (target[s], size * (whole + ((d, size) in chosen)))
    return out


@pytest.mark.parametrize("n", [1, 7, 400])
def test_equal_to_the_plain_rule(spark, n):
    rows = [(i, "w " * ((i * 37) % 23), f"s{i % 5}" if i % 3 else "hot") for i in range(n)] + [(0, "w " * 9, None)] * 2
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = plain_mix(rows)
    assert len(got) == len(rows)
    for r in got:
        target, taken = want[(r.doc_id, r.source, r.size)]
        assert r.target == pytest.approx(target) and r.taken == taken <= 2 * r.size


def test_near_the_targets_and_rerun(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in mixing.mix(documents).collect()]
    assert sorted(rows) == sorted(tuple(r) for r in mixing.mix(documents).collect())
    target, taken = {}, {}
    for _, s, _, _, t, _, n in rows:
        target[s], taken[s] = t, taken.get(s, 0) + n
    sizes = sum(r[2] for r in rows)
    assert sum(target.values()) == pytest.approx(1.5 * sizes)
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in target)


@pytest.mark.parametrize("seed", range(4))
def test_a_long_document_does_not_spoil_the_target(spark, seed):
    """One document with 30 % of its source's words, in every source but one."""
    r = random.Random(seed)
    rows = [(i + 10_000 * seed, "w " * r.randrange(10, 60), f"s{i % 4}") for i in range(1_600)]
    words = sum(len(t) // 2 for _, t, s in rows if s == "s0")
    rows += [(90_000 + i + 10_000 * seed, "w " * int(words * 3 / 7), f"s{i}") for i in range(3)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = plain_mix(rows)
    target, taken = {}, {}
    for g in got:
        assert g.taken == want[(g.doc_id, g.source, g.size)][1] <= 2 * g.size
        target[g.source], taken[g.source] = g.target, taken.get(g.source, 0) + g.taken
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in target)


def test_longer_documents_are_sampled_more_often(spark):
    """Documents three times as long, with a probability of 0.45 for 0.15."""
    rows = [(i, "w " * (10 if i % 2 else 30), "a") for i in range(4_000)] + [(10_000 + i, "w " * 40, "b") for i in range(4_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    drawn = {10: 0, 30: 0}
    for g in mixing.mix(df, weights=(1, 3), share=0.5).where("source = 'a'").collect():
        drawn[g.size] += g.copies
    assert abs(drawn[10] / 2_000 - 0.15) < 0.03 and abs(drawn[30] / 2_000 - 0.45) < 0.03


def test_odd_rows(odd_documents, no_documents):
    got = mixing.mix(odd_documents)
    rows = got.collect()
    assert len(rows) == odd_documents.count()
    want = plain_mix([(r.doc_id, r.text, r.source) for r in odd_documents.collect()])
    assert all(r.taken == want[(r.doc_id, r.source, r.size)][1] for r in rows)
    taken = mixing.take(odd_documents, got)
    copies = {}
    for r in rows:
        copies[r.doc_id] = max(copies.get(r.doc_id, 0), r.copies)
    assert taken.columns == odd_documents.columns
    assert taken.count() == sum(copies[r.doc_id] for r in rows)
    assert mixing.mix(no_documents).count() == 0


def test_no_python_in_the_plan(documents):
    plan = mixing.mix(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
