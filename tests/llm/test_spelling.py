"""Spelling variants against brute force, block limits included."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from gleaner.llm import spelling


def plain_counts(rows):
    out = Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def plain_near(words):
    """word -> set of words one edit away."""
    less = {}
    for w in words:
        for i in range(len(w)):
            less.setdefault(("replaced", i, w[:i] + w[i + 1 :]), set()).add(w)
            if w[:i] + w[i + 1 :] in words:
                less.setdefault(("longer", w, w[:i] + w[i + 1 :]), set()).update((w, w[:i] + w[i + 1 :]))
    near = {w: set() for w in words}
    for group in less.values():
        for w in group:
            near[w] |= group - {w}
    return near


def plain_variants(rows):
    counts = plain_counts(rows)
    near = plain_near(counts)
    form = {}
    for w, others in near.items():
        best = min(((-counts[o], o) for o in others), default=None)
        form[w] = best[1] if best and -best[0] >= 10 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(str((w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None)) for w, n in counts.items())


def result(df):
    return sorted(str((r.word, r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect())


@pytest.mark.parametrize("seed", range(30))
def test_scan_equals_brute_force(seed):
    r = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdé"
    words = sorted({"".join(r.choice(letters) for _ in range(r.randrange(1, 8))) for _ in range(60)})
    near = plain_near(set(words))
    scan, visited = spelling.Scan(words), []
    for q in words:
        assert {words[j] for j in scan.near(q, visited)} == {w for w in near[q] if len(w) >= len(q)}


def test_ranges_are_skipped():
    r = random.Random(0)
    words = sorted({"".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(4000)})
    scan, visited = spelling.Scan(words), []
    for q in words[::200]:
        scan.near(q, visited)
    assert len(visited) < 0.2 * len(words) * len(words[::200])


def test_documents_equal_brute_force(documents):
    want = plain_variants([(r.doc_id, r.text) for r in documents.collect()])
    got = result(spelling.group_variants(documents))
    assert got == want and any("None" not in w for w in want)


@pytest.mark.parametrize("limit", [2, 8, 10_000])
def test_split_blocks_lose_no_pair(spark, limit):
    r = random.Random(3)
    words = {"prefix" + "".join(r.choice("abc") for _ in range(r.randrange(1, 7))) for _ in range(250)}
    words |= {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "baaaaaaa", "aaaaaaab", "étéétéé", "étéété", "etéétété"}
    words = {w for w in words if len(w) >= 7}
    df = spark.createDataFrame([(w, 1 + len(w) * sum(map(ord, w)) % 97) for w in sorted(words)], "word string, n long")
    counts = {r.word: r.n for r in df.collect()}
    got = {r.word: (r.n_near, r.form, r.form_n) for r in spelling.near_words(df, limit).collect()}
    want = {}
    for w, others in plain_near(words).items():
        if others:
            n, best = min((-counts[o], o) for o in others)
            want[w] = (len(others), best, -n)
    assert got == want


def test_chain_of_forms(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(9)] + [("x", "w3")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {**{f"w{i}": "w9" for i in range(9)}, "x": "w9"}


def test_odd_rows(spark, odd_documents, no_documents):
    extra = [(None, "Lighthouse LIGHTHOUSE lighthousé × ÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷ Łighthouse"), (3, "lighthouse " * 30 + "á" + "lighthause lighthause"), (3, "é" * 9 + " " + "é" * 9 + " " + "x" * 5000 + " " + "x" * 5000 + " " + "x" * 5001 + "1" + "x" * 5001)]
    df = odd_documents.unionByName(spark.createDataFrame([*extra, *extra], "doc_id long, text string"), allowMissingColumns=True)
    df = df.withColumn("word", F.lit("mine")).withColumn("id", F.lit(0))
    want = plain_variants([(r.doc_id, r.text) for r in df.collect()])
    assert result(spelling.group_variants(df)) == want and len(want) > 5
    assert result(spelling.group_variants(no_documents)) == []
