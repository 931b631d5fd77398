"""SimHash groups against brute force."""

import numpy as np
import pytest
import xxhash

from gleaner.llm import graph, simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, radius=4):
    """doc_id -> smallest doc_id reachable, by comparing all pairs."""
    known = [(d, fp) for d, fp in rows if d is not None]
    root = {d: d for d, _ in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(known):
        for b, y in known[i + 1 :]:
            if (x ^ y).bit_count() <= radius:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: find(d) for d, _ in known}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "Two words", "a b c d", "A b C d e f G h. Ünï a b c d", "x " * 5000])
def test_fingerprint(text):
    assert simhash.text_fingerprint(text) == plain_fingerprint(text)


def test_every_pair_within_the_radius_meets():
    rng = np.random.default_rng(1)
    for radius in (1, 4):
        masks = simhash.cover_masks(radius, simhash.first_vectors(radius))
        for _ in range(2000):
            bits = rng.choice(64, radius, replace=False)
            x = sum(1 << int(b) for b in bits)
            assert any(not x & m for m in masks)


def test_two_masks_leave_few_bits():
    first, second = (simhash.cover_masks(4, v(4)) for v in (simhash.first_vectors, simhash.second_vectors))
    assert max(64 - (a | b).bit_count() for a in first for b in second) <= 24


def test_groups_equal_brute_force(spark, documents):
    got = {r.doc_id: r for r in simhash.near_groups(documents).collect()}
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in documents.collect()]
    assert {d: r.fp & (2**64 - 1) for d, r in got.items()} == dict(rows)
    assert {d: r.component_id for d, r in got.items()} == plain_groups(rows)


@pytest.mark.parametrize("hot", [5, 20_000])
def test_dense_and_hot_buckets(spark, hot):
    # a cloud of near fingerprints, chains and noise; a small limit sends buckets to the second covering
    rng = np.random.default_rng(2)
    centre = int(rng.integers(0, 1 << 63))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(400)}
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 200)}
    rows = [(i, simhash.signed(x)) for i, x in enumerate(sorted(fps))]
    reps = spark.createDataFrame(rows, "rep long, fp long")
    links = simhash.near_links(reps, hot_bucket=hot)
    roots = {r.node: r.root for r in graph.components(links, "a", "b").collect()}
    want = plain_groups([(i, x & (2**64 - 1)) for i, x in rows])
    assert {i: roots.get(i, i) for i, _ in rows} == want


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {(r.node, r.root) for r in got} == {(i, 0) for i in range(1, 61)} | {(i, 100) for i in range(101, 160)}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_odd_rows(odd_documents, no_documents):
    rows = simhash.near_groups(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    group = {r.doc_id: r.component_id for r in rows}
    assert group[None] is None and group[4] == 1 and group[2] == group[3] == group[6] == 2 and group[5] == 5
    kept = simhash.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 2, 5, 7, 8, 9]
    assert simhash.near_groups(no_documents).count() == 0 and simhash.keep_one(no_documents).count() == 0


def test_unlike_texts_of_an_id_stay(spark):
    a, b = " ".join(f"alpha{i}" for i in range(80)), " ".join(f"beta{7 * i}" for i in range(80))
    df = spark.createDataFrame([(5, a), (5, a), (5, b), (6, b), (7, a)], "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.keep_one(df).collect()) == [(5, a), (5, b)]
