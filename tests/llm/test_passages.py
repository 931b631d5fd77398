"""Repeated word windows against brute force, hot anchors included."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import substrings


def plain_cut(texts):
    """Per text: (words, spans removed, text kept), from the counts of all windows."""
    words = [[w.decode() for w in (t or "").encode().split()] for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = np.zeros(len(w) + 1, bool)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8))))).tolist()
        out.append((len(w), list(zip(edges[::2], edges[1::2], strict=True)), " ".join(x for x, g in zip(w, gone, strict=False) if not g)))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_automaton_equals_brute_force(seed):
    r = random.Random(seed)
    strings = [[r.randrange(3) for _ in range(r.randrange(1, 15))] for _ in range(r.randrange(1, 8))]
    weights = [r.choice([1, 2]) for _ in strings]

    def places(sub):
        return sum(w for s, w in zip(strings, weights, strict=True) for i in range(len(s) - len(sub) + 1) if s[i : i + len(sub)] == sub)

    automaton = substrings.Automaton(strings, weights)
    for s in strings:
        want = [max(n for n in range(end + 1) if n == 0 or places(s[end - n : end]) >= 2) for end in range(1, len(s) + 1)]
        assert automaton.matching(s) == want
        covered = {p for e, n in enumerate(want, 1) if n >= 3 for p in range(e - n, e)}
        assert {p for lo, hi in substrings.long_matches(want, 3) for p in range(lo, hi)} == covered


def passage_texts(n=160):
    r = random.Random(4)

    def prose(k):
        return " ".join(r.choice(["a", "be", "see", "é", "of", "it"]) + str(r.randrange(40)) for _ in range(k))

    common, edge = prose(90), prose(34)
    texts = [prose(r.randrange(0, 60)) + " " + (common if i % 3 else edge) + "\n" + prose(r.randrange(0, 60)) for i in range(n)]
    texts += [texts[7], texts[7], "x " * 300, "a b " * 100, prose(34), common.split(" ", 1)[1], common.upper(), "", None, "\t\n"]
    return texts


@pytest.mark.parametrize(("hot_run", "hot_meet", "shard"), [(64, 2_000, 100_000), (2, 2_000, 100_000), (64, 3, 300), (1, 1, 1)])
def test_passes_equal_brute_force(hot_run, hot_meet, shard, monkeypatch):
    """All passes in this process, so that limits can be set low and the load per bucket be seen."""
    import pyarrow as pa

    monkeypatch.setattr(substrings, "HOT_RUN", hot_run)
    monkeypatch.setattr(substrings, "HOT_MEET", hot_meet)
    monkeypatch.setattr(substrings, "SHARD_WORDS", shard)
    monkeypatch.setattr(substrings, "PIECE", 900)
    monkeypatch.setattr(substrings, "POLYNOMIAL", substrings.Polynomial())
    texts = passage_texts()
    rows = [{"doc": i, "text": t or ""} for i, t in enumerate(texts)]

    def meet(batches, send, sort):
        parts = {}
        for b in batches:
            for rb in send(iter([b])):
                for i in range(rb.num_rows):
                    parts.setdefault(rb["bucket"][i].as_py(), []).append(rb.slice(i, 1))
        return [r for p in parts.values() for r in sort(pa.Table.from_batches(p)).to_pylist()]

    first = meet([pa.RecordBatch.from_pylist(rows[i::4]) for i in range(4)], substrings.stretch_entries(5, 500), substrings.meet_stretches)
    chosen = {}
    for m in first:
        if m["kind"] != substrings.COVER:
            chosen.setdefault(m["doc"], ([], []))[m["kind"] - 1].append(m["lo"] << 1 | m["hi"])
    todo = [{**r, "to_shard": chosen[r["doc"]][0], "to_windows": chosen[r["doc"]][1]} for r in rows if r["doc"] in chosen]
    kind = pa.schema([("doc", pa.int64()), ("text", pa.string()), ("to_shard", pa.list_(pa.int64())), ("to_windows", pa.list_(pa.int64()))])
    second = meet([pa.RecordBatch.from_pylist(todo[i::3], schema=kind) for i in range(3)], substrings.content_entries(5, 500), substrings.match_bucket)
    marks = {}
    for m in [m for m in first if m["kind"] == substrings.COVER] + second:
        marks.setdefault(m["doc"], []).append(m["lo"] << 32 | m["hi"])
    for i, (n, spans, _) in enumerate(plain_cut(texts)):
        got = substrings.spans_of(n, np.array(marks.get(i, []), dtype=np.int64))
        assert [tuple(s) for s in got.tolist()] == spans, i


def test_a_passage_in_every_text_is_spread():
    import pyarrow as pa

    r = random.Random(9)
    passage = " ".join(f"w{r.randrange(500)}" for _ in range(80))
    rows = [{"doc": i, "text": " ".join(f"n{r.randrange(10_000)}" for _ in range(20)) + " " + passage} for i in range(6_000)]
    load = Counter()
    for rb in substrings.stretch_entries(16)(iter([pa.RecordBatch.from_pylist(rows)])):
        for bucket, data, kind in zip(rb["bucket"].to_pylist(), rb["data"].to_pylist(), rb["kind"].to_pylist(), strict=True):
            load[bucket] += len(data) // (substrings.MARK if kind == substrings.COVERED else substrings.STRETCH).itemsize
    assert len(load) == 16 and max(load.values()) <= 3 * sorted(load.values())[8]


def test_documents_equal_brute_force(spark, documents):
    rows = documents.collect()
    want = {r.doc_id: w for r, w in zip(rows, plain_cut([r.text for r in rows]), strict=True)}
    got = substrings.without_passages(documents, per_bucket=100_000).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, [(s.start, s.end) for s in r.spans], r.kept) == want[r.doc_id]
    assert any(r.spans for r in got)


def test_odd_rows(spark, odd_documents, no_documents):
    texts = sorted({(r.doc_id is not None, r.doc_id or i, r.text or "") for i, r in enumerate(odd_documents.collect())})
    want = sorted((str(t[1] if t[0] else None), *map(str, w)) for t, w in zip(texts, plain_cut([t[2] for t in texts]), strict=True))
    got = substrings.without_passages(odd_documents).collect()
    assert sorted((str(r.doc_id), str(r.n_words), str([(s.start, s.end) for s in r.spans]), r.kept) for r in got) == want
    assert substrings.without_passages(no_documents).count() == 0


def test_texts_of_one_id_and_without_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    rows = [(1, a), (1, a), (1, b), (2, "c " + b), (None, a + " d"), (None, None)]
    got = substrings.without_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, 50, ""), (1, 50, ""), (2, 51, "c"), (None, 51, "d"), (None, 0, "")]
    assert sorted(map(str, [(r.doc_id, r.n_words, r.kept) for r in got])) == sorted(map(str, want))
    one = substrings.without_passages(spark.createDataFrame([(1, a), (1, a)], "doc_id long, text string").withColumn("marks", F.lit(1)))
    assert [(r.doc_id, r.kept) for r in one.collect()] == [(1, a)]
