"""Repeated windows against brute force, hot runs included."""

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import suffix


def plain_cut(rows):
    """doc -> (bytes, spans removed, bytes kept), by a set of all windows so far."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).tolist()
        out[doc] = (len(data), list(zip(edges[::2], edges[1::2], strict=True)), bytes(np.frombuffer(data, np.uint8)[~gone]))
    return out


def shuffled(batches, buckets, send, sort):
    """What Spark does with the packed entries, in this process."""
    parts = defaultdict(list)
    for b in batches:
        for rb in send(iter(b)):
            for i in range(rb.num_rows):
                parts[rb["bucket"][i].as_py()].append(rb.slice(i, 1))
    return [r for p in parts.values() for r in sort(pa.Table.from_batches(p)).to_pylist()]


@pytest.mark.parametrize(("hot_run", "hot_meet"), [(64, 5000), (2, 5000), (64, 3), (1, 1)])
def test_passes_equal_brute_force(monkeypatch, hot_run, hot_meet):
    monkeypatch.setattr(suffix, "HOT_RUN", hot_run)
    monkeypatch.setattr(suffix, "HOT_MEET", hot_meet)
    monkeypatch.setattr(suffix, "PIECE", 700)
    rng = np.random.default_rng(3)
    passage, other = ("".join(rng.choice(list("abcdefgh "), n)) for n in (260, 130))
    rows = []
    for i in range(60):
        head, tail = ("".join(rng.choice(list("abcdefgh "), int(n))) for n in rng.integers(0, 400, 2))
        rows.append((i, head + (passage if i % 3 else other) + tail))
    rows += [(60, rows[5][1]), (61, "ab" * 1200), (62, "x" * 99), (63, "x" * 250), (64, ""), (65, passage[1:-1])]
    table = [{"doc": d, "text": t} for d, t in rows]
    parts = [[pa.RecordBatch.from_pylist(table[i::4])] for i in range(4)]
    first = shuffled(parts, 5, suffix.anchor_entries(5), suffix.sort_anchors)
    spans = defaultdict(list)
    chosen = defaultdict(lambda: ([], []))
    for m in first:
        if m["kind"] == suffix.COVER:
            spans[m["doc"]].append((m["lo"], m["hi"]))
        else:
            chosen[m["doc"]][m["kind"] == suffix.SINGLE].append(m["lo"])
    todo = [{"doc": d, "text": t, "meet": chosen[d][0], "single": chosen[d][1]} for d, t in rows if d in chosen]
    kind = pa.schema([("doc", pa.int64()), ("text", pa.string()), ("meet", pa.list_(pa.int32())), ("single", pa.list_(pa.int32()))])
    parts = [[pa.RecordBatch.from_pylist(todo[i::3], schema=kind)] for i in range(3)]
    for m in shuffled(parts, 5, suffix.window_entries(5), suffix.sort_windows):
        spans[m["doc"]].append((m["lo"], m["hi"]))
    want = plain_cut(rows)
    for d, t in rows:
        got = suffix.spans_of(len(t), np.array([lo << 32 | hi for lo, hi in spans[d]], dtype=np.int64))
        assert [tuple(x) for x in got.tolist()] == want[d][1], d


def test_documents_equal_brute_force(documents):
    want = plain_cut([(r.doc_id, r.text) for r in documents.collect()])
    got = suffix.without_repeats(documents).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) == want[r.doc_id]


def test_odd_rows(odd_documents, no_documents):
    # an id counts once, with its smallest text; a null text is empty
    texts = {}
    for r in odd_documents.collect():
        texts[r.doc_id] = min(texts.get(r.doc_id, r.text or ""), r.text or "")
    got = {r.doc_id: r for r in suffix.without_repeats(odd_documents).collect()}
    want = plain_cut(list(texts.items()))
    assert {d: (r.n_bytes, bytes(r.kept)) for d, r in got.items()} == {d: (w[0], w[2]) for d, w in want.items()}
    cut = suffix.cut_documents(odd_documents)
    assert cut.columns == odd_documents.columns and cut.count() == odd_documents.count()
    by_id = {r.doc_id: r for r in cut.collect()}
    assert by_id[3].text is None and by_id[8].text == want[8][2].decode("utf-8", "ignore") and by_id[1].rank == "mine rank"
    assert suffix.without_repeats(no_documents).count() == 0 and suffix.cut_documents(no_documents).count() == 0


def test_kept_digest_of_the_query(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["op10_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = plain_cut([(r.doc_id, r.text) for r in docs])
    for r in rows:
        n, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (n, n - len(kept), len(spans))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_every_text_of_an_id_is_searched(spark):
    rng = np.random.default_rng(5)
    a, b, c, d = ("".join(rng.choice(list("abcdefgh "), n)) for n in (200, 220, 240, 260))
    rows = [(None, a), (None, a), (None, "x" + b), (1, b + "y"), (1, c), (1, c), (1, None), (2, "z" + c), (3, d), (3, "9" + d), (4, d + a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    documents = sorted([*rows[:5], *rows[6:]], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = {i: plain_cut([(j, t) for j, (_, t) in enumerate(documents)])[i] for i in range(len(documents))}
    got = [(r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in suffix.without_repeats(df, each_text=True).collect()]
    assert sorted(got, key=str) == sorted(((documents[i][0], w[0], tuple(w[1]), w[2]) for i, w in want.items()), key=str)
    left = [(r.doc_id, r.text) for r in suffix.cut_documents(df).collect()]
    kept = [(documents[i][0], None if documents[i][1] is None else w[2].decode()) for i, w in want.items()]
    assert sorted(left, key=str) == sorted([*kept, (1, c)], key=str)


def test_a_passage_in_every_text_is_spread():
    rng = np.random.default_rng(8)
    passage = "".join(rng.choice(list("abcdefgh "), 400))
    rows = [{"doc": i, "text": "".join(rng.choice(list("abcdefgh "), 60)) + passage} for i in range(8_000)]
    load = np.zeros(64)
    for rb in suffix.anchor_entries(64)(iter([pa.RecordBatch.from_pylist(rows)])):
        for bucket, d in zip(rb["bucket"].to_pylist(), rb["d"].to_pylist(), strict=True):
            load[bucket] += len(d) // 8
    assert load.sum() > 50_000 and load.max() <= 3 * np.median(load)
