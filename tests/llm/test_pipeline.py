"""The stages against plain versions of what they decide."""

import corpus_pipeline
from gleaner.llm import langid, packing
from gleaner.llm.base import stored
from test_mixing import plain_mix
from test_near_groups import plain_fingerprint, plain_groups
from test_packing import check_packed
from test_repeats import plain_cut

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages(spark, documents):
    docs = documents
    results = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER))
        results.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == documents.columns and docs.schema.simpleString() == documents.schema.simpleString()
    known, single, cut, mixed, packed = results

    model = langid.fit(documents.where("crc32(cast(cast(doc_id AS string) AS binary)) % 4 <> 2"))
    assert rows_of(known) == sorted((tuple(r) for r in documents.collect() if not model.judge(r.text)[2]), key=str)

    rows = known.collect()
    group = plain_groups([(r.doc_id, plain_fingerprint(r.text)) for r in rows])
    assert rows_of(single) == sorted((tuple(r) for r in rows if group[r.doc_id] == r.doc_id), key=str)

    rows = single.collect()
    want = plain_cut([(r.doc_id, r.text) for r in rows])
    got = {r.doc_id: r for r in cut.collect()}
    assert set(got) == set(want)
    assert all(want[d][2] == r.text.encode() and r.n_chars == len(r.text) for d, r in got.items() if want[d][2].decode("utf-8", "ignore").encode() == want[d][2])

    rows = cut.collect()
    times = {d: taken // max(size, 1) for (d, _, size), (_, taken) in plain_mix([(r.doc_id, r.text, r.source) for r in rows]).items() if size}
    have = {}
    for r in mixed.collect():
        have[r.doc_id] = have.get(r.doc_id, 0) + 1
    assert {d: n for d, n in have.items() if d in times} == {d: n for d, n in times.items() if n}

    check_packed(packed.collect(), mixed.collect(), packing.CAPACITY)
    assert rows_of(corpus_pipeline.run(spark, FOLDER)).__len__() == packed.count()


def test_odd_rows(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, FOLDER))
        assert "sequence_id" in docs.columns
