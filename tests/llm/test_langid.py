"""Held-out accuracy, rejection and odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gleaner.llm import langid


def test_held_out_accuracy(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in entry.queries()["op6_language_id"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in docs)
    held = [(r.lang, got[r.doc_id]) for r in docs if got[r.doc_id].held_out]
    assert len(held) > 100 and np.mean([lang == r.lang_pred for lang, r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([r.rejected for r in got.values()]) < 0.02


def test_prediction_uses_the_text_only(spark, documents):
    model = langid.fit(documents)
    shown = langid.identify(documents, model)
    hidden = langid.identify(documents.select("text").withColumn("lang", F.lit("xx")), model)
    assert sorted((r.lang_pred, r.score) for r in shown.collect()) == sorted((r.lang_pred, r.score) for r in hidden.collect())
    assert model.langs == sorted(model.langs) and len(set(model.langs)) == 4
    assert len(model.langs) == 4 * langid.CENTROIDS


def test_far_texts_are_rejected(documents):
    model = langid.fit(documents)
    far = "漢字仮名交じり文のテキストで、学習した言語とは似ていない。" * 20
    assert model.judge(far)[2] and not model.judge(documents.where("lang = 'en' AND n_chars > 500").first().text)[2]
    assert model.judge(None) == model.judge("") == model.judge("12 !? $") == ("und", 0.0, True)


def test_nearest_centroid_by_brute_force(documents):
    """Counts, weights and cosines again, with plain dictionaries and sums."""
    rows = [r for r in documents.orderBy("doc_id").collect()]
    model = langid.fit(documents)

    def grams(text):
        raw = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in b" " + text.lower().encode() + b" ")
        out = Counter()
        for n in (2, 3):
            for g in (raw[i : i + n] for i in range(len(raw) - n + 1)):
                if g.strip():
                    out[(int.from_bytes(g) * 2654435761 + n * 40503) % 2**32 >> 19] += 1
        return out

    seen = Counter(place for r in rows if r.lang and r.text for place in grams(r.text))
    total = sum(1 for r in rows if r.lang and r.text and any(map(str.isalpha, r.text)))
    assert total <= 4 * langid.SAMPLE and langid.DIMS == 2**13
    idf = {place: math.log((1 + total) / (1 + n)) + 1 for place, n in seen.items()}
    assert all(abs(model.idf[place] - x) < 1e-5 for place, x in idf.items())
    for r in rows[:60]:
        weights = {place: n * float(model.idf[place]) for place, n in grams(r.text).items()}
        norm = math.sqrt(sum(x * x for x in weights.values()))
        cosines = [sum(x * float(c[place]) for place, x in weights.items()) / norm for c in model.centroids]
        lang, score, _ = model.judge(r.text)
        assert abs(score - max(cosines)) < 1e-4
        assert lang in {model.langs[k] for k, c in enumerate(cosines) if c > max(cosines) - 1e-4}


def test_foreign_texts_and_noise_go_clean_ones_stay(documents):
    model = langid.fit(documents)
    foreign = {
        "it": "Nel mezzo del cammino di nostra vita mi ritrovai per una selva oscura, ché la diritta via era smarrita. Ahi quanto a dir qual era è cosa dura. ",
        "pl": "Litwo, ojczyzno moja! ty jesteś jak zdrowie; ile cię trzeba cenić, ten tylko się dowie, kto cię stracił. Dziś piękność twą w całej ozdobie widzę. ",
        "noise": "xqzv kjwp zzqx vbkq wxyj qqpz xkcd jvbz zwqk pxqj kvzx ",
        "code": "for(i=0;i<n;++i){x[i]=f(y[i]);}return_ptr->next=malloc(sizeof(struct_t)); ",
    }
    for text in foreign.values():
        assert model.judge(text * 5)[2]
    assert not model.judge("Erinst resh.")[2] and not model.judge("Osrañ.")[2]
    clean = [r.text for r in documents.where("lang IS NOT NULL AND n_chars > 200").collect()]
    assert np.mean([model.judge(t)[2] for t in clean]) <= 0.01


def test_floors():
    low = langid.floors([8, 8, 10, 12], np.array([0.4, 0.4, 0.2, 0.8]))
    assert np.allclose(low[[0, 6, 7, 8, 10, 11, 63]], np.array([0.0, 0.0, 0.2, 0.2, 0.2, 0.8, 0.8]) * langid.MARGIN)


def test_an_id_on_many_rows_does_not_fill_the_sample(spark):
    rows = [(1, f"word {i % 30} again", "en") for i in range(900)] + [(i, f"wort {i} hier", "de") for i in range(2, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = Counter(r.lang for r in langid.choose_sample(df, "doc_id", "text", "lang", 20).collect())
    assert got == {"en": 20, "de": 20}


def test_odd_rows(odd_documents, no_documents):
    model = langid.fit(odd_documents)
    got = langid.identify(odd_documents, model)
    rows = got.collect()
    assert len(rows) == odd_documents.count() and set(odd_documents.columns) < set(got.columns)
    assert {r.lang_pred for r in rows if r.text is None or not any(map(str.isalpha, r.text))} == {"und"}
    assert {r.lang_pred for r in rows if r.text and any(map(str.isalpha, r.text))} <= {"en", "de", "fr"}
    assert langid.identify(no_documents, model).count() == 0
    blind = langid.fit(no_documents)
    assert {r.lang_pred for r in langid.identify(odd_documents, blind).collect()} == {"und"}


def test_vectors_cover_whole_texts():
    text = "abc " * 1000
    assert langid.ngram_counts(text + "zzz").sum() > langid.ngram_counts(text).sum()
    assert (langid.ngram_counts("ABC, abc!") == langid.ngram_counts("abc  abc ")).all()
