"""Language identification by nearest centroids of normalised TF-IDF n-gram vectors.

A text's vector counts its byte n-grams (letters only, lower case) in ``DIMS`` hashed places, is
weighted by inverse document frequency and brought to length one. Each language has several
centroids, found by clustering its sample by cosine. The nearest centroid names the language; a
text that is much further from it than nearly all of the language's sample texts of its length class
is rejected.

Fitting takes a bounded sample, ``SAMPLE`` texts of each language chosen by the hash of doc_id, whose
repeats count once; prediction reads every whole text. Only the sample's vectors are gathered, one language per task;
the driver gets ``CENTROIDS`` vectors, document frequencies and a few distances per language.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; so is
every text if there is no labelled row to learn from; ties go to the smaller language name; a
length class that a language's sample lacks has the floor of the next longer one, or of the longest; a text of
fewer than ``JUDGED_GRAMS`` n-grams is not rejected; columns of the input that have the output's names are
replaced, other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.base import free_names, small_batches, stored
from gleaner.operators.keyed import top_per_group

SAMPLE = 400
CENTROIDS = 3
DIMS = 1 << 13
NGRAMS = (2, 3)
# A text is rejected below MARGIN times the cosine that this share of its language's sample at its length stays below.
MARGIN, LOW = 0.5, 0.01
# Texts of fewer n-grams say too little to be rejected.
JUDGED_GRAMS = 64
CLASSES = 64
UNKNOWN = "und"

# bytes that are no letters become blanks; bytes of other scripts stay
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of one whole text."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(LETTERS) + b" ", dtype=np.uint8)
    codes = raw.astype(np.uint32)
    out = np.zeros(DIMS, dtype=np.int64)
    n, run = 1, codes
    while n < max(NGRAMS):
        run = (run[:-1] << np.uint32(8)) | codes[n:]
        n += 1
        if n in NGRAMS:
            # runs of blanks say nothing
            some = run[run != np.uint32(int.from_bytes(b" " * n))]
            place = (some * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - DIMS.bit_length() + 1)
            out += np.bincount(place, minlength=DIMS)
    return out


def length_class(counts: np.ndarray) -> int:
    return int(counts.sum()).bit_length()


@dataclass
class Model:
    """What prediction needs; its size is set by the number of languages."""

    langs: list[str] = field(default_factory=list)  # of each centroid, sorted
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMS), np.float32))
    idf: np.ndarray = field(default_factory=lambda: np.ones(DIMS, np.float32))
    floors: np.ndarray = field(default_factory=lambda: np.zeros((0, CLASSES)))  # of each centroid, by length class

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine with its nearest centroid, rejected?"""
        if text is None or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True
        counts = ngram_counts(text)
        cosines = self.centroids @ unit(counts * self.idf)
        k = int(cosines.argmax())
        score = float(min(max(cosines[k], 0.0), 1.0))
        return self.langs[k], score, score < self.floors[k, length_class(counts)]


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit vectors by cosine; seeds are each the furthest from those before."""
    seeds = [int((x @ unit(x.sum(axis=0))).argmax())]
    while len(seeds) < min(k, len(x)):
        seeds.append(int((x @ x[seeds].T).max(axis=1).argmin()))
    centroids = x[seeds]
    for _ in range(rounds):
        nearest = (x @ centroids.T).argmax(axis=1)
        centroids = unit(np.stack([x[nearest == i].sum(axis=0) if (nearest == i).any() else centroids[i] for i in range(len(centroids))]))
    return centroids


def choose_sample(labelled: DataFrame, doc_id: str, text: str, lang: str, per_lang: int) -> DataFrame:
    """(lang, text) of ``per_lang`` rows of each language; texts of chosen rows only are moved."""
    id_, content = F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_content")
    ids = labelled.select(id_, content, F.col(lang).alias("_lang")).where("_id IS NOT NULL").distinct()
    ids = top_per_group(ids, ["_lang"], [F.xxhash64("_id"), F.col("_id"), F.col("_content")], per_lang)
    chosen = stored(ids.select("_id", "_content").distinct())
    rows = labelled.select(id_, content, F.col(lang).alias("lang"), F.col(text).alias("text"))
    return rows.join(chosen, ["_id", "_content"], "left_semi").dropDuplicates(["_id", "_content", "lang"]).select("lang", "text")


def floors(classes: list[int], scores: np.ndarray) -> np.ndarray:
    """Floor of every length class, none higher than a longer one's."""
    low = np.full(CLASSES, np.nan)
    for c in set(classes):
        low[c] = np.quantile(scores[np.array(classes) == c], LOW)
    longest = max(classes)
    low[longest + 1 :] = low[longest]
    low = np.fmin.accumulate(low[::-1])[::-1] * MARGIN
    low[: JUDGED_GRAMS.bit_length()] = 0
    return low


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learn from rows with a language and a text; others are left out."""
    small_batches(labelled.sparkSession)
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[[has_letter(t) for t in f["text"]]]
            yield pd.DataFrame({"lang": f["lang"], "counts": [ngram_counts(t).astype("<i4").tobytes() for t in f["text"]]})

    sample = choose_sample(labelled, doc_id, text, lang, per_lang)
    vectors = stored(sample.mapInPandas(count, "lang string, counts binary"))

    def matrix(f: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(f["counts"]), dtype="<i4").reshape(len(f), DIMS)

    def frequencies(f: pd.DataFrame) -> pd.DataFrame:
        seen = (matrix(f) > 0).sum(axis=0).astype("<i8")
        return pd.DataFrame({"n": [len(f)], "seen": [seen.tobytes()]})

    # one row per language
    rows = vectors.groupBy("lang").applyInPandas(frequencies, "n long, seen binary").collect()
    if not rows:
        return Model()
    total = sum(r["n"] for r in rows)
    seen = sum(np.frombuffer(r["seen"], dtype="<i8") for r in rows)
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)

    def learn(f: pd.DataFrame) -> pd.DataFrame:
        counts = matrix(f)
        x = unit(counts * idf)
        found = cluster(x, centroids)
        best = (x @ found.T).max(axis=1)
        low = floors([length_class(c) for c in counts], best)
        return pd.DataFrame({"lang": [f["lang"].iloc[0]], "k": [len(found)], "centroids": [found.astype("<f4").tobytes()], "low": [low.tobytes()]})

    rows = sorted(vectors.groupBy("lang").applyInPandas(learn, "lang string, k int, centroids binary, low binary").collect())
    return Model(
        [r["lang"] for r in rows for _ in range(r["k"])],
        np.concatenate([np.frombuffer(r["centroids"], dtype="<f4").reshape(-1, DIMS) for r in rows]),
        idf,
        np.stack([np.frombuffer(r["low"]) for r in rows for _ in range(r["k"])]),
    )


def judged(model: Model, text: Column) -> Column:
    """struct(lang_pred, score, rejected) of a text column."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.judge(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return of(text)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected."""
    small_batches(docs.sparkSession)
    (verdict,) = free_names(docs, "verdict")
    got = docs.withColumn(verdict, judged(model, F.col(text)))
    return got.withColumns({c: F.col(verdict)[c] for c in ("lang_pred", "score", "rejected")}).drop(verdict)


def fold(doc_id: Column) -> Column:
    """Held-out rows have fold 2: crc32 of doc_id as text, modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))
