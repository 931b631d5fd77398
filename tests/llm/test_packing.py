"""Plans against bounds and exhaustive search; pieces against the tokenizer itself."""

import random
import zlib
from functools import lru_cache

import numpy as np
import pytest

from gleaner.llm import packing
from gleaner.llm.tokens import WordTokens


def fewest_bins(items, capacity):
    """By trying everything."""

    @lru_cache(None)
    def best(rest):
        if not rest:
            return 0
        first, others, low = rest[0], rest[1:], len(rest)
        n = len(others)
        for pick in range(1 << n):
            some = [others[i] for i in range(n) if pick >> i & 1]
            if first + sum(some) <= capacity:
                low = min(low, 1 + best(tuple(others[i] for i in range(n) if not pick >> i & 1)))
        return low

    return best(tuple(sorted(items, reverse=True)))


def histogram(items):
    return {x: items.count(x) for x in items}


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_whole_and_fits(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 37, 100, 2048])
    counts = {}
    for _ in range(rnd.choice([0, 1, 5, 40, 400])):
        counts[rnd.randint(1, capacity)] = rnd.choice([1, 2, 3, 10**9])
    plan, got = packing.pack_plan(counts, capacity), {}
    for bin_, n in plan:
        assert n > 0 and 0 < sum(length * k for length, k in bin_) <= capacity
        for length, k in bin_:
            got[length] = got.get(length, 0) + k * n
    assert got == counts
    assert len(plan) < 20 * (len(counts) + 1)
    ranks = {}
    for length, lo, hi, _, offset, each in packing.places(plan):
        assert lo == ranks.get(length, 0) and (hi - lo) % each == 0 and offset + each * length <= capacity
        ranks[length] = hi
    assert ranks == counts


@pytest.mark.parametrize("seed", range(30))
def test_dominance_never_costs_a_bin(seed):
    rnd = random.Random(seed)
    items = [rnd.randint(2, 20) for _ in range(9)]
    counts = histogram(items)
    fixed = packing.reduce_by_dominance(counts, 20)
    rest = [x for x, n in counts.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + fewest_bins(tuple(rest), 20) == fewest_bins(tuple(items), 20)


def test_lengths_out_of_range():
    with pytest.raises(ValueError, match="lengths"):
        packing.pack_plan({11: 1}, 10)


TEXTS = ["", "It's a test, isn't it? 123 ½ ²", "naïve CAFÉ Straße ÀÉ", "<|endoftext|>x<|startoftext|>", "ΑΣ σς Ǆ İ ﬁ", "漢字 かな　x\x85y\xa0z\x1cq", "é ́e à", "'s 're'll'x '’s", "\x00\x01 \t\r\n", "a" * 3000, "☃❤️👩‍👩‍👧 ok"]


def test_ids_are_the_tokenizers(documents):
    words = WordTokens(packing.public_tokenizer(), memo=50)
    texts = TEXTS + [r.text for r in documents.limit(60).collect()]
    want = words.tokenizer.encode_batch(texts, add_special_tokens=False)
    got = words.encode(texts[:30]) + words.encode(texts[30:])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in want]


def check_packed(rows, docs, capacity):
    words = WordTokens(packing.public_tokenizer())
    want = []
    for r in docs:
        ids = np.append(np.frombuffer(words.encode([r.text or ""])[0], "<u4"), 0).astype("<u4")
        want += [(r.doc_id, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())) for k in range(0, len(ids), capacity)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values(), default=0) <= capacity
    return filled


def test_documents_packed(documents):
    rows = packing.pack_documents(documents, packing.public_tokenizer()).collect()
    filled = check_packed(rows, documents.collect(), 2048)
    assert len(filled) <= -(-sum(filled.values()) // 2048) * 1.02 + 1


def test_odd_rows_and_real_sequences(odd_documents, no_documents):
    packed = packing.pack_documents(odd_documents, packing.public_tokenizer(), capacity=64, keep_ids=True)
    rows = packed.collect()
    filled = check_packed(rows, odd_documents.collect(), 64)
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert {s: len(r.ids) // 4 for s, r in whole.items()} == filled
    for r in rows:
        part = whole[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)]
        assert zlib.crc32(part) == r.ids_crc32
    assert packing.pack_documents(no_documents, packing.public_tokenizer()).count() == 0
