import itertools
import random
import zlib
from collections import Counter, defaultdict

import messy
import numpy as np
import pytest
from cartograph.llm import packing
from cartograph.llm.tokens import END_OF_TEXT, encoder


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizers_library(reference):
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "a", "bc", "é", "1", "!", "'s", "\t", END_OF_TEXT, "😀", " ", "\x1f", "　", "don't", "\x85"]
    texts = ["", " lead", "trail ", "x" * 3000, END_OF_TEXT, f"a{END_OF_TEXT}b"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    for text in texts:
        assert encoder().ids(text) == reference.encode(text, add_special_tokens=False).ids
    assert encoder().ids(None) == []


def optimum(items, capacity):
    """Fewest bins, by trying all placements (small instances)."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room >= items[k]:
                rest = list(bins)
                rest[rest.index(room)] -= items[k]
                go(k + 1, rest)
        go(k + 1, [*bins, capacity - items[k]])

    go(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([6, 10, 17])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 9)))
        fixed, rest = packing.reduce_dominated(dict(counts), capacity)
        assert all(sum(items) <= capacity for _, items in fixed)
        left = list(itertools.chain.from_iterable([s] * c for s, c in rest.items()))
        assert sum(m for m, _ in fixed) + optimum(left, capacity) == optimum(list(counts.elements()), capacity)


def test_patterns_hold_every_item_once():
    rng = random.Random(5)
    for n in (1, 7, 300, 4000):
        for capacity in (10, 100, 1024):
            counts = Counter(rng.randint(1, capacity) for _ in range(n))
            patterns = packing.pack_counts(dict(counts), capacity)
            held = Counter()
            for m, items in patterns:
                assert m > 0 and sum(items) <= capacity
                for s in items:
                    held[s] += m
            assert held == counts
            bound = -(-sum(s * c for s, c in counts.items()) // capacity)
            assert bound <= sum(m for m, _ in patterns) <= 1.25 * bound + 1


def check_pieces(got, data, reference, capacity=1024):
    want = Counter()
    for doc_id, text, *_ in data:
        ids = reference.encode(text or "", add_special_tokens=False).ids + [2]
        start, k = 0, 0
        while start < len(ids):
            length = (len(ids) % capacity or capacity) if start == 0 else capacity
            want[(doc_id, k, start, length, zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes()))] += 1
            start, k = start + length, k + 1
    assert Counter(r[:5] for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r[5]].append((r[6], r[3]))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


def test_packed_pieces(spark, reference):
    data = messy.rows()
    got = [tuple(r) for r in packing.packed_pieces(messy.frame(spark)).collect()]
    sequences = check_pieces(got, data, reference)
    assert sequences <= -(-sum(r[3] for r in got) // 1024) * 1.1 + 1
    assert packing.packed_pieces(messy.empty(spark)).collect() == []


def test_sequences_round_trip(spark):
    p = packing.pack(messy.frame(spark))
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(p).collect()}
    rows = p.pieces.join(p.placements, ["part", "row_no"]).collect()
    assert len(whole) == p.sequences
    for r in rows:
        assert whole[r["sequence_id"]][4 * r["offset"]:4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    assert sum(map(len, whole.values())) == 4 * sum(r["length"] for r in rows)
