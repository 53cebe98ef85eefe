import math
import zlib
from collections import Counter

import messy
import numpy as np
import pytest
from cartograph.llm import pitmanyor
from cartograph.llm.common import read_table

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def exact_tables(c, others, p, discount, strength) -> dict[int, float]:
    """Distribution of a dish's tables, all seatings added up."""
    weight = {1: (strength + discount * others) * p}
    for n in range(1, c):
        new = Counter()
        for t, x in weight.items():
            new[t] += x * (n - discount * t)
            new[t + 1] += x * (strength + discount * (others + t)) * p
        scale = sum(new.values())
        weight = {t: x / scale for t, x in new.items()}
    total = sum(weight.values())
    return {t: x / total for t, x in weight.items()}


@pytest.mark.parametrize("c, others, p", [(1, 3, .2), (2, 0, .3), (5, 7, .2), (12, 3, .5), (40, 10, .05)])
def test_seating_follows_its_conditional(c, others, p):
    n = 20_000
    t = pitmanyor.sample_tables(np.full(n, c), np.full(n, float(others)), np.full(n, p), .6, 1., np.random.default_rng(1), 10, 1)[0]
    share = np.bincount(t, minlength=c + 1) / n
    for k, x in exact_tables(c, others, p, .6, 1.).items():
        assert abs(share[k] - x) < 0.015


@pytest.mark.parametrize("c, others, p", [(300, 20, .02), (1000, 100, .2), (1000, 3, .9), (100, 5, .1)])
def test_seating_in_blocks_is_close(c, others, p):
    t = pitmanyor.sample_tables(np.full(3000, c), np.full(3000, float(others)), np.full(3000, p), .6, 1., np.random.default_rng(3), 10, 1)[0]
    want = exact_tables(c, others, p, .6, 1.)
    assert abs(t.mean() / sum(k * x for k, x in want.items()) - 1) < 0.03


def test_many_customers_cost_little():
    c = np.array([10**9, 3, 10**6])
    t = pitmanyor.sample_tables(c, np.zeros(3), np.full(3, 1e-3), .5, 1., np.random.default_rng(2), 2, 2)
    assert t.shape == (2, 3) and (t >= 1).all() and (t <= c).all()


def plain(docs) -> list[tuple]:
    """All columns but the score."""
    words = [(t or "").encode().translate(LOWER).split() for _, t in docs]
    out_ = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in docs]
    count = Counter(w for ws, o in zip(words, out_) if not o for w in ws)
    trained = len(out_) - sum(out_)
    n, v = sum(count.values()) + trained, len(count) + (trained > 0)
    f = lambda c: math.log10((c + .1) / (n + .1 * (v + 1)))
    return sorted([(i, o, len(ws) + 1, sum(count[w] > 0 for w in ws) + (trained > 0), n,
                    round(sum(f(count[w]) for w in ws) + f(trained), 6)) for (i, _), ws, o in zip(docs, words, out_)], key=str)


def answer(rows) -> list[tuple]:
    return sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows], key=str)


@pytest.mark.parametrize("size", [{}, {"shard_bytes": 3000, "bucket": 500}])
def test_counts_and_base_score(spark, size):
    docs = messy.frame(spark)
    rows = pitmanyor.language_scores(docs, **size).collect()
    assert answer(rows) == plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)


def test_scores_are_a_distribution(spark):
    # all words after one context, the end and one unknown word add up to one
    # (samples' averages are compared, so the sum is exact up to 32-bit storage)
    train = [(i, "a b a c a a d", "en", "x") for i in range(40) if zlib.crc32(str(i).encode()) % 10]
    held = [i for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    words = ["a", "b", "c", "d", "new"]
    probe = [(i, f"a {w}", "en", "x") for i, w in zip(held, words)] + [(held[5], "a", "en", "x")]
    got = {r["doc_id"]: r for r in pitmanyor.language_scores(messy.frame(spark, train + probe)).collect()}
    begin_a_end = got[held[5]]["score"]
    # P(a w end) / P(end | w) is not at hand, so the two-token text bounds the sum: P(w | a) >= P(a w end) / P(a)
    assert sum(10 ** got[i]["score"] for i in held[:5]) + 10 ** begin_a_end <= 1.0
    assert got[held[0]]["n_known"] == 3 and got[held[4]]["n_known"] == 2
    assert got[held[1]]["score"] > got[held[4]]["score"]


def brute_probability(train: list[list[str]], text: list[str], discount: float, strength: float, rounds: int, seed: int) -> float:
    """The same model by plain one-customer Gibbs sampling, averaged over many rounds."""
    rng = np.random.default_rng(seed)
    vocab = {w for d in train for w in d} | {"</s>"}
    pairs = Counter()
    for d in train:
        for u, w in zip(["<s>", *d], [*d, "</s>"]):
            pairs[u, w] += 1
    seats = {k: [1] * 0 for k in pairs}
    root: dict[str, list[int]] = {w: [] for w in vocab}
    base = 1 / (len(vocab) + 1)

    def p_root(w):
        c, t = sum(map(sum, root.values())), sum(map(len, root.values()))
        own = root.get(w, [])
        return (sum(own) - root_discount * len(own) + (strength + root_discount * t) * base) / (strength + c)

    def sit(tables, new, d):
        weights = np.array([*[s - d for s in tables], new])
        k = int(rng.choice(len(weights), p=weights / weights.sum()))
        if k == len(tables):
            tables.append(1)
            return True
        tables[k] += 1
        return False

    def leave(tables):
        k = int(rng.choice(len(tables), p=np.array(tables) / sum(tables)))
        tables[k] -= 1
        if not tables[k]:
            tables.pop(k)
            return True
        return False

    def sit_root(w):
        sit(root[w], (strength + root_discount * sum(map(len, root.values()))) * base, root_discount)

    def restaurant(u):
        return [k for k in seats if k[0] == u]

    def sit_pair(u, w):
        t = sum(len(seats[k]) for k in restaurant(u))
        if sit(seats[u, w], (strength + discount * t) * p_root(w), discount):
            sit_root(w)

    root_discount = discount
    for (u, w), n in pairs.items():
        for _ in range(n):
            sit_pair(u, w)
    total, used = 0.0, 0
    for r in range(rounds):
        for (u, w), n in pairs.items():
            for _ in range(n):
                if leave(seats[u, w]):
                    leave(root[w])
                sit_pair(u, w)
        if r >= rounds // 3:
            value = 0.0
            for u, w in zip(["<s>", *text], [*text, "</s>"]):
                w_known = w if w in vocab else "<new>"
                mine = restaurant(u)
                c, t = sum(sum(seats[k]) for k in mine), sum(len(seats[k]) for k in mine)
                own = seats.get((u, w), [])
                value += math.log10((sum(own) - discount * len(own) + (strength + discount * t) * p_root(w_known)) / (strength + c))
            total, used = total + value, used + 1
    return total / used


def test_close_to_one_by_one_gibbs(spark, monkeypatch):
    monkeypatch.setattr(pitmanyor, "discount_of", lambda one, two: 0.5)
    texts = ["a b a c", "b a d a", "a a b", "c d a b a", "a b", "d c b a b"] * 2
    ids = [i for i in range(500) if zlib.crc32(str(i).encode()) % 10][:len(texts)]
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    probe = ["a b a", "d d new", "c"]
    rows = [(i, t, "en", "x") for i, t in zip(ids, texts)] + [(i, t, "en", "x") for i, t in zip(held, probe)]
    got = {r["doc_id"]: r["score"] for r in pitmanyor.language_scores(messy.frame(spark, rows), sweeps=30, samples=30, rounds=2).collect()}
    for i, t in zip(held, probe):
        want = brute_probability([x.split() for x in texts], t.split(), 0.5, 1.0, 90, 4)
        assert abs(got[i] - want) < 0.05 * (len(t.split()) + 1)


def test_held_out_texts_are_predicted_better_than_by_counts(spark):
    rows = pitmanyor.language_scores(read_table(spark, "/root/testdata/sf0.01", "documents")).collect()
    held = [r for r in rows if r["held_out"]]
    per = lambda c: sum(r[c] for r in held) / sum(r["n_tokens"] for r in held)
    assert per("score") > per("base_score") + 0.5


def test_empty_and_untrained(spark):
    assert pitmanyor.language_scores(messy.empty(spark)).collect() == []
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    for r in pitmanyor.language_scores(messy.frame(spark, [(i, "a b", "en", "x") for i in held])).collect():
        assert (r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)


def test_very_long_texts(spark):
    docs = [(1, "one two three " * 400_000), (2, "y" * 5_000_000), (3, "one two")]
    rows = pitmanyor.language_scores(messy.frame(spark, [(i, t, "en", "a") for i, t in docs])).collect()
    assert [r[:5] for r in answer(rows)] == [r[:5] for r in plain(docs)]
    for got, want in zip(answer(rows), plain(docs)):
        assert math.isclose(got[5], want[5], rel_tol=1e-9)


@pytest.mark.parametrize("n", [0, 1, 5, 40_000])
def test_bundles_are_read_back(n):
    rng = np.random.default_rng(n)
    first = np.sort(rng.integers(0, 2**32, n, dtype=np.uint64)).astype("<u4")
    count, share = rng.integers(-3, 2**40, n), rng.random(n).astype("<f4")
    blob = pitmanyor.bundle(first, count, share)
    for times in (1, 2):
        got = pitmanyor.unbundle([blob] * times, "<u4", "<i8", "<f4")
        assert all((a == np.tile(b, times)).all() and len(a) == n * times for a, b in zip(got, (first, count, share)))
    assert [len(x) for x in pitmanyor.unbundle([], "<u4", "<i8")] == [0, 0]


def test_requests_hold_every_pair_of_known_words_once():
    u, w = (np.random.default_rng(k).integers(0, 50, 3000).astype(np.uint64) for k in (1, 2))
    one = np.unique(u << np.uint64(32) | w)
    places, cut, buckets = pitmanyor.requests(one, 7)
    known = ((one >> np.uint64(32)) != pitmanyor.UNKNOWN) & ((one & np.uint64(0xFFFFFFFF)) != pitmanyor.UNKNOWN)
    assert sorted(places.tolist()) == np.flatnonzero(known).tolist()
    for b, x, y in zip(buckets, cut, cut[1:]):
        assert (pitmanyor.bucket_of(one[places[x:y]], 7) == b).all() and (np.diff(one[places[x:y]].astype(np.int64)) > 0).all()
    assert len(set(buckets.tolist())) == len(buckets) == len(cut) - 1


def test_words_are_split_at_ascii_blanks_only(spark):
    text = " Az\x0bB\x0c\x1fc\x85 À d\t\n\r\x00 "
    held = next(i for i in range(500) if zlib.crc32(str(i).encode()) % 10)
    rows = pitmanyor.language_scores(messy.frame(spark, [(held, text, "en", "x")])).collect()
    assert answer(rows) == plain([(held, text)]) and rows[0]["n_tokens"] == len(text.encode().translate(LOWER).split()) + 1


def test_tables_are_sampled_again_after_an_exchange(spark, monkeypatch):
    # with one round no dish was ever seated given sampled tables of the others
    seen = []
    plain_sampled = pitmanyor.sampled

    def spy(state, facts, number, discount, strength, sweeps, samples, reply):
        seen.append((number, sweeps, samples, reply))
        return plain_sampled(state, facts, number, discount, strength, sweeps, samples, reply)

    monkeypatch.setattr(pitmanyor, "sampled", spy)
    docs = messy.frame(spark, [(i, "a b a c a a b", "en", "x") for i in range(30)])
    assert pitmanyor.language_scores(docs).count() == 30
    assert [(n, last) for n, _, _, last in seen] == [(1, False), (2, True)] and all(s >= 3 for _, s, _, _ in seen)


def test_every_sample_has_its_own_sweeps(monkeypatch):
    calls = []
    plain_seat = pitmanyor.seat
    monkeypatch.setattr(pitmanyor, "seat", lambda *x: calls.append(1) or plain_seat(*x))
    pitmanyor.sample_tables(np.full(4, 5), np.zeros(4), np.full(4, .2), .5, 1., np.random.default_rng(1), 3, 3)
    assert len(calls) == 1 + 3 * 3


@pytest.mark.parametrize("n", [0, 1, 5, 40_000])
def test_distinct_pairs_and_their_places(n):
    import tracemalloc
    pair = np.random.default_rng(n).integers(0, max(1, n // 3), n).astype(np.uint64) << np.uint64(33)
    tracemalloc.start()
    one, of = pitmanyor.distinct(pair)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want, places = np.unique(pair, return_inverse=True)
    assert (one == want).all() and (of == places).all() and len(of) == n
    assert most < 30 * n + 20_000        # np.unique takes about 50 bytes a pair


def test_second_customer_is_weighed_once(monkeypatch):
    # the second customer's chances do not depend on a seating, but every sweep worked them out again
    calls = []
    plain = pitmanyor.rates
    monkeypatch.setattr(pitmanyor, "rates", lambda *x: calls.append(1) or plain(*x))
    pitmanyor.sample_tables(np.full(4, 2), np.zeros(4), np.full(4, .2), .5, 1., np.random.default_rng(1), 3, 3)
    assert len(calls) == 1


def test_words_that_occur_once_are_counted_and_not_joined(spark, monkeypatch):
    seen = []
    plain = pitmanyor.rooted

    def spy(words, sums, discount, total, *rest):
        out, root = plain(words, sums, discount, total, *rest)
        seen.append(({r["cu"] for r in words.where("id >= 3").collect()}, total["single"], root["k"]))
        return out, root

    monkeypatch.setattr(pitmanyor, "rooted", spy)
    rows = [(i, f"a b once{i} a b", "en", "x") for i in range(40)]
    trained = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 10]
    got = pitmanyor.language_scores(messy.frame(spark, rows)).collect()
    assert all(r["n_known"] == (6 if r["doc_id"] in trained else 5) and r["score"] < 0 for r in got)
    for counts, single, k in seen:
        # every word that occurs once has one customer in the parent
        assert counts == {2 * len(trained)} and single == len(trained) and min(k) > single


def test_few_numbers_are_ordered_as_a_stable_sort_does():
    rng = np.random.default_rng(4)
    for high in (1, 50, 1 << 16, 1 << 20):
        x = rng.integers(0, high, 3_000)
        assert (pitmanyor.by_few(x) == np.argsort(x, kind="stable")).all()
    assert len(pitmanyor.by_few(np.zeros(0, np.int64))) == 0


def test_chances_of_the_third_customer_are_those_of_the_tables_there():
    c = np.array([9, 4, 3, 2])
    others, p = np.array([5.0, 0, 2, 7]), np.array([0.3, 0.01, 0.9, 0.5])
    opening = pitmanyor.early(c, others, p, 0.6, 1.0)
    assert {k: len(v[0]) for k, v in opening.items()} == {(1, 1.0): 4, (2, 1.0): 3, (2, 2.0): 3}
    for (n, tables), (new, total, tilt, logs) in opening.items():
        k = len(new)
        want = pitmanyor.rates(c[:k], others[:k], p[:k], np.full(k, tables), n, 0.6, 1.0)
        assert all((a == b).all() for a, b in zip((new, total, tilt), want)) and (logs == np.log(total)).all()


def test_shards_words_travel_in_one_row_and_a_bundle_per_bucket(spark):
    # before, every word of every shard was a row of its own, sorted by the JVM
    docs = messy.frame(spark)
    read = pitmanyor.tokenised(docs, shard_bytes=3000).localCheckpoint()
    rows = read.where("kind = 1").collect()
    assert len(rows) == len({r["shard"] for r in rows}) > 5 and sum(r["n"] for r in rows) > 100 * len(rows)
    dealt = pitmanyor.dealt(read.where("kind = 1").select("shard", "ids"), 7).localCheckpoint()
    keys = [(r["shard"], r["bucket"]) for r in dealt.collect()]
    assert len(keys) == len(set(keys)) and {b for _, b in keys} == set(range(7))
    lex = pitmanyor.lexicon(dealt).collect()
    count = Counter(w for r in docs.collect() if zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 10
                    for w in (r["text"] or "").encode().translate(LOWER).split())
    totals = [r for r in lex if r["kind"] == 2]
    assert len(totals) == 7 and sum(r["number"] for r in totals) == len(count) and sum(r["c"] for r in totals) == sum(count.values())
    assert sum(r["single"] for r in totals) == sum(c == 1 for c in count.values())
    assert sorted(r["c"] for r in lex if r["kind"] == 1) == sorted(c for c in count.values() if c > 1)
    words = {r["shard"]: 0 for r in rows}
    for r in lex:
        if r["kind"] == 0:
            place, number, c = pitmanyor.unbundle([r["x"]], "<u4", "<u4", "<i8")
            assert ((number == pitmanyor.NEVER) == (c == 0)).all() and len(set(place.tolist())) == len(place)
            words[r["shard"]] += len(place)
    assert words == {r["shard"]: r["n"] for r in rows}


def test_equal_words_have_equal_hashes_wherever_they_stand():
    rng = np.random.default_rng(5)
    some = [b"a", b"ab", b"ba", b"\x00", b"\x00\x00", b"x" * 2_500_000] + [b"w%d" % k for k in range(300_000)]
    words = [some[k] for k in rng.permutation(len(some))] + some
    got = pitmanyor.word_hash(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], "<u4"))
    by = {}
    for w, h in zip(words, got.tolist()):
        by.setdefault(w, set()).add(h)
    assert all(len(h) == 1 for h in by.values()) and len({h for s in by.values() for h in s}) == len(some)
    share = np.bincount(pitmanyor.bucket_of(got, 20), minlength=20) / len(got)
    assert abs(share - 0.05).max() < 0.005
    assert len(pitmanyor.word_hash(np.zeros(0, np.uint8), np.zeros(0, "<u4"))) == 0
