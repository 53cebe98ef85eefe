import bisect
from collections import Counter
from hashlib import sha256

import messy
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from cartograph.llm import alignment
from tokenizers import Tokenizer

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def byte_of_char() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def groups_of(a: Tokenizer, b, text: str):
    """Groups of (A ids, B ids), or None."""
    decode = byte_of_char()
    want = (" " + text).encode()
    left = a.encode(" " + text, add_special_tokens=False)
    right = b.encode(text)
    la = [bytes(decode[c] for c in t) for t in left.tokens]
    lb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in right]
    if b"".join(la) != want or b"".join(lb) != want:
        return None
    ea, eb = np.cumsum([len(x) for x in la]).tolist(), np.cumsum([len(x) for x in lb]).tolist()
    shared = sorted(set(ea) & set(eb))
    out = [([], []) for _ in shared]
    for ids, ends, side in ((left.ids, ea, 0), (right, eb, 1)):
        for i, e in zip(ids, ends):
            out[bisect.bisect_left(shared, e)][side].append(i)
    return out


def brute(docs) -> list[tuple]:
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = [(i, groups_of(a, b, t) if t else None) for i, t in docs]
    count = Counter(p for _, g in found if g for p in {(x, y) for xs, ys in g for x in xs for y in ys})
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for i, g in found:
        if not g:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = Counter()
        for xs, ys in g:
            for x, n in Counter(xs).items():
                for y, m in Counter(ys).items():
                    links[x, y] += n * m
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g)
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(links.values()),
                    sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()),
                    sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


HOSTILE = [(900, "x" * 5000), (901, "和" * 700 + " abc"), (902, "a▁b"), (903, "<s> </s> <0x41> <|endoftext|> <unk>"),
           (904, "  two  spaces \n\n"), (905, "🙂" * 50 + "é́"), (906, "\x00a"), (907, " "), (908, "ﬁ ＡＢ ½")]


@pytest.mark.parametrize("size", [{}, {"work": 16, "shard_bytes": 5000}, {"work": 2, "shard_bytes": 1}])
def test_equals_brute_force(spark, size):
    docs = messy.frame(spark, messy.rows(n=24) + [(i, t, "en", "a") for i, t in HOSTILE])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = alignment.align(docs, **size).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty_table_and_very_long_texts(spark):
    assert alignment.align(messy.empty(spark)).collect() == []
    # one long text of shared ends, and one whose groups reach over many pieces
    docs = [(1, "some words again " * 250_000), (2, "z" * 300_000), (3, "short")]
    got = alignment.align(messy.frame(spark, [(i, t, "en", "a") for i, t in docs])).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs)


def test_pieces_of_equal_work():
    rng = np.random.default_rng(5)
    for n, m, work in ((0, 0, 4), (1, 0, 4), (50, 3, 4), (400, 300, 7), (64, 64, 8)):
        ea = np.sort(rng.choice(2000, n, replace=False))
        eb = np.sort(rng.choice(2000, m, replace=False))
        i, j = alignment.diagonals(ea, eb, work)
        assert (i[0], j[0], i[-1], j[-1]) == (0, 0, n, m)
        for k in range(1, len(i) - 1):
            assert i[k] + j[k] - k * work in (0, 1)
            before, after = max([*ea[:i[k]], *eb[:j[k]]]), min([*ea[i[k]:], *eb[j[k]:], 10**9])
            assert before < after          # equal ends stay together
