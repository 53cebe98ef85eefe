"""A small table with everything that goes wrong: nulls, empties, ties, repeats, clashing columns."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 2**63 - 1
NAMES = ["score", "fp", "copies", "size", "row", "rows", "d", "h", "b", "rank", "part", "key", "n", "kept", "text_hash", "component_id"]
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(n, T.StringType()) for n in NAMES]])


def rows(seed: int = 3, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocab = ["the", "of", "Alpha", "béta", "gamma.", "x", "和", "delta,"] + [f"w{i}" for i in range(40)]
    sent = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, lines = sent(30), [sent(rng.randint(1, 12)) for _ in range(12)]
    out = []
    for i in range(n):
        text = "\n".join([sent(rng.randint(1, 40)) for _ in range(rng.randint(1, 4))])
        kind = i % 8
        if kind == 1:
            text = sent(9) + " " + passage + "\t" + sent(5)
        elif kind == 2:
            a = rng.randint(0, 8)
            text = "\n".join([sent(3), *lines[a:a + rng.randint(2, 5)], "", sent(2)])
        elif kind == 3:
            text = out[rng.randrange(len(out))][1]
        elif kind == 4:
            text = " ".join(["la"] * rng.randint(1, 70))
        out.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "é", None])))
    out += [(100, None, "en", "a"), (101, "", None, None), (102, " \t\n ", "en", "b"), (103, "\n\n", "en", "b"),
            (None, "orphan text " + passage, "en", "a"), (None, "orphan text " + passage, "en", "a"), (None, None, None, None),
            (104, lines[0] + "\n" + lines[1], "en", "b"), (104, lines[0] + "\n" + lines[1], "en", "b"), (104, "other text", "en", "b"),
            (105, " ".join(f"long{rng.randint(0, 3000)}" for _ in range(30000)) + "\n" + passage, "en", "b"),
            (106, "a  b   c \x1c d\x0b\x0ce <|endoftext|> f", "en", "c"), (107, "x" * 5000, "en", "c")]
    return out


def frame(spark, data: list[tuple] | None = None):
    data = rows() if data is None else data
    full = [(*r, None if r[1] is None else len(r[1]), *(["clash"] * len(NAMES))) for r in data]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def crash_key(doc_id):
    return LAST if doc_id is None else doc_id
