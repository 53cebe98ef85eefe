import zlib
from hashlib import sha256

import duckdb
import messy
import pytest
from cartograph.llm import merkle
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(s: str) -> str:
    return sha256(s.encode()).hexdigest()


def leaf_of(row, bump=0) -> str:
    n = None if row["n_chars"] is None else row["n_chars"] + bump
    out = ""
    for v in (row["doc_id"], row["source"], row["lang"], n, row["text"]):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(out)


def climb(nodes: list[str]) -> tuple[str, list[list]]:
    """Root and, per node, the sibling (or None) of every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            paths[i].append((p & 1, nodes[p ^ 1] if p ^ 1 < len(nodes) else None))
        nodes = [h("".join(nodes[k:k + 2])) for k in range(0, len(nodes), 2)]
        at = [p >> 1 for p in at]
    return nodes[0], paths


def brute(rows) -> list[tuple]:
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), r))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    done = {}
    for lang in order:
        trees[lang].sort(key=lambda x: x[:3])
        done[lang] = climb([x[2] for x in trees[lang]])
    root, tops = climb([done[x][0] for x in order])
    out = []
    for lang, top in zip(order, tops):
        for (_, _, leaf, r), path in zip(trees[lang], done[lang][1]):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node = leaf_of(r, 1) if tampered else leaf
            for right, other in path + top:
                node = h(node if other is None else other + node if right else node + other)
            proof = h("".join(o for _, o in path + top if o is not None))
            out.append((r["doc_id"], leaf, done[lang][0], root, proof, node, node == root))
    return sorted(out, key=str)


def answer(df) -> list[tuple]:
    return sorted([tuple(r) for r in df.select(*COLUMNS).collect()], key=str)


@pytest.mark.parametrize("height", [1, 3, 12])
def test_equals_plain_trees(spark, height):
    docs = messy.frame(spark)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    rows = merkle.folded(merkle.manifest(docs, tampered, height))
    got = answer(rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.concat("witness", "witness2"), 256).alias("proof_sha256"),
                             "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")))
    assert got == brute(docs.collect())


def test_digest_and_sql_agree(spark):
    docs = messy.frame(spark)
    want = brute(docs.collect())
    assert answer(merkle.digest(docs)) == want
    documents = docs.select("doc_id", "text", "lang", "source", "n_chars").toArrow()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    got = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({merkle.ORACLE})").fetchall()
    assert sorted(got, key=str) == want


def test_only_tampered_documents_fail(spark):
    docs = messy.frame(spark, [(i, f"text {i}", "en", "a") for i in range(300)])
    for r in merkle.digest(docs).collect():
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0)


def test_small_tables(spark):
    assert merkle.digest(messy.empty(spark)).collect() == []
    one = answer(merkle.digest(messy.frame(spark, [(3, "x", None, None)])))
    assert one[0][1] == one[0][2] == one[0][3] == one[0][5] and one[0][4] == h("")
    nulls = messy.frame(spark, [(None, None, None, None)] * 3 + [(5, "", "de", "")] * 2)
    assert answer(merkle.digest(nulls)) == brute(nulls.collect())


def test_very_long_text(spark):
    docs = messy.frame(spark, [(1, "long words " * 500_000, "en", "a"), (2, "x" * 5_000_000, "en", "a")])
    assert answer(merkle.digest(docs)) == brute(docs.collect())


def test_partial_witnesses_grow_with_the_stream():
    nodes = [h(str(i)).encode() for i in range(11)]
    a = merkle.Appender()
    for k, node in enumerate(nodes, 1):
        a.append(node)
        assert [x[0] for x in a.open] == [b for b in range(4, -1, -1) if k >> b & 1]     # a binary counter
    root, witness = a.finish(merkle.levels(11))
    for i, w in enumerate(witness):
        assert merkle.fold(nodes[i], w, i, 11) == (root, b"")
    assert root.decode() == climb([n.decode() for n in nodes])[0]
