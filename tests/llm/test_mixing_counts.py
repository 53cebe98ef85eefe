import tempfile
from collections import Counter

import messy
import pytest
from cartograph.llm import mixing, tokencounts
from cartograph.llm.common import read_table
from cartograph.llm.tokens import MODEL, encoder

SF = "/root/testdata/sf0.01"


def water_level(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=str.encode) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = (total - cap * sum(sizes[s] for s in full)) / max(sum(w[s] for s in rest), 1e-12)
        new = {s for s in rest if level * w[s] > cap * sizes[s] + 1e-9}
        if not new:
            return {s: cap * sizes[s] if s in full else level * w[s] for s in names}
        full |= new


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 1000}, {"a": 1, "b": 1, "c": 1, "d": 500, None: 40}, {"z": 5}, {"a": 0, "b": 7}, {"a": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    for s, want in water_level(sizes).items():
        assert got[s] == pytest.approx(want)


def test_mix_contract(spark):
    docs = read_table(spark, SF, "documents")
    rows = mixing.digest(docs).collect()
    text = {r["doc_id"]: (r["source"], len(messy.WORD.findall(r["text"] or ""))) for r in docs.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    sizes, taken, target, largest = Counter(), Counter(), {}, Counter()
    for s, n in text.values():
        sizes[s] += n
        largest[s] = max(largest[s], n)
    want = water_level(dict(sizes))
    for r in rows:
        s, n = text[r["doc_id"]]
        assert r["size"] == n and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 3 * n and (n == 0 or r["taken"] % n == 0)
        taken[s] += r["taken"]
        target[s] = r["target"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * largest[s]
    assert sorted(rows) == sorted(mixing.digest(docs.repartition(7)).collect())


def test_systematic_crosses_each_boundary_once(spark):
    from cartograph.llm.common import Scratch
    from pyspark.sql import functions as F

    rows = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("g"), ((F.col("id") % 7) / 5.0).alias("e"))
    out = mixing.systematic(rows, F.col("e"), "g", [F.col("id")], "s", Scratch(spark, "t")).collect()
    for g in "012":
        mine = sorted((r["id"], r["e"], r["copies"]) for r in out if r["g"] == g)
        offset = spark.range(1).select(mixing.unit_random(F.lit(g), "s")).first()[0]
        total = offset
        for _, e, copies in mine:
            before, total = total, total + round(e * 2**32)
            assert copies == total // 2**32 - before // 2**32


def test_mix_messy(spark):
    docs = messy.frame(spark)
    m = mixing.mix(docs)
    assert m.count() == docs.count()
    out = mixing.emit(docs)
    assert out.schema.names == docs.schema.names
    assert out.count() == sum(r["copies"] for r in m.collect())
    assert mixing.digest(messy.empty(spark)).collect() == [] and mixing.emit(messy.empty(spark)).collect() == []


def recount(data):
    first = {}
    for doc_id, text, lang, source in data:
        key = (doc_id is None, doc_id or 0, source is None, source or "", lang is None, lang or "")
        t = text or ""
        if t not in first or key < first[t][0]:
            first[t] = (key, source, lang)
    docs, tokens = Counter(), Counter()
    for t, (_, source, lang) in first.items():
        docs[(source, lang)] += 1
        tokens[(source, lang)] += len(encoder().ids(t))
    return sorted(((s, g, MODEL, docs[(s, g)], tokens[(s, g)]) for s, g in docs), key=str)


def test_maintained_totals_equal_a_recount(spark):
    got = sorted((tuple(r) for r in tokencounts.maintained(messy.frame(spark)).collect()), key=str)
    assert got == recount(messy.rows())
    docs = read_table(spark, SF, "documents")
    data = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    assert sorted((tuple(r) for r in tokencounts.maintained(docs).collect()), key=str) == recount(data)
    assert tokencounts.maintained(messy.empty(spark)).collect() == []


def test_batches_are_idempotent_and_recoverable(spark):
    from pyspark.sql import functions as F

    root = tempfile.mkdtemp(prefix="rollup-", dir="/tmp")
    rows = spark.createDataFrame([("a", "en", 5), ("a", "en", 7), ("b", None, 1)], "source string, lang string, t bigint")
    book = tokencounts.Rollup(spark, root)
    assert book.totals().collect() == []
    add = tokencounts.inserts(rows, "v1", F.col("t"))
    assert book.commit("1", add) and not book.commit("1", add)
    assert sorted(map(tuple, book.totals().collect())) == [("a", "en", "v1", 2, 12), ("b", None, "v1", 1, 1)]
    # a batch without its marker does not count, and is written anew
    add.groupBy(*tokencounts.KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{root}/batch=2")
    assert book.committed() == ["1"] and sum(r["tokens"] for r in book.totals().collect()) == 13
    gone = tokencounts.revisions(rows, ("v1", F.col("t")), ("v2", F.col("t") * 2))
    assert book.commit("2", gone)
    assert sorted(map(tuple, tokencounts.Rollup(spark, root).totals().collect())) == [("a", "en", "v2", 2, 24), ("b", None, "v2", 1, 2)]
    assert book.commit("3", tokencounts.deletes(rows, "v2", F.col("t") * 2)) and book.totals().collect() == []
