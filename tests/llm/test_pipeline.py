import re
from collections import Counter

import corpus_pipeline
import messy
from cartograph.llm import linededup, mixing, packing, quality, simhash
from cartograph.llm.common import components, Scratch, read_table

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order(spark):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "quality_stage", "line_dedup_stage", "near_dedup_stage", "mixing_stage", "packing_stage"]
    docs = read_table(spark, SF, "documents")
    frames = [docs]
    scratch = Scratch(spark, "test-pipeline")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = scratch.write(stage(spark, frames[-1], SF), f"s{k}")
        if k < 4:
            assert out.schema.names == COLUMNS
        frames.append(out)
    raw, good, lines, single, mixed, packed = frames
    scores = {r["doc_id"]: r["predicted"] for r in quality.classify(raw, read_table(spark, SF, "labels")).collect()}
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(i for i, p in scores.items() if p)
    kept = {r[0]: r[1] for r in linededup.without_runs(good, linededup.repeated_runs(good)).select("row.doc_id", "kept").collect()}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == kept
    groups = simhash.digest(lines).collect()
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({r["component_id"] for r in groups})
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(single).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: c for i, c in copies.items() if c})
    tokens = Counter()
    for r in packing.token_pieces(mixed).select("doc_id", "length").collect():
        tokens[r[0]] += r[1]
    assert Counter({r[0]: r[1] for r in packed.groupBy("doc_id").agg({"length": "sum"}).collect()}) == tokens


def test_every_stage_takes_messy_and_empty_tables(spark):
    docs, scratch = messy.frame(spark), Scratch(spark, "test-messy")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        nothing = stage(spark, messy.empty(spark), SF)
        assert nothing.collect() == []
        out = scratch.write(stage(spark, docs, SF), f"m{k}")
        if k < 4:
            assert out.schema.names == docs.schema.names
            docs = out


def test_registered_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names
    assert {re.match(r"op(\d+)_", n)[1] for n in names if n.startswith("op")} == set(map(str, range(1, 14)))
    assert set(entry.oracle_sql()) <= names


def test_components(spark):
    edges = [(1, 2), (3, 2), (3, 4), (10, 11), (7, 7), (20, 30), (30, 40), (40, 20), *[(100 + i, 101 + i) for i in range(60)]]
    got = {r["node"]: r["component"] for r in components(
        spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "cc")).collect()}
    want = {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 20: 20, 30: 20, 40: 20} | {100 + i: 100 for i in range(61)}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark, "cc")).collect() == []
