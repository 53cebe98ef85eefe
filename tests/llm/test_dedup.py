import hashlib
import os

import duckdb
import messy
import numpy as np
import pytest
import xxhash
from cartograph.llm import linededup, simhash, substring

SF = "/root/testdata/sf0.001"


def components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs:
        root[find(i)] = find(j)
    return [find(i) for i in range(n)]


# ---------------------------------------------------------------- line dedup

def line_model(data, text_hash, min_lines):
    """Kept text per (id, text), windows compared one by one."""
    docs = sorted({(messy.crash_key(i), text_hash[t], t) for i, t, *_ in data if t is not None})
    seen, out = set(), {}
    for d, h, text in docs:
        lines = text.split("\n")
        visible = [k for k, line in enumerate(lines) if messy.WORD.search(line)]
        gone = set()
        for p in range(len(visible) - min_lines + 1):
            at = visible[p:p + min_lines]
            window = tuple(lines[k] for k in at)
            if window in seen:
                gone.update(at)
            seen.add(window)
        out[(d, text)] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_line_dedup_against_windows(spark, min_lines):
    data = messy.rows()
    docs = messy.frame(spark)
    text_hash = {r[0]: r[1] for r in docs.selectExpr("text", "xxhash64(text)").collect()}
    want = line_model(data, text_hash, min_lines)
    got = linededup.without_runs(docs, linededup.repeated_runs(docs, min_lines)).collect()
    assert len(got) == len(data)
    removed = 0
    for r in got:
        doc, text = r["row"]["doc_id"], r["row"]["text"]
        if text is None:
            assert (r["n_lines"], r["n_removed"], r["kept"]) == (0, 0, None)
            continue
        assert (r["n_lines"], r["n_removed"], r["kept"]) == want[(messy.crash_key(doc), text)]
        removed += r["n_removed"]
    assert removed > 0


def test_line_dedup_doubles_until_no_interval_holds_two_suffixes(spark):
    # a passage of 37 lines in three documents, and two copies inside one document
    passage = [f"line {i}" for i in range(37)]
    rows = [(1, ["a", *passage, "b"]), (2, [*passage[:20], "", *passage[20:]]), (3, ["c", *passage, "d", *passage[5:9]])]
    docs = spark.createDataFrame([(d, "\n".join(x)) for d, x in rows], "doc_id long, text string")
    scratch = linededup.Scratch(spark, "levels")
    for least, widths in [(1, {1, 2, 4, 8, 16, 32}), (2, {2, 4, 8, 16, 32}), (3, {3, 6, 12, 24}), (50, set())]:
        lines = scratch.write(linededup.line_ids(docs), f"lines-{least}")
        copies = linededup.copied_prefixes(lines, linededup.Scratch(spark, "levels"), least).collect()
        assert {r["width"] for r in copies} == widths
        # what starts earlier does so at each width up to the longest
        assert all(r["p"] + r["width"] <= 43 for r in copies)
        runs = sorted((r["d"], r["first_line"], r["n_lines"]) for r in linededup.repeated_runs(docs, least).collect())
        assert runs == ([] if least == 50 else [(2, 0, 20), (2, 21, 17), (3, 1, 37), (3, 39, 4)])


def test_line_dedup_keeps_columns_and_rows(spark):
    docs = messy.frame(spark)
    out = linededup.dedup_lines(docs)
    assert out.schema.names == docs.schema.names
    rows = out.collect()
    assert len(rows) == docs.count()
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in rows)
    assert linededup.dedup_lines(messy.empty(spark)).collect() == []
    assert linededup.digest(messy.empty(spark)).collect() == []


def test_line_dedup_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = sorted(con.execute(linededup.ORACLE).fetchall())
    assert sorted(tuple(r) for r in linededup.digest(spark.read.parquet(f"{SF}/documents.parquet")).collect()) == want


def test_line_dedup_runs_no_python(spark):
    docs = messy.frame(spark)
    plan = linededup.digest(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---------------------------------------------------------------- SimHash

def model_fingerprint(text, shingle=3):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = [w.encode().translate(low) for w in messy.WORD.findall(text or "")]
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def model_groups(fps, max_bits=3):
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= max_bits]
    return components(len(fps), pairs)


def test_simhash_against_all_pairs(spark):
    data = messy.rows()
    fps = [model_fingerprint(t) for _, t, *_ in data]
    group = model_groups(fps)
    low = {}
    for g, r in zip(group, data):
        if r[0] is not None:
            low[g] = min(low.get(g, messy.LAST), r[0])
    want = sorted(((r[0] is None, r[0] or 0, f"{f:016x}", low.get(g)) for r, f, g in zip(data, fps, group)), key=str)
    got = sorted(((r[0] is None, r[0] or 0, r[1], r[2]) for r in simhash.digest(messy.frame(spark)).collect()), key=str)
    assert got == want
    assert simhash.digest(messy.empty(spark)).collect() == []


def test_simhash_keeps_one_of_each_group(spark):
    docs = messy.frame(spark)
    kept = simhash.keep_one(docs)
    assert kept.schema.names == docs.schema.names
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    # every text of the table has its group; a group's smallest id, then text, stands for it
    group = {}
    for r in simhash._marked(docs, simhash.SHINGLE, simhash.MAX_BITS, "doc_id", "text").collect():
        group.setdefault(r["group"], set()).add((r["doc_id"] is None, r["doc_id"] or 0, r["h"]))
    assert ids == sorted(i for none, i, _ in {min(g) for g in group.values()} if not none)


def test_an_id_keeps_every_text_that_represents_a_group(spark):
    words = np.random.default_rng(9).integers(0, 10**6, (2, 60)).astype(str)
    a, b = (" ".join(w) for w in words)
    data = [(5, a), (5, b), (7, b), (9, a), (5, a)]
    rows = simhash.keep_one(spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted([(5, a), (5, b)])


def test_the_row_kept_represents_its_group(spark):
    words = np.random.default_rng(8).integers(0, 10**6, (24, 60)).astype(str)
    texts = [" ".join(w) for w in words]
    # id 100 + k has a text of its own and one of a group that a smaller id represents
    data = [r for k in range(12) for r in ((100 + k, texts[2 * k], 1), (100 + k, texts[2 * k + 1], 0), (k, texts[2 * k + 1], 1))]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, represents int").repartition(5)
    rows = simhash.keep_one(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == [*range(12), *range(100, 112)]
    assert all(r["represents"] for r in rows)


def test_near_pairs_join_all_close_fingerprints(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for f in base[:25].tolist():
        for _ in range(rng.integers(1, 40)):
            fps.add(f ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp bigint").repartition(4)
    at = {simhash.signed(f): i for i, f in enumerate(fps)}
    pairs = [(r["a"], r["b"]) for r in simhash.near_pairs(df).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in pairs)
    got = components(len(fps), [(at[a], at[b]) for a, b in pairs])
    want = model_groups(fps)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


# ---------------------------------------------------------------- substring dedup

def passage_model(data, text_hash, window=20):
    docs = sorted({(messy.crash_key(i), text_hash[t or ""], t or "") for i, t, *_ in data})
    seen, out = set(), {}
    for d, _, text in docs:
        words = messy.WORD.findall(text)
        gone = set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        out[(d, text)] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


def test_substring_dedup_against_windows(spark):
    data = messy.rows(n=120)
    docs = messy.frame(spark, data)
    text_hash = {r[0]: r[1] for r in docs.selectExpr("coalesce(text, '')", "xxhash64(coalesce(text, ''))").collect()}
    want = passage_model(data, text_hash)
    expected = sorted((i is None, i or 0, *want[(messy.crash_key(i), t or "")]) for i, t, *_ in data)
    got = sorted((r[0] is None, r[0] or 0, r[1], r[2], r[3]) for r in substring.dedup_passages(docs).collect())
    assert got == expected
    assert sum(r[3] for r in got) > 500
    digest = {(r[0], r[3]) for r in substring.digest(docs).collect()}
    assert digest == {(i, hashlib.sha256(want[(messy.crash_key(i), t or "")][2].encode()).hexdigest()) for i, t, *_ in data}
    assert substring.digest(messy.empty(spark)).collect() == []


def test_scan_chunks_do_not_matter():
    import pyarrow as pa

    texts = pa.array([t for _, t, *_ in messy.rows()])
    one = [(lo, s.phrases[s.anchors()].tolist()) for lo, s in substring.scans(texts, 20, 8, step=10**9)]
    many = [x for _, s in substring.scans(texts, 20, 8, step=1) for x in s.phrases[s.anchors()].tolist()]
    assert one[0][1] == many
    assert os.path.exists(SF)


def test_substring_dedup_frees_each_step_before_the_next(spark, monkeypatch):
    # shuffle files and tables of finished steps stayed on disk until the end
    import os
    there = []
    plain_write, plain_release = substring.Scratch.write, substring.release
    monkeypatch.setattr(substring, "release", lambda s: there.append(None) or plain_release(s))

    def write(self, df, name):
        there.append(name)
        if name == "blocks":
            assert not os.path.exists(f"{self.root.removeprefix('file:')}/wanted")
        return plain_write(self, df, name)

    monkeypatch.setattr(substring.Scratch, "write", write)
    words = " ".join(f"w{k}" for k in range(40))
    docs = messy.frame(spark, [(1, words, "en", "x"), (2, f"x {words}", "en", "x")])
    got = {r["doc_id"]: r["n_removed"] for r in substring.dedup_passages(docs).collect()}
    assert got == {1: 0, 2: 40}
    # a step's shuffles are released before the step after it begins
    for name in ("anchors", "wanted", "blocks", "firsts", "windows", "spans"):
        assert there.index(name) + 1 < len(there)
    assert all(there[there.index(name) + 1] is None for name in ("anchors", "wanted", "firsts", "windows", "spans"))


def test_substring_joins_do_not_share_the_disk(spark, monkeypatch):
    # blocks, their firsts and both joins' shuffles lay on disk together
    there = {}
    plain = substring.Scratch.write

    def write(self, df, name):
        there[name] = set(os.listdir(self.root.removeprefix("file:")))
        return plain(self, df, name)

    monkeypatch.setattr(substring.Scratch, "write", write)
    words = " ".join(f"w{k}" for k in range(40))
    docs = messy.frame(spark, [(1, words, "en", "x"), (2, f"x {words}", "en", "x"), (3, f"{words} y", "en", "x")])
    got = {r["doc_id"]: r["n_removed"] for r in substring.dedup_passages(docs).collect()}
    assert got == {1: 0, 2: 40, 3: 40}
    assert "copies" in there["windows"]
    assert not there["spans"] & {"blocks", "firsts"}


def test_anchors_are_the_first_least_of_their_window():
    rng = np.random.default_rng(5)
    for n, span, high in ((40, 13, 4), (12, 13, 9), (13, 13, 9), (0, 13, 9), (50, 1, 3), (200, 6, 1000)):
        x = rng.integers(0, high, n).astype(np.uint64)
        want = [i + int(np.argmin(x[i:i + span])) for i in range(n - span + 1)]
        assert substring.leftmost_least(x, span).tolist() == want


def test_an_automaton_of_phrases_has_two_nodes_a_word():
    import ahocorasick

    values = np.array([7, 900, 12, 7, 5], np.uint64)
    letters = substring.Letters(values)
    spelt = letters(values)
    assert len(spelt) == 10 and letters(np.array([8, 901], np.uint64)) == "\0" * 4
    assert not {*spelt[::2]} & {*spelt[1::2]}
    assert [letters(values[:1]), letters(values[3:4])] == [spelt[:2], spelt[6:8]] == [spelt[:2]] * 2
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    automaton.add_word(letters(np.array([12, 7], np.uint64)), 1)
    automaton.make_automaton()
    assert [e // 2 for e, _ in automaton.iter(letters(np.array([7, 12, 3, 12, 7, 12, 7], np.uint64)))] == [4, 6]
    many = substring.Letters(np.arange(4_000_000_000, 4_000_000_000 + 60_000, dtype=np.uint64))
    many.base = 60_000                  # letters beyond the surrogates' code points stay apart
    assert len({*many(many.known)[::2]}) == 1 and len({*many(many.known)[1::2]}) == 60_000


def test_substring_phrases_are_cut_out_of_the_bytes():
    import numpy as np
    import pyarrow as pa
    [(_, s)] = substring.scans(pa.array(["  a bb\tc dé e", "f  g h"]), 20, 3)
    assert s.texts(np.array([0, 2, 5]), 3).to_pylist() == [" a bb c ", " c dé e ", " f g h "]
    assert s.texts(np.array([], int), 3).to_pylist() == []
