import numpy as np
import pytest
from cartograph.llm import ann, vectordedup

SCHEMA = "vec_id bigint, embedding array<float>, label int, leaf string, rank string, id string, node string"


def vectors(n=1500, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    for i in range(0, n // 3, 3):
        x[i + 1] = x[i] + rng.normal(size=dim).astype(np.float32) * 0.05
    x[n // 2:n // 2 + 60] = x[7] + rng.normal(size=(60, dim)).astype(np.float32) * 0.03
    x[n // 2 + 60:n // 2 + 90] = x[11]
    label = rng.integers(0, 3, n)
    label[n // 2:n // 2 + 90] = 1
    return [(int(i), x[i].tolist(), int(label[i])) for i in range(n)]


ODD = [(10_000, None, 1), (10_100, [0.0] * 16, 1), (10_200, [float("nan")] + [1.0] * 15, 1), (10_300, [float("inf")] + [1.0] * 15, 1),
       (10_400, [None] + [1.0] * 15, 1), (10_500, [1.0, 2.0], 1), (None, [1.0] * 16, 1), (10_600, [1.0] * 16, None)]


def frame(spark, data):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in data], SCHEMA).repartition(4)


def test_search_recall_and_exact_scores(spark):
    data = vectors(4000) + ODD + [(100, vectors(4000)[100][1], 0), (3999, vectors(4000)[3999][1], 2)]
    df = frame(spark, data)
    got = {}
    for r in ann.search(df, df.where("vec_id % 100 = 0"), k=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, v) for i, v, _ in data if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([np.float32(v) for _, v in good], dtype=float)
    queries = sorted({i for i in ids.tolist() if i % 100 == 0})
    assert sorted(got) == queries
    hits = 0
    for q in queries:
        d = np.sqrt(((x - x[ids.tolist().index(q)]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 11))
        assert [(r[2], r[1]) for r in rows] == sorted((r[2], r[1]) for r in rows)
        for _, v, s in rows:
            assert v != q and s in d[ids == v]
        hits += len({r[1] for r in rows} & set(ids[best].tolist()))
    assert hits / (10 * len(queries)) >= 0.9


def test_search_small_tables(spark):
    few = frame(spark, [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 3.0], 0)])
    rows = [tuple(r) for r in ann.search(few, few.where("vec_id = 0")).orderBy("rank").collect()]
    assert [(r[1], r[2]) for r in rows] == [(1, 1), (2, 2)] and rows[0][3] == 0.0 and rows[1][3] == pytest.approx(10 ** 0.5)
    assert ann.search(few.where("false"), few.where("false")).collect() == []
    one = few.where("vec_id = 0")
    assert ann.search(one, one).collect() == []
    same = frame(spark, [(i, [1.0, 2.0], 0) for i in range(40)])
    assert [r["vec_id"] for r in ann.search(same, same.where("vec_id = 0")).orderBy("rank").collect()] == list(range(1, 11))


def test_best_bin_first_visits_every_leaf_once():
    x = np.random.default_rng(1).normal(size=(800, 8))
    tree = ann.Tree.fit(x, 20)
    leaves = tree.assign(x)
    order = list(tree.visit(x[5]))
    assert sorted(order) == list(range(tree.n_leaves)) and set(leaves) <= set(order)


def links_model(data, cosine=0.98):
    ok = [k for k, (i, v, lab) in enumerate(data) if i is not None and lab is not None and v is not None and len(v) == 16
          and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([np.float32(data[k][1]) for k in ok], dtype=float)
    x /= np.sqrt((x ** 2).sum(axis=1))[:, None]
    lab = np.array([data[k][2] for k in ok])
    near = (x @ x.T >= cosine) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(near, False)
    root = list(range(len(ok)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(near)):
        root[find(i)] = find(j)
    low = {}
    for i, k in enumerate(ok):
        low[find(i)] = min(low.get(find(i), 1 << 60), data[k][0])
    out = {k: (data[k][0], 0, data[k][0]) for k in range(len(data))}
    for i, k in enumerate(ok):
        out[k] = (data[k][0], int(near[i].sum()), low[find(i)])
    return sorted(out.values(), key=str)


def test_near_dedup_finds_all_links(spark):
    base = vectors()
    data = base + ODD + [base[3], base[3], (9_000, base[4][1], base[4][2])]
    rows = vectordedup.near_duplicates(frame(spark, data)).collect()
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in rows), key=str)
    assert got == links_model(data)
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in rows)


def test_near_dedup_of_nothing(spark):
    assert vectordedup.near_duplicates(frame(spark, [])).collect() == []
    rows = vectordedup.near_duplicates(frame(spark, ODD[:2])).collect()
    assert sorted((r["vec_id"], r["n_links"], r["kept"]) for r in rows) == [(10_000, 0, True), (10_100, 0, True)]


def test_pairs_of_a_large_cell_meet(spark):
    rng = np.random.default_rng(5)
    top = rng.normal(size=16)
    x = np.concatenate([top / np.linalg.norm(top) * side + rng.normal(size=(700, 16)) * 0.01 for side in (1, -1)])
    x[1::2] = x[::2] + rng.normal(size=(700, 16)) * 0.0005
    nodes = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "id bigint, label bigint, vec array<double>")
    centres = vectordedup.label_centres(nodes, 16)
    got = {(r["a"], r["b"]) for r in vectordedup.cell_candidates(nodes, centres, 16, 0.98, 10, 0).collect()}
    assert all((i, i + 1) in got and (i + 1, i) in got for i in range(0, 1400, 2))


@pytest.mark.parametrize("block", [4096, 25])
def test_blocks_of_a_cell_are_compared_with_one_another(spark, block):
    x = np.random.default_rng(6).normal(size=(90, 8))
    nodes = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "id bigint, label bigint, vec array<double>")
    centres = vectordedup.label_centres(nodes, 8)
    got = {(r["a"], r["b"]) for r in vectordedup.cell_candidates(nodes, centres, 8, 0.98, 5, 0, block).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    sim = u @ u.T
    np.fill_diagonal(sim, -2)
    assert {(i, int(j)) for i in range(90) for j in np.argsort(-sim[i])[:5]} <= got


def hot_vectors(n=1200, dim=16):
    """One large group of near copies with looser ones about it, beside the usual table."""
    rng = np.random.default_rng(9)
    top = rng.normal(size=dim)
    wide = rng.uniform(0.02, 0.25, size=n // 3)[:, None]
    x = (top + rng.normal(size=(n // 3, dim)) * wide).astype(np.float32)
    return vectors(n) + [(20_000 + i, v.tolist(), 1) for i, v in enumerate(x)] + [(30_000 + i, x[0].tolist(), 1) for i in range(5)]


def in_rows(data):
    return [(i, np.float32(v), lab) for i, v, lab in data]


def test_lists_do_not_grow_to_the_size_of_a_group(spark):
    data = hot_vectors()
    nodes = spark.createDataFrame([(i, lab, v.tolist()) for i, v, lab in in_rows(data)], "id bigint, label bigint, vec array<float>")
    graph = vectordedup.neighbour_graph(nodes, 16, vectordedup.Scratch(spark, "lists"))
    want = links_model(data)
    bound = vectordedup.DENSE * (len(data) - 1200)
    assert graph[0].where("a >= 20000").count() <= bound < sum(n for i, n, _ in want if i >= 20_000) / 2
    assert graph[1].count() > 0 and graph[2] >= vectordedup.RECALL
    rows = vectordedup.near_duplicates(frame(spark, data)).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in rows), key=str) == want


def test_a_failed_audit_does_not_lose_links(spark, monkeypatch):
    data = vectors(600)
    whole = vectordedup.cell_candidates
    monkeypatch.setattr(vectordedup, "cell_candidates", lambda *args: whole(*args).where("a % 7 = 0"))
    monkeypatch.setattr(vectordedup, "ROUNDS", 0)
    rows = vectordedup.near_duplicates(frame(spark, data)).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in rows), key=str) == links_model(data)


def test_dense_links_block_against_block(spark):
    data = hot_vectors()
    nodes = spark.createDataFrame([(i, lab, v.tolist(), 1 + i % 3) for i, v, lab in in_rows(data)],
                                  "id bigint, label bigint, vec array<float>, copies bigint")
    dense = nodes.where("id >= 20000 and id % 4 > 0").select("id")
    counts, forest = vectordedup.dense_links(nodes, dense, 16, vectordedup.Scratch(spark, "blocks"), block=50)
    ids, lab = np.array([i for i, _, _ in data]), np.array([lab for _, _, lab in data])
    x = np.array([np.float32(v) for _, v, _ in data], dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hot = (ids >= 20_000) & (ids % 4 > 0)
    near = (x @ x.T >= 0.98) & (lab[:, None] == lab[None, :]) & (hot[:, None] | hot[None, :])
    np.fill_diagonal(near, False)
    want = {int(i): int(n) for i, n in zip(ids, near @ (1 + ids % 3)) if n}
    assert {r["id"]: r["others"] for r in counts.collect() if r["others"]} == want
    root = {int(i): int(i) for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def groups(pairs):
        root.update({int(i): int(i) for i in ids})
        for a, b in pairs:
            root[find(int(a))] = find(int(b))
        top = {}
        for i in ids.tolist():
            top.setdefault(find(i), []).append(i)
        return sorted(top.values())

    assert groups([(r["a"], r["b"]) for r in forest.collect()]) == groups([(ids[i], ids[j]) for i, j in zip(*np.nonzero(near))])
