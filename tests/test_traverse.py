"""T1 on random graphs, by the properties that fix its result, and on literal cases."""

import random

from cartograph.operators import traverse as TR

SUFFIXES = (".pdf", ".jpg", ".png", ".gif", ".zip")


def check_site(base, start, pages, links, limit, got):
    """Properties that fix the visit order: ``got`` is [(url, title, rank)] of one site."""
    if not limit or start not in pages:
        assert got == []
        return
    got = sorted(got, key=lambda x: x[2])
    urls = [u for u, _, _ in got]
    assert [r for _, _, r in got] == list(range(1, len(got) + 1)) and len(set(urls)) == len(urls)
    assert urls[0] == start and all(pages[u] == t and u.startswith(base) for u, t, _ in got)
    rank = {u: r for u, _, r in got}
    followable = {u: [(k, v) for k, v in enumerate(links.get(u, [])) if v.startswith(base) and not v.endswith(SUFFIXES)] for u in urls}
    # where each page was first discovered: the lowest-ranked page that links to it, at its first link there
    found = {}
    for u in urls:
        for k, v in followable[u]:
            found.setdefault(v, (rank[u], k))
    order = [(0, 0)] + [found[u] for u in urls[1:]]
    assert order == sorted(order) and all(found[u][0] < rank[u] for u in urls[1:])
    assert len(got) <= limit
    missing = [v for v in found if v in pages and v not in rank]
    if len(got) < limit:
        assert missing == []
    else:       # the limit cut the order where it stood
        assert all(found[v] > order[-1] for v in missing)


def random_site(rng, k):
    base = f"http://s{k}.test"
    n = rng.randint(1, 25)
    names = [f"{base}/p{i}" for i in range(n)]
    extra = [f"{base}/missing{i}" for i in range(3)] + [f"{base}/doc{i}.pdf" for i in range(2)] + \
            [f"http://other{k}.test/x", f"{base}x.test/y", f"http://x.test/{base}/z"]
    pages = {u: f"T{k}-{i}" for i, u in enumerate(names)}
    # a few suffix pages that exist in the corpus but are never enqueued
    for u in extra[3:5]:
        pages[u] = "pdf"
    links = {}
    for u in names:
        deg = rng.randint(0, 6)
        links[u] = [rng.choice(names + extra + [u]) for _ in range(deg)]
    return base, names[0], pages, links, rng.choice([0, 1, 2, 3, 5, 8, 150])


def test_bfs_order_on_random_sites(spark):
    rng = random.Random(7)
    sites = [random_site(rng, k) for k in range(40)]
    node_rows, link_rows, seed_rows = [], [], []
    for base, start, pages, links, limit in sites:
        node_rows += [(u, t) for u, t in pages.items()]
        link_rows += [(u, p, d) for u, ds in links.items() for p, d in enumerate(ds)]
        seed_rows.append((base, base, start, limit))
    nodes = spark.createDataFrame(node_rows, "url string, title string")
    links = spark.createDataFrame(link_rows, "src_url string, pos int, dst_url string")
    seeds = spark.createDataFrame(seed_rows, "site string, base_url string, start_url string, max_pages int")
    graph = TR.build_graph(nodes, links)
    got = TR.bounded_bfs(graph, seeds).collect()
    for base, start, pages, link_map, limit in sites:
        check_site(base, start, pages, link_map, limit, [(r.url, r.title, r.rank) for r in got if r.site == base])


def test_seed_is_base_url_and_zero_limit(spark):
    nodes = spark.createDataFrame([("http://a.com", "A"), ("http://a.com/x", "X"), ("http://a.company/y", "Y")],
                                  "url string, title string")
    links = spark.createDataFrame([("http://a.com", 0, "http://a.company/y"), ("http://a.com", 1, "http://a.com/x")],
                                  "src_url string, pos int, dst_url string")
    graph = TR.build_graph(nodes, links)
    seeds = spark.createDataFrame([("a", "http://a.com", 10), ("z", "http://a.com", 0)],
                                  "site string, base_url string, max_pages int")
    got = sorted((r.site, r.url, r.rank) for r in TR.bounded_bfs(graph, seeds).collect())
    # the raw prefix scope admits http://a.company/y, as in the reference
    assert got == sorted([("a", "http://a.com", 1), ("a", "http://a.company/y", 2), ("a", "http://a.com/x", 3)])


def test_authority_scope_excludes_prefix_only_hosts(spark):
    nodes = spark.createDataFrame([("http://a.com", "A"), ("http://a.com/x", "X"), ("http://a.company/y", "Y")],
                                  "url string, title string")
    links = spark.createDataFrame([("http://a.com", 0, "http://a.company/y"), ("http://a.com", 1, "http://a.com/x")],
                                  "src_url string, pos int, dst_url string")
    graph = TR.build_graph(nodes, links)
    seeds = spark.createDataFrame([("a", "http://a.com", 10)], "site string, base_url string, max_pages int")
    got = sorted((r.url, r.rank) for r in TR.bounded_bfs(graph, seeds, scope="authority").collect())
    assert got == [("http://a.com", 1), ("http://a.com/x", 2)]


def test_prefix_scope_join_matches_brute_force(spark):
    urls = ["http://a.co", "http://a.com/x", "http://a.co/y", "https://a.co/z", "http://a.co.uk/", "http://b.org/a"]
    seeds = [("s1", "http://a.co"), ("s2", "http://a.com"), ("s3", "https://a.co/z"), ("s4", "http://nope")]
    p = spark.createDataFrame([(u,) for u in urls], "url string")
    s = spark.createDataFrame(seeds, "site string, base_url string")
    got = sorted((r.site, r.url) for r in TR.prefix_scope_join(p, s).collect())
    assert got == sorted((k, u) for k, b in seeds for u in urls if u.startswith(b))
    got = sorted((r.site, r.url) for r in TR.prefix_scope_join(p, s, "authority").collect())
    assert got == [("s1", "http://a.co"), ("s1", "http://a.co/y"), ("s2", "http://a.com/x"), ("s3", "https://a.co/z")]


def test_many_nested_seeds_equal_brute_force(spark):
    import random
    rng = random.Random(8)
    base = "http://a.com/" + "x" * 300
    seeds = [(f"s{i}", base[:rng.randint(3, len(base))] + rng.choice(["", "", "y", "é", "\U0010ffff"])) for i in range(100_000)]
    urls = [base[:rng.randint(0, len(base))] + rng.choice(["", "y", "é/1", "\U0010ffff", "\ud7ff!"]) for _ in range(60)] + ["", None, "http://b.com/", None]
    got = TR.prefix_scope_join(spark.createDataFrame([(u,) for u in urls], "url string"),
                               spark.createDataFrame([*seeds, ("n", None), ("all", "")], "site string, base_url string"))
    want = {}
    for u in urls:
        if u is not None:
            want[u] = want.get(u, 0) + sum(u.startswith(b) for _, b in seeds) + 1
    assert {r["url"]: r["count"] for r in got.groupBy("url").count().collect()} == want
    assert got.filter("NOT startswith(url, base_url)").isEmpty()
