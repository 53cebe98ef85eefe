"""Scale properties of the physical plans (regression guards)."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from cartograph.operators import sitemap as SM
from cartograph.operators import traverse as TR
from cartograph.sources import pages as P


def test_page_limit_is_applied_before_the_site_shuffle(spark):
    ranked = SM.corpus_ranked(P.page_index(P.read_table(spark, SF_SMALL, "pages")), 150)
    text = ranked._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text


def test_scan_reads_only_the_columns_it_needs(spark):
    d = tempfile.mkdtemp(prefix="cartograph-plan-")
    src = P.read_table(spark, SF_SMALL, "pages").withColumn("junk", F.lit("x" * 100))
    src.write.parquet(f"{d}/pages.parquet")
    ix = P.page_index(P.read_table(spark, d, "pages"))
    text = ix._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string,html:string>" in text
    assert "junk" not in text.split("ReadSchema")[1].split("\n")[0]


def test_traversal_level_moves_neither_graph_nor_store(spark):
    from cartograph.operators import traverse as TR
    chain = 30
    nodes = spark.createDataFrame([(f"http://a.com/{i}", f"T{i}") for i in range(chain)], "url string, title string")
    links = spark.createDataFrame([(f"http://a.com/{i}", 0, f"http://a.com/{i + 1}") for i in range(chain - 1)],
                                  "src_url string, pos int, dst_url string")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    graph = TR.build_graph(nodes, links)
    seen = TR.Buckets(spark, "seen_test", ["site", "url"])
    rows = spark.createDataFrame([("a", f"http://a.com/{i}", i, "http://a.com", 50, 0, 0, 0) for i in range(20)],
                                 "site string, url string, level int, base_url string, max_pages bigint, found bigint, "
                                 "parent_rank bigint, pos bigint")
    counts = []
    for _ in range(2):                       # after the first and after the second append
        seen.append(rows.repartition(seen.n, "site", "url"))
        spark.conf.set(key, "-1")
        try:
            _, nxt = TR.expand(seen.read().filter("level = 19"), graph, seen.read(), 50, "prefix")
            text = nxt._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set(key, before)
        counts.append(text.count("Exchange hashpartitioning"))
        # the frontier by URL, its hits by site, the candidates by (site, url): graph and store stay where they are
        store = text[text.index("LeftAnti"):]
        assert store.count("Bucketed: true") == 2
    assert counts == [3, 3]


def test_a_chain_of_thirty_levels(spark):
    from cartograph.operators import traverse as TR
    n = 31
    nodes = spark.createDataFrame([(f"http://a.com/{i}", f"T{i}") for i in range(n)], "url string, title string")
    links = spark.createDataFrame([(f"http://a.com/{i}", 0, f"http://a.com/{j}") for i in range(n) for j in (i + 1, i - 1, 0)],
                                  "src_url string, pos int, dst_url string")
    seeds = spark.createDataFrame([("a", "http://a.com", "http://a.com/0", 100)], "site string, base_url string, start_url string, max_pages int")
    got = {r["url"]: r["rank"] for r in TR.bounded_bfs(TR.build_graph(nodes, links), seeds).collect()}
    assert got == {f"http://a.com/{i}": i + 1 for i in range(n)}


def test_titles_and_documents_never_extract_links_or_sort_rows_to_aggregate(spark):
    from cartograph.plans.catalog import QUERIES
    for name in ("page_titles", "sitemap_documents"):
        text = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "href" not in text and "SortAggregate" not in text, name


def test_every_kept_page_is_mapped(spark):
    from cartograph.plans.catalog import QUERIES
    ix = P.page_index(P.read_table(spark, "/root/testdata/sf0.1", "pages"))
    kept = ix.filter("title_state IN ('ok', 'absent') AND site <> ''")
    largest = kept.groupBy("site").count().agg({"count": "max"}).first()[0]
    assert largest > SM.DEFAULT_MAX_PAGES
    counted = QUERIES["section_counts"](spark, "/root/testdata/sf0.1").agg({"n_pages": "sum"}).first()[0]
    assert counted == kept.count()
