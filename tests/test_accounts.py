"""input = kept + reasons, on planted faults."""

from conftest import SF_SMALL
from cartograph.operators import accounts as A
from cartograph.sources import fixtures as FX
from cartograph.sources import pages as P


def test_every_page_has_its_reason(spark):
    ok = "<title>T</title>"
    rows = [(1, "http://a.com/1", ok, 200), (2, "http://a.com/1", ok, 200), (3, "http://a.com/3", ok, 404), (4, "http://a.com/4", ok, None),
            (5, "http://a.com/5", "<title></title>", 200), (6, None, ok, 200), (7, "nowhere", ok, 200), (8, "http://a.com/8", "", 200),
            (9, "http://a.com/3", ok, 200), (10, "http://a.com/10", "<title><b>x</b></title>", 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, status int")
    got = {r.page_id: r.reason for r in P.page_reasons(pages).collect()}
    assert got == {1: None, 2: "duplicate_url", 3: "failed", 4: "failed", 5: "title_empty", 6: "no_url", 7: "no_site", 8: None,
                   9: None, 10: "title_nested"}
    assert P.page_reasons(pages.drop("status").filter("page_id = 0")).collect() == []


def test_observed_counts_add_up(spark):
    pages = FX.faulty_captures(P.read_table(spark, SF_SMALL, "pages"))
    judged, seen = A.observe_reasons(P.page_reasons(pages), "pages")
    counts = {r.reason: r.n_rows for r in A.reason_counts(judged, "pages").collect()}
    kept = P.kept(P.page_index(pages)).filter("site <> ''").count()
    assert seen.get == {"n_input": pages.count(), "n_kept": kept}
    assert sum(counts.values()) == seen.get["n_input"] and counts[None] == kept
    assert {"failed", "duplicate_url", "title_empty"} <= set(counts)
