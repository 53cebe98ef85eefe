import tempfile

from conftest import SF_SMALL
from cartograph.operators import sitemap as SM
from cartograph.sources import pages as P
from cartograph.streaming.refresh import start_refresh


def test_refresh_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="cartograph-stream-")
    q = start_refresh(spark, SF_SMALL, f"{d}/index", f"{d}/docs", f"{d}/ckpt", glob="pages.parquet")
    q.awaitTermination(300)
    got = {r.site: r.doc for r in spark.read.parquet(f"{d}/docs").collect()}
    ix = P.page_index(P.read_table(spark, SF_SMALL, "pages"))
    want = {r.site: r.doc for r in SM.render_documents(SM.corpus_ranked(ix)).collect()}
    assert got == want


def test_refresh_keeps_old_pages_and_fails_on_a_broken_index(spark):
    import pytest
    from cartograph.streaming.refresh import _apply_batch
    d = tempfile.mkdtemp(prefix="cartograph-refresh-")
    row = lambda i, path: (i, f"http://s.example/{path}", f"<title>{path}</title>")
    schema = "page_id long, url string, html string"
    other = (9, "http://t.example/x", "<title>x</title>")
    _apply_batch(spark, spark.createDataFrame([row(1, "a"), row(2, "b"), other], schema), f"{d}/index", f"{d}/docs", None)
    _apply_batch(spark, spark.createDataFrame([row(0, "b"), row(3, "c")], schema), f"{d}/index", f"{d}/docs", None)
    kept = sorted((r.url, r.page_id) for r in spark.read.parquet(f"{d}/index").collect())
    assert kept == [("http://s.example/a", 1), ("http://s.example/b", 0), ("http://s.example/c", 3), ("http://t.example/x", 9)]
    assert spark.read.parquet(f"{d}/docs").count() == 2
    import glob
    for f in glob.glob(f"{d}/index/*/*.parquet"):
        open(f, "wb").write(b"broken")
    with pytest.raises(Exception):
        _apply_batch(spark, spark.createDataFrame([row(4, "d")], schema), f"{d}/index", f"{d}/docs", None)
