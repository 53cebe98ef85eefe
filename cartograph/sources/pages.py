"""Captured page corpus -> one extracted row per URL.

The HTML column is reduced to the extracted columns a query asks for by
JVM-side regular expressions in the scan stage, and dropped before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.functions import html as H
from cartograph.functions import urls as U

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captured(pages: DataFrame) -> DataFrame:
    """only successful fetches form the corpus (tables without ``status`` hold nothing else)."""
    return pages.filter(F.col("status") == 200) if "status" in pages.columns else pages


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per-row extraction (narrow): page_id, url, site, title_state, title, hrefs."""
    cleaned = captured(pages).select("page_id", "url", H.clean_html("html").alias("clean"))
    return cleaned.select(
        "page_id",
        "url",
        U.site_of("url").alias("site"),
        H.title_state("clean").alias("title_state"),
        H.extract_title("clean", "url").alias("title"),
        H.extract_hrefs("clean").alias("hrefs"),
    )


def page_index(pages: DataFrame) -> DataFrame:
    """One row per URL, the lowest ``page_id`` winning (a URL succeeds once).

    The winners are found on (url, page_id) alone, by hash aggregation, and
    joined back. Extracted columns are plain projections below that join, so
    those a caller does not use (links, for instance) are never computed.
    ``page_id`` identifies a page.
    """
    winners = captured(pages).groupBy("url").agg(F.min("page_id").alias("page_id"))
    return (extract_pages(pages).join(winners, ["url", "page_id"], "left_semi")
            .select("url", "page_id", "site", "title_state", "title", "hrefs"))


def kept(index: DataFrame) -> DataFrame:
    """Pages whose title step succeeded: their title is used and links followed."""
    return index.filter(F.col("title_state").isin(*H.TITLE_STATES_KEPT))


def page_links(index: DataFrame) -> DataFrame:
    """P3+P4: (site, src_url, pos, href, dst_url) for every kept page."""
    links = kept(index).select(
        "site", F.col("url").alias("src_url"), F.posexplode("hrefs").alias("pos", "href"))
    return U.with_resolved_url(links, "src_url", "href", "dst_url")


def page_reasons(pages: DataFrame) -> DataFrame:
    """every row of ``pages`` with the reason why no site map holds it, null if one does: (page_id, url, reason).

    The first that holds: ``failed`` (status), ``no_url``, ``duplicate_url``
    (the URL was captured under a lower ``page_id``), ``title_empty`` or
    ``title_nested``, ``no_site``.
    """
    fetched = F.coalesce(F.col("status") == 200, F.lit(False)) if "status" in pages.columns else F.lit(True)
    first = captured(pages).groupBy("url").agg(F.min("page_id").alias("page_id")).withColumn("first", F.lit(True))
    rows = pages.select("page_id", "url", fetched.alias("fetched"), U.site_of("url").alias("site"),
                        H.title_state(H.clean_html("html")).alias("title_state"))
    reason = (F.when(~F.col("fetched"), "failed").when(F.col("url").isNull(), "no_url").when(F.col("first").isNull(), "duplicate_url")
              .when(~F.col("title_state").isin(*H.TITLE_STATES_KEPT), F.concat(F.lit("title_"), F.col("title_state")))
              .when(F.col("site") == "", "no_site"))
    return rows.join(first, ["url", "page_id"], "left").select("page_id", "url", reason.alias("reason"))
