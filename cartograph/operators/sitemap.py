"""Site-map grouping, ordering and rendering.

All kept pages of a site are mapped. ``map_lines`` is the form for sites of
any size: ordered line rows, numbered without putting a site into one task.
``render_documents`` builds one string per site, as a document is one value;
callers that bound a site do so with the traversal's page limit (T1, O3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartograph.functions import text as T
from cartograph.functions import urls as U
from cartograph.operators.numbering import row_number_by

DEFAULT_MAX_PAGES = 150  # fixed value: the traversal's page limit


def corpus_ranked(index: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Captured-corpus mode: every kept page of a site, ordered by page_id.

    ``rank`` is the page_id itself, so no window is needed. With ``max_pages``
    only a site's first pages stay, and ``row_number() <= k`` lets Spark put a
    partial WindowGroupLimit before the shuffle.
    """
    pages = (index.filter(F.col("title_state").isin("ok", "absent") & (F.col("site") != ""))
             .select("site", "url", "title", "page_id"))
    if max_pages is None:
        return pages.withColumn("rank", F.col("page_id"))
    w = Window.partitionBy("site").orderBy("page_id")
    return pages.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_pages)


def site_seeds(ranked: DataFrame) -> DataFrame:
    """Default seed per site: base URL = ``scheme://authority``, derived name."""
    return ranked.select("site").distinct().select(
        "site", F.col("site").alias("base_url"), U.site_name("site").alias("site_name"))


def section_rows(ranked: DataFrame) -> DataFrame:
    """P5-P7, P9 per page: section slug, label, cleaned title and link line."""
    return (
        ranked.select("site", "url", "rank", "title", U.section_key("url").alias("section"))
        .withColumn("label", U.section_label("section"))
        .withColumn("line", T.link_line(T.collapse_ws("title"), "url"))
    )


def section_counts(ranked: DataFrame) -> DataFrame:
    """A1/A2: pages per (site, section) with the section's label."""
    return section_rows(ranked).groupBy("site", "section", "label").agg(F.count("*").alias("n_pages"))


def section_order(rows: DataFrame) -> DataFrame:
    """O1: (site, section, label, section_ord): Home first, then raw slugs, 1-based."""
    by_slug = Window.partitionBy("site").orderBy(F.col("section") != U.HOME_SECTION, "section")
    return (rows.select("site", "section", "label").distinct()
            .withColumn("section_ord", F.row_number().over(by_slug).cast("bigint")))


def ordered_links(ranked: DataFrame) -> DataFrame:
    """O1/O2: section order (Home first, then raw slug) and link order (URL length, rank)."""
    rows = section_rows(ranked).withColumn("url_chars", F.length("url"))
    numbered = row_number_by(rows, ["site", "section"], ["url_chars", "rank"], "link_ord")
    return numbered.drop("url_chars").join(
        section_order(rows).select("site", "section", "section_ord"), ["site", "section"])


def map_lines(ranked: DataFrame) -> DataFrame:
    """R1 as ordered rows: (site, section_ord, link_ord, line).

    Section 0 is the site's header. In a section, ``link_ord`` -1 and 0 are
    the heading and the blank line below it, 1.. are the links, and the blank
    line that ends the section comes after the last of them.
    """
    rows = section_rows(ranked)
    links = ordered_links(ranked).select("site", "section_ord", "link_ord", "line")
    sections = rows.groupBy("site", "section").agg(F.count("*").alias("n")).join(section_order(rows), ["site", "section"])

    def fixed(df: DataFrame, section_ord, lines) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(n).cast("bigint").alias("link_ord") if isinstance(n, int) else n.alias("link_ord"),
                                   (F.lit(x) if isinstance(x, str) else x).alias("line")) for n, x in lines])
        return df.select("site", section_ord.alias("section_ord"), F.explode(cells).alias("x")).select(
            "site", "section_ord", "x.link_ord", "x.line")

    name = U.site_name("site")
    quote = F.concat(F.lit("> Site map of "), F.col("site_name"), F.lit(" ("), F.col("base_url"),
                     F.lit("), auto-generated for LLM context."))
    seeds = rows.select("site").distinct().select("site", F.col("site").alias("base_url"), name.alias("site_name"))
    head = fixed(seeds, F.lit(0).cast("bigint"), [(0, F.concat(F.lit("# "), F.col("site_name"))), (1, ""), (2, quote), (3, "")])
    around = fixed(sections, F.col("section_ord"), [
        (-1, F.concat(F.lit("## "), F.col("label"))), (0, ""), (F.col("n") + 1, "")])
    return links.unionByName(head).unionByName(around)


def render_documents(ranked: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """One markdown document per site, gathered per section, then per site."""
    rows = section_rows(ranked)
    sections = rows.groupBy("site", "section", "label").agg(
        F.array_sort(F.collect_list(F.struct(F.length("url").alias("n"), F.col("rank"), F.col("line")))).alias("ls"),
        F.count("*").alias("n_pages"),
    ).select(
        "site", "section", "n_pages",
        F.concat(F.lit("## "), F.col("label"), F.lit("\n\n"),
                 F.array_join(F.transform("ls", lambda x: F.concat(x["line"], F.lit("\n"))), ""),
                 F.lit("\n")).alias("text"),
    )
    per_site = sections.groupBy("site").agg(
        F.array_sort(F.collect_list(F.struct(
            (F.col("section") != U.HOME_SECTION).alias("k"), F.col("section"), F.col("text")))).alias("ss"),
        F.sum("n_pages").alias("n_pages"),
        F.count("*").alias("n_sections"),
    )
    header = F.concat(
        F.lit("# "), F.col("site_name"), F.lit("\n\n> Site map of "), F.col("site_name"),
        F.lit(" ("), F.col("base_url"), F.lit("), auto-generated for LLM context.\n\n"))
    if seeds is None:  # default seed per site, derived in place (no second pass)
        per_site = per_site.select("*", F.col("site").alias("base_url"), U.site_name("site").alias("site_name"))
    else:
        per_site = per_site.join(seeds.select("site", "base_url", "site_name"), "site")
    return per_site.select(
        "site", "base_url", "site_name",
        F.col("n_pages").cast("bigint").alias("n_pages"),
        F.col("n_sections").cast("bigint").alias("n_sections"),
        F.concat(header, F.array_join(F.transform("ss", lambda x: x["text"]), "")).alias("doc"),
    )
