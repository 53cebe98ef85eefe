"""Site-map sinks (S6, S7): one UTF-8 document per site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_site_maps(docs: DataFrame, path: str, enhanced: DataFrame | None = None) -> None:
    """Write ``site=<site>/part-*.txt``; a failed rewrite falls back to the basic map.

    ``docs``: (site, doc); ``enhanced``: optional (site, doc) from a rewrite
    step (NULL doc = failed).
    """
    out = docs.select("site", F.col("doc").alias("basic"))
    if enhanced is not None:
        out = out.join(enhanced.select("site", F.col("doc").alias("enh")), "site", "left") \
            .select("site", F.coalesce("enh", "basic").alias("basic"))
    # the text writer ends every row with "\n": drop one final newline first
    value = F.when(F.col("basic").endswith("\n"), F.expr("substring(basic, 1, length(basic) - 1)")) \
        .otherwise(F.col("basic"))
    (out.repartition("site").select("site", value.alias("value"))
     .write.mode("overwrite").partitionBy("site").text(path))


def write_full_maps(docs: DataFrame, path: str) -> None:
    """The full map. The reference writes the same pages a second time;
    pass a traversal run with a higher ``max_pages`` for a truly fuller map."""
    write_site_maps(docs, path)


def write_map_lines(lines: DataFrame, path: str) -> None:
    """S6 for sites of any size: ``site=<site>/part-*`` hold a site's lines in order, files in file order."""
    order = ["site", "section_ord", "link_ord"]
    (lines.repartitionByRange(*order).sortWithinPartitions(*order)
     .select("site", "line").write.mode("overwrite").partitionBy("site").text(path))
