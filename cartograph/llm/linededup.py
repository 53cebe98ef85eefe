"""Line dedup over line-id sequences: distributed prefix doubling, DataFrame operations only.

A document is the sequence of ids of its lines; lines without any visible
character take no part and are always kept. Position (document, p) starts a
suffix. Level k gives every suffix the rank of its first 2^k lines among all
suffixes: level 0 ranks the lines themselves, level k + 1 ranks the pairs
(rank at p, rank at p + 2^k). Ranks keep the lexicographic order (pairs are
sorted globally and numbered along the sort), so equal ranks are exactly the
intervals of the suffix array whose longest common prefix is 2^k or more.
Suffixes alone in their interval cannot be in a longer one and are dropped, so
the work shrinks from level to level, and doubling goes on until no interval
holds two suffixes. A ``min_lines`` that is no power of two has a level of its
own, whose halves overlap; widths double from there.

In every interval whose common prefix has ``min_lines`` lines or more, the
earliest suffix (smallest document id, then position) stays and every other one
is a later copy of that many lines. Copies of all levels that overlap or touch
merge, per document and in order of position, into maximal repeated runs, and
the runs are deleted.

Hot lines: intervals are counted with partial aggregation, and only one row
per interval is joined back; adaptive execution can split the other side.
Shifted joins use (document, position) and have no hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartograph.llm.common import Scratch

MIN_LINES = 2
VISIBLE = r"[^\x20\x09-\x0D]"
LAST = 2**63 - 1        # a null id sorts after all others
KEY = ["d", "h"]        # document: id and text hash


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("*", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("d"), F.xxhash64("text").alias("h"))


def line_ids(docs: DataFrame) -> DataFrame:
    """(d, h, p, ln, id): visible lines in order; ``ln`` counts all lines from 0, ``p`` the visible ones."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(
        i.alias("ln"), F.when(x.rlike(VISIBLE), F.unhex(F.md5(x))).alias("id")))
    visible = F.filter(lines, lambda s: s["id"].isNotNull())
    return (_keyed(docs.select("doc_id", "text").where("text is not null")).select(*KEY, F.posexplode(visible))
            .select(*KEY, F.col("pos").alias("p"), "col.ln", "col.id").dropDuplicates([*KEY, "p"]))


def _ranks(rows: DataFrame, cols: list[str]) -> DataFrame:
    """One row per interval of two or more suffixes: its order-preserving rank and its earliest suffix."""
    groups = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, "p")).alias("first")).where("n > 1")
    return groups.orderBy(*cols).select(*cols, F.monotonically_increasing_id().alias("rank"), "first")


def _shifted(level: DataFrame, by: int) -> DataFrame:
    """Each suffix with the rank found ``by`` lines further on (both must be repeated)."""
    ahead = level.select(*KEY, (F.col("p") - by).alias("p"), F.col("rank").alias("r2"))
    return level.select(*KEY, "p", F.col("rank").alias("r1")).join(ahead, [*KEY, "p"])


def copied_prefixes(lines: DataFrame, scratch: Scratch, min_lines: int = MIN_LINES) -> DataFrame:
    """(d, h, p, width): suffixes whose first ``width`` lines also start earlier, for every level of ``min_lines`` lines or more."""
    names = scratch.write(_ranks(lines, ["id"]), "ranks-0")
    level, by = lines.join(names, "id"), "ranks-0"
    width, k, copies = 1, 0, []
    while True:
        later = F.struct(*KEY, "p") != F.col("first")
        level = scratch.write(level.select(*KEY, "p", "rank", later.alias("later")), f"level-{k}")
        scratch.drop(by)
        scratch.drop(f"pairs-{k - 1}")
        if width >= min_lines:
            copies.append(level.where("later").select(*KEY, "p", F.lit(width).alias("width")))
        # double; the step up to min_lines overlaps the two halves if it is no power of two
        step = min(width, min_lines - width) if width < min_lines else width
        pairs = scratch.write(_shifted(level, step), f"pairs-{k}")
        by = f"ranks-{k + 1}"
        names = scratch.write(_ranks(pairs, ["r1", "r2"]), by)
        width, k = width + step, k + 1
        if names.isEmpty():
            break
        level = pairs.join(names, ["r1", "r2"])
    return reduce(DataFrame.unionByName, copies) if copies else level.where("false").select(*KEY, "p", F.lit(0).alias("width"))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(d, h, first_line, n_lines): maximal stretches of lines to delete, lines counted from 0."""
    scratch = Scratch(docs.sparkSession, "linededup")
    lines = scratch.write(line_ids(docs), "lines")
    # merged along a document: a copy opens a run if no earlier one reaches it (its rows: one document's suffixes)
    copies = copied_prefixes(lines, scratch, min_lines).withColumn("end", F.col("p") + F.col("width"))
    order = Window.partitionBy(*KEY).orderBy("p", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = copies.withColumn("opens", reach.isNull() | (F.col("p") > reach))
    runs = opened.withColumn("run", F.count_if("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy(*KEY, "run").agg(F.min("p").alias("p"), F.max("end").alias("end"))
    gone = merged.select(*KEY, F.explode(F.sequence("p", F.col("end") - 1)).alias("p"))
    at = lines.select(*KEY, "p", "ln").join(gone, [*KEY, "p"], "left_semi")
    # neighbouring line numbers minus their order within the document are equal along a run
    each = at.groupBy(*KEY).agg(F.array_sort(F.collect_list("ln")).alias("ln"))    # bounded by one document's lines
    island = F.transform("ln", lambda x, i: F.struct((x - i).alias("g"), x.alias("ln")))
    return scratch.write(
        each.select(*KEY, F.explode(island).alias("x")).groupBy(*KEY, "x.g")
        .agg(F.min("x.ln").alias("first_line"), F.count(F.lit(1)).cast("int").alias("n_lines"))
        .select(*KEY, "first_line", "n_lines"), "runs")


def without_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """(row, n_lines, n_removed, kept): every row of ``docs`` as a struct, and its text without the runs' lines."""
    per_doc = runs.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("first_line", "n_lines"))).alias("runs"),
                                     F.sum("n_lines").alias("gone"))
    rows = docs.select(F.struct("*").alias("row")).select(
        "row", F.coalesce(F.col("row.doc_id").cast("bigint"), F.lit(LAST)).alias("d"), F.xxhash64("row.text").alias("h"))
    lines, spans = F.col("lines"), F.col("runs")
    # what is kept lies between the runs: before the first, between neighbours, after the last
    start = lambda i: F.when(i == 0, 0).otherwise(spans[i - 1]["first_line"] + spans[i - 1]["n_lines"])
    end = lambda i: F.when(i == F.size(spans), F.size(lines)).otherwise(spans[i]["first_line"])
    between = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.slice(lines, start(i) + 1, end(i) - start(i)))
    # a merge join at every size: what it would broadcast grows with the documents
    return (rows.join(per_doc.hint("merge"), KEY, "left").withColumn("lines", F.split("row.text", "\n", -1))
            .select("row", F.when(F.col("row.text").isNull(), 0).otherwise(F.size("lines")).cast("bigint").alias("n_lines"),
                    F.coalesce("gone", F.lit(0)).cast("bigint").alias("n_removed"),
                    F.when(F.col("gone").isNull(), F.col("row.text"))
                    .otherwise(F.array_join(F.flatten(between), "\n")).alias("kept")))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with every later copy of a repeated run deleted from ``text``; all rows and columns stay.

    A run is at least ``min_lines`` visible lines; blank lines are kept and do
    not interrupt a run. Null texts stay null; a text whose lines all go
    becomes empty. Earlier means a smaller doc_id (null last; rows with one id
    and different texts in the order of their text hash), then an earlier
    line. Rows with the same id and text are one document and get the same
    result. An empty table gives no rows. ``n_chars``, if it is a column of
    whole numbers, is counted again where lines went; other columns are
    carried over.
    """
    cols = []
    for name, kind in docs.dtypes:
        old = F.col("row")[name]
        if name == "text":
            old = F.col("kept")
        elif name == "n_chars" and kind in ("bigint", "int"):
            old = F.when(F.col("n_removed") > 0, F.length("kept").cast(kind)).otherwise(old)
        cols.append(old.alias(name))
    return without_runs(docs, repeated_runs(docs, min_lines)).select(*cols)


def digest(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Per document: lines, lines removed, checksum of the text that is left (null counts as empty)."""
    out = without_runs(docs, repeated_runs(docs, min_lines))
    return out.select("row.doc_id", "n_lines", "n_removed", F.md5(F.coalesce("kept", F.lit(""))).alias("kept_md5"))


ORACLE = """
WITH docs AS (SELECT DISTINCT doc_id, text, md5(text) AS h FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, h, unnest(range(len(string_split(text, chr(10))))) AS ln,
                 unnest(string_split(text, chr(10))) AS line FROM docs),
visible AS (SELECT *, lead(line) OVER w AS line2, lead(ln) OVER w AS ln2,
                   row_number() OVER w AS p
            FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
            WINDOW w AS (PARTITION BY doc_id, h ORDER BY ln)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id NULLS LAST, h, p) AS nth
           FROM visible WHERE ln2 IS NOT NULL),
gone AS (SELECT doc_id, h, ln FROM ranked WHERE nth > 1 UNION SELECT doc_id, h, ln2 FROM ranked WHERE nth > 1),
kept AS (SELECT l.doc_id, l.h, count(*) AS n_lines, count(g.ln) AS n_removed,
                coalesce(string_agg(CASE WHEN g.ln IS NULL THEN l.line END, chr(10) ORDER BY l.ln), '') AS text
         FROM lines l LEFT JOIN gone g ON g.doc_id IS NOT DISTINCT FROM l.doc_id AND g.h = l.h AND g.ln = l.ln
         GROUP BY ALL)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       md5(coalesce(k.text, '')) AS kept_md5
FROM documents d LEFT JOIN kept k ON k.doc_id IS NOT DISTINCT FROM d.doc_id AND k.h = md5(d.text)
"""
