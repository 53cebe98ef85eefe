"""Bounded breadth-first traversal over a captured corpus, many sites at once.

The reference walks one site with a FIFO queue. Processed level by level the
queue order is ``(parent_rank, pos)``: the discovery rank of the page that
first enqueued a URL, then the link's position on that page. Per level:

    frontier -> scope check (F2) -> join corpus (J1; failures drop out)
    -> rank successes per site -> cut at max_pages (O3) -> links of accepted
    pages -> scope + suffix filters (F2-F4) -> first discovery per URL (W3)
    -> anti join with everything already enqueued (J2) -> next frontier

Two bucketed tables keep a level's shuffles to what is new in it. The graph is
written once, bucketed by URL, without links to pages that were not captured.
Everything ever enqueued is appended to a store bucketed by (site, url), a level
at a time. A level shuffles its frontier by URL, its hits by site and its
candidates by (site, url); graph and store are read in their buckets and never
move. Both are files in the shared checkpoint folder, so a lost executor
repeats tasks of one level.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartograph.functions import urls as U
from cartograph.session import ensure_checkpoint_dir


RANGES = 4096      # cuts of the byte order of URLs in the prefix join
STORE = ("site string, url string, level int, is_page boolean, base_url string, max_pages bigint, found bigint, "
         "parent_rank bigint, pos bigint, title string, rank bigint")


class Buckets:
    """A table of files in the checkpoint folder, bucketed by some columns."""

    def __init__(self, spark: SparkSession, name: str, keys: list[str]):
        self.spark, self.keys = spark, keys
        self.n = int(spark.conf.get("spark.sql.shuffle.partitions"))    # as many as a shuffle has, so joins need none
        self.table = f"{name}_{uuid.uuid4().hex[:12]}"
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{self.table}"

    def append(self, rows: DataFrame) -> None:
        """Add rows; they should be partitioned by the keys already, so that a task writes few buckets."""
        rows.write.mode("append").bucketBy(self.n, *self.keys).option("path", self.path).saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)


def build_graph(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(url, title, links array<string> in document order), bucketed by url.

    ``nodes``: (url, title) of pages whose fetch and title step succeeded.
    ``links``: (src_url, pos, dst_url). Links to other URLs are left out: such
    a URL is enqueued and fails, which changes neither order nor ranks.
    """
    spark = nodes.sparkSession
    known = nodes.select(F.col("url").alias("dst_url")).distinct()
    per_page = links.join(known, "dst_url", "left_semi").groupBy(F.col("src_url").alias("url")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst_url"))), lambda x: x["dst_url"]).alias("links"))
    graph = Buckets(spark, "graph", ["url"])
    graph.append(
        nodes.select("url", "title").join(per_page, "url", "left")
        .select("url", "title", F.coalesce("links", F.array().cast("array<string>")).alias("links"))
        .repartition(graph.n, "url"))
    return graph.read()


def expand(frontier: DataFrame, graph: DataFrame, seen: DataFrame, cap: int, scope: str) -> tuple[DataFrame, DataFrame]:
    """One level: (accepted pages, next frontier)."""
    by_site = Window.partitionBy("site")
    order = by_site.orderBy("parent_rank", "pos")
    frontier = frontier.select("site", "base_url", "max_pages", "found", "url", "parent_rank", "pos")
    hits = frontier.filter(U.in_scope("url", "base_url", scope)).join(graph, "url")
    accepted = (
        hits.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= cap)
        .withColumn("rank", F.col("found") + F.col("rn"))
        .filter(F.col("rank") <= F.col("max_pages"))
        .withColumn("found_after", F.max("rank").over(by_site))
    )
    cand = (
        accepted.filter(F.col("found_after") < F.col("max_pages"))
        .select("site", "base_url", "max_pages", F.col("found_after").alias("found"),
                F.col("rank").alias("parent_rank"), F.posexplode("links").alias("pos", "url"))
        .filter(U.in_scope("url", "base_url", scope) & ~U.excluded_suffix("url"))
    )
    first = cand.groupBy("site", "url").agg(
        F.min(F.struct(F.col("parent_rank"), F.col("pos").cast("bigint").alias("pos"),
                       "base_url", "max_pages", "found")).alias("m"))
    known = seen.select(F.col("site").alias("site"), F.col("url").alias("url"))
    nxt = (first.join(known, ["site", "url"], "left_anti")
           .select("site", "m.base_url", "m.max_pages", "m.found", "url", "m.parent_rank", "m.pos"))
    return accepted, nxt


def bounded_bfs(graph: DataFrame, seeds: DataFrame, max_levels: int | None = None,
                scope: str = "prefix") -> DataFrame:
    """Traverse every seed's site; returns (site, url, title, rank).

    ``seeds``: (site, base_url, max_pages) plus optional ``start_url``
    (defaults to ``base_url``, as in the reference). ``rank`` is the order
    of first successful discovery, 1-based; at most ``max_pages`` per site.
    """
    spark = graph.sparkSession
    ensure_checkpoint_dir(spark)
    if "start_url" not in seeds.columns:
        seeds = seeds.withColumn("start_url", F.col("base_url"))
    seeds = seeds.filter(F.col("max_pages") > 0)
    cap_row = seeds.agg(F.max("max_pages")).first()
    cap = int(cap_row[0]) if cap_row and cap_row[0] is not None else 0
    empty = spark.createDataFrame([], "site string, url string, title string, rank bigint")
    if cap <= 0:
        return empty

    store = Buckets(spark, "enqueued", ["site", "url"])

    def stored(rows: DataFrame, level: int, is_page: bool) -> DataFrame:
        given = {**{c: F.col(c) for c in rows.columns}, "level": F.lit(level), "is_page": F.lit(is_page)}
        return rows.select(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in (f.split() for f in STORE.split(", "))])

    start = seeds.select(
        "site", "base_url", F.col("max_pages").cast("bigint").alias("max_pages"),
        F.lit(0).cast("bigint").alias("found"), F.col("start_url").alias("url"),
        F.lit(0).cast("bigint").alias("parent_rank"), F.lit(0).cast("bigint").alias("pos"))
    store.append(stored(start, 0, False).repartition(store.n, "site", "url"))
    depth = 0
    while True:
        table = store.read()
        waiting = table.filter(~F.col("is_page"))
        accepted, nxt = expand(waiting.filter(F.col("level") == depth), graph, waiting, cap, scope)
        # one write a level: accepted pages and the next frontier
        store.append(stored(accepted.select("site", "url", "title", "rank"), depth, True).repartition(store.n, "site", "url")
                     .unionByName(stored(nxt, depth + 1, False)))
        depth += 1
        if (max_levels is not None and depth >= max_levels) or \
                store.read().filter(~F.col("is_page") & (F.col("level") == depth)).isEmpty():
            break
    pages = spark.read.schema(STORE).parquet(store.path).filter("is_page").select("site", "url", "title", "rank")
    spark.sql(f"DROP TABLE {store.table}")        # only the catalog entry: an external table's files stay
    return pages


def graph_from_index(index: DataFrame, links: DataFrame) -> DataFrame:
    """Graph over captured pages: kept pages with their resolved links."""
    nodes = index.filter(F.col("title_state").isin("ok", "absent")).select("url", "title")
    return build_graph(nodes, links.select("src_url", "pos", "dst_url"))


def _after(prefix: str) -> str | None:
    """The least string above everything that starts with ``prefix`` (None: there is none)."""
    while prefix:
        last = ord(prefix[-1])
        if last < 0x10FFFF:
            return prefix[:-1] + chr(0xE000 if last == 0xD7FF else last + 1)
        prefix = prefix[:-1]
    return None


def prefix_scope_join(pages: DataFrame, seeds: DataFrame, scope: str = "prefix") -> DataFrame:
    """J3 for many seeds: (site, base_url, url) for every page in a seed's scope.

    In the order of bytes, a seed is an interval: everything that starts with
    it. Pages are dealt to ranges of that order, cut at up to ``RANGES`` sample
    URLs, and a seed is copied to the ranges it reaches into. In a range, pages
    and seeds are walked once in order with a stack of the seeds still open,
    which are nested prefixes of one another. Work is the pages, the seeds'
    copies and the result, whatever the seeds' lengths and nesting.
    ``scope='authority'`` also requires the same ``scheme://authority`` (the
    equi form on the authority alone would drop prefix-only hits such as
    http://a.co -> http://a.com/x, which the reference admits). Null URLs and
    seeds match nothing. ``pages`` should have one row per URL, as the page
    index has: repeated rows are kept, but all rows of one URL share a range.
    """
    if scope not in ("prefix", "authority"):
        raise ValueError(f"unknown scope {scope!r}")
    urls = pages.select("url").filter("url IS NOT NULL")
    # the RANGES least hashes: a bounded sample, the same at every run
    cuts = sorted({r[0] for r in urls.select("url", F.xxhash64("url").alias("h")).orderBy("h").limit(RANGES).collect()})

    def dealt(batches):
        import bisect

        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([bisect.bisect_right(cuts, u) for u in b.column(0).to_pylist()], pa.int32())], names=["url", "part"])

    def copied(batches):
        import bisect

        import pyarrow as pa

        for b in batches:
            out = []
            for site, base in zip(*(b.column(k).to_pylist() for k in (0, 1))):
                end = _after(base)
                last = len(cuts) if end is None else bisect.bisect_left(cuts, end)
                out += [(site, base, k) for k in range(bisect.bisect_right(cuts, base), last + 1)]
            for lo in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[lo:lo + 10_000]), (pa.string(), pa.string(), pa.int32()))],
                                                 names=["site", "base_url", "part"])

    def walk(here, open_to):
        import pyarrow as pa

        given = sorted(zip(open_to.column("base_url").to_pylist(), open_to.column("site").to_pylist()), key=lambda x: x[0])
        stack, k, out = [], 0, []
        for url in sorted(here.column("url").to_pylist()) if given else ():
            while k < len(given) and given[k][0] <= url:
                while stack and not given[k][0].startswith(stack[-1][0]):
                    stack.pop()
                stack.append(given[k])
                k += 1
            while stack and not url.startswith(stack[-1][0]):
                stack.pop()
            out += [(site, base, url) for base, site in stack]
        return pa.table([pa.array(c, pa.string()) for c in (list(zip(*out)) or [[]] * 3)], names=["site", "base_url", "url"])

    at = urls.mapInArrow(dealt, "url string, part int")
    wanted = seeds.select(F.col("site").cast("string").alias("site"), "base_url").filter("base_url IS NOT NULL").mapInArrow(
        copied, "site string, base_url string, part int")
    out = at.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(walk, "site string, base_url string, url string")
    return out.filter(U.site_of("url") == U.site_of("base_url")) if scope == "authority" else out
