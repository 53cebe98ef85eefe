"""Named queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Each reads the driver tables under ``sf_dir`` (or what Spark derives from
them) and runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.functions import urls as U
from cartograph.operators import sitemap as SM
from cartograph.sources import fixtures as FX
from cartograph.sources import pages as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_index(P.read_table(spark, sf_dir, "pages"))


@query("page_titles")
def page_titles(spark, sf_dir):
    return _index(spark, sf_dir).select("page_id", "url", "site", "title_state", "title")


@query("page_links")
def page_links(spark, sf_dir):
    return P.page_links(_index(spark, sf_dir)).select("site", "src_url", "pos", "href", "dst_url")


@query("links_in_scope")
def links_in_scope(spark, sf_dir):
    """F2-F4 per site: links, links in the site's prefix scope, excluded by suffix."""
    links = P.page_links(_index(spark, sf_dir))
    scope = U.in_scope("dst_url", "site")
    excl = U.excluded_suffix("dst_url")
    return links.groupBy("site").agg(
        F.count("*").alias("n_links"),
        F.count_if(scope).alias("n_in_scope"),
        F.count_if(excl).alias("n_excluded"),
        F.count_if(scope & ~excl).alias("n_followable"),
    )


@query("site_names")
def site_names(spark, sf_dir):
    return SM.site_seeds(SM.corpus_ranked(_index(spark, sf_dir)))


@query("section_counts")
def section_counts(spark, sf_dir):
    return SM.section_counts(SM.corpus_ranked(_index(spark, sf_dir))) \
        .withColumn("n_pages", F.col("n_pages").cast("bigint"))


@query("sitemap_links_ordered")
def sitemap_links_ordered(spark, sf_dir):
    return SM.ordered_links(SM.corpus_ranked(_index(spark, sf_dir))).select(
        "site", "section", F.col("section_ord").cast("bigint").alias("section_ord"),
        F.col("link_ord").cast("bigint").alias("link_ord"), "url", "line")


@query("sitemap_lines")
def sitemap_lines(spark, sf_dir):
    """R1 as ordered line rows: every site's whole map, whatever its size."""
    return SM.map_lines(SM.corpus_ranked(_index(spark, sf_dir)))


@query("sitemap_documents")
def sitemap_documents(spark, sf_dir):
    return SM.render_documents(SM.corpus_ranked(_index(spark, sf_dir)))


def _kept_pages(index):
    return index.filter(F.col("title_state").isin("ok", "absent") & (F.col("site") != ""))


def _site_pages(spark, sf_dir):
    """Kept pages with their 0-based order r inside the site (by page_id)."""
    from cartograph.operators.numbering import row_number_by
    kept = _kept_pages(_index(spark, sf_dir)).select("site", "url", "title", "page_id")
    return row_number_by(kept, "site", ["page_id"], "r").withColumn("r", F.col("r") - 1)


def _tree_bfs(spark, sf_dir, max_pages_col):
    from cartograph.operators import traverse as TR
    pages = _site_pages(spark, sf_dir).checkpoint(eager=True)  # read by the graph build and the seeds
    graph = TR.build_graph(pages.select("url", "title"), FX.derived_tree_links(pages))
    seeds = pages.filter(F.col("r") == 0).select(
        "site", F.col("site").alias("base_url"), F.col("url").alias("start_url"),
        max_pages_col.alias("max_pages"))
    return TR.bounded_bfs(graph, seeds)


@query("bfs_pages")
def bfs_pages(spark, sf_dir):
    """T1 on the derived tree per site with the default limit of 150 pages."""
    return _tree_bfs(spark, sf_dir, F.lit(SM.DEFAULT_MAX_PAGES))


@query("bfs_limit_per_site")
def bfs_limit_per_site(spark, sf_dir):
    """T1 with a different small limit per site: 1 + length(site) % 4."""
    return _tree_bfs(spark, sf_dir, 1 + F.length("site") % 4)


@query("bfs_captured_links")
def bfs_captured_links(spark, sf_dir):
    """T1 over the links extracted from the captured HTML, one seed per site."""
    from cartograph.operators import traverse as TR
    ix = _index(spark, sf_dir).checkpoint(eager=True)  # extracted once; read for nodes, links and seeds
    graph = TR.graph_from_index(ix, P.page_links(ix))
    first = _kept_pages(ix).groupBy("site").agg(F.min(F.struct("page_id", "url")).alias("p"))
    seeds = first.select("site", F.col("site").alias("base_url"), F.col("p.url").alias("start_url"),
                         F.lit(SM.DEFAULT_MAX_PAGES).alias("max_pages"))
    return TR.bounded_bfs(graph, seeds)


@query("bfs_planted_links")
def bfs_planted_links(spark, sf_dir):
    """T1 over links extracted from HTML into which links between captured pages are planted.

    The links lead back, to the page itself, to files with excluded suffixes,
    to other sites and to pages whose fetch failed; one site has one seed.
    """
    from cartograph.operators import traverse as TR
    ranked = _site_pages(spark, sf_dir).checkpoint(eager=True)      # extracted once; read for both ends of the links
    pages = FX.planted_links(ranked, P.read_table(spark, sf_dir, "pages")).checkpoint(eager=True)
    ix = P.page_index(pages).checkpoint(eager=True)  # extracted once; read for nodes, links and seeds
    graph = TR.graph_from_index(ix, P.page_links(ix))
    first = _kept_pages(ix).groupBy("site").agg(F.min_by("url", "page_id").alias("start_url"))
    seeds = first.select("site", F.col("site").alias("base_url"), "start_url", F.lit(SM.DEFAULT_MAX_PAGES).alias("max_pages"))
    return TR.bounded_bfs(graph, seeds)


def _spread(lines, keys):
    """Lines dealt by document and line number: a large site's lines are worked on in many tasks from here on."""
    return lines.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "line_no")


def _map_lines(spark, sf_dir):
    from cartograph.operators import conform as C
    docs = SM.render_documents(SM.corpus_ranked(_index(spark, sf_dir)))
    variants = FX.planted_variants(docs)
    return C.line_table(variants, ["site", "variant"])


@query("map_line_table")
def map_line_table(spark, sf_dir):
    return _map_lines(spark, sf_dir).select(
        "site", "variant", F.col("line_no").cast("int").alias("line_no"), "kind", "section", "title", "url",
        "description")


@query("map_conformance")
def map_conformance(spark, sf_dir):
    from cartograph.operators import conform as C
    return C.conformance(_map_lines(spark, sf_dir), ["site", "variant"])


@query("map_lines_conformance")
def map_lines_conformance(spark, sf_dir):
    """C1-C6, C9 over the generated maps as line rows: no document string, no task with a whole site."""
    from cartograph.operators import conform as C
    from cartograph.operators.numbering import row_number_by
    rows = SM.map_lines(SM.corpus_ranked(_index(spark, sf_dir))).checkpoint(eager=True)
    numbered = row_number_by(rows, "site", ["section_ord", "link_ord"], "line_no")
    return C.conformance(C.lines_of_rows(numbered.checkpoint(eager=True), ["site"]), ["site"])


@query("map_url_preservation")
def map_url_preservation(spark, sf_dir):
    """Each planted variant against the generated map of its site.

    The line table feeds three branches, so it is checkpointed once instead
    of re-running extraction and rendering per branch.
    """
    from cartograph.operators import conform as C
    lines = _map_lines(spark, sf_dir).checkpoint(eager=True)
    source = (lines.filter(F.col("variant") == "basic").select("site", "kind", "url")
              .join(lines.select("site", "variant").distinct(), "site"))
    return C.url_preservation(source, lines, ["site", "variant"])


@query("map_exact_duplicates")
def map_exact_duplicates(spark, sf_dir):
    from cartograph.operators import conform as C
    return C.exact_duplicates(_map_lines(spark, sf_dir), ["site", "variant"])


@query("map_near_duplicates")
def map_near_duplicates(spark, sf_dir):
    from cartograph.operators import conform as C
    return C.near_duplicates(_map_lines(spark, sf_dir), ["site", "variant"])


def _judge(spark, sf_dir):
    from cartograph.operators import experiment as X
    return X.parse_judge(FX.judge_raw(P.read_table(spark, sf_dir, "events")))


@query("judge_parse")
def judge_parse(spark, sf_dir):
    return _judge(spark, sf_dir)


@query("judge_failures")
def judge_failures(spark, sf_dir):
    from cartograph.operators import experiment as X
    return X.judge_failures(_judge(spark, sf_dir))


@query("criterion_means")
def criterion_means(spark, sf_dir):
    from cartograph.operators import experiment as X
    return X.criterion_means(_judge(spark, sf_dir))


@query("overall_improvement")
def overall_improvement(spark, sf_dir):
    from cartograph.operators import experiment as X
    return X.overall_improvement(_judge(spark, sf_dir))


@query("query_deltas")
def query_deltas(spark, sf_dir):
    from cartograph.operators import experiment as X
    return X.query_deltas(_judge(spark, sf_dir))


@query("pooled_means")
def pooled_means(spark, sf_dir):
    from cartograph.operators import experiment as X
    return X.pooled_means(_judge(spark, sf_dir))


@query("fact_coverage")
def fact_coverage(spark, sf_dir):
    """K1 pairs: documents as responses, benchmark items as key facts."""
    from cartograph.operators import coverage as K
    return K.covered_facts(P.read_table(spark, sf_dir, "documents"), P.read_table(spark, sf_dir, "benchmark"))


@query("response_coverage")
def response_coverage(spark, sf_dir):
    from cartograph.operators import coverage as K
    return K.response_coverage(P.read_table(spark, sf_dir, "documents"), P.read_table(spark, sf_dir, "benchmark"))


@query("signal_counts")
def signal_counts(spark, sf_dir):
    from cartograph.operators import coverage as K
    return K.signal_counts(P.read_table(spark, sf_dir, "documents"))


def _contexts(spark, sf_dir):
    """Per run: its first system turn as the full document, else its index document.

    Every conversation is a run, and so is every document (the index document
    of the run with its id).
    """
    from cartograph.operators import experiment as X
    conv = P.read_table(spark, sf_dir, "conversations")
    runs = conv.groupBy(F.col("conv_id").alias("run_id")).agg(
        F.min(F.when(F.col("role") == "system", F.struct("turn", "text")))["text"].alias("full"))
    index = P.read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), F.col("text").alias("idx"))
    return X.choose_context(runs, index)


@query("context_choice")
def context_choice(spark, sf_dir):
    """S2/S3 per run: system turn as the full document, else the run's index document."""
    return _contexts(spark, sf_dir).select("run_id", "kind", "n_chars")


@query("arm_prompts")
def arm_prompts(spark, sf_dir):
    from cartograph.operators import experiment as X
    qa = X.qa_pairs(P.read_table(spark, sf_dir, "conversations"))
    return X.arm_prompts(qa, _contexts(spark, sf_dir))


def _judge_items(spark, sf_dir):
    """Query items from conversations: key facts = non-empty lines of the answer;
    responses: baseline = the answer, enhanced = the run's context document."""
    from cartograph.operators import experiment as X
    qa = X.qa_pairs(P.read_table(spark, sf_dir, "conversations"))
    ctx = _contexts(spark, sf_dir).select("run_id", "context")
    facts = F.filter(F.split(F.coalesce("answer", F.lit("")), "\n", -1), lambda x: x != "")
    return qa.join(ctx, "run_id", "left").select(
        "run_id", "query_id", "query", facts.alias("key_facts"),
        F.coalesce("answer", F.lit("")).alias("baseline"), F.coalesce("context", F.lit("")).alias("enhanced"))


@query("judge_prompts")
def judge_prompts(spark, sf_dir):
    from cartograph.operators import experiment as X
    return X.judge_prompts(_judge_items(spark, sf_dir))


@query("generated_queries_parse")
def generated_queries_parse(spark, sf_dir):
    """P12 + S4 shape: question lists in model replies -> query items."""
    from cartograph.functions import jsonparse as J
    raw = FX.querygen_raw(P.read_table(spark, sf_dir, "events"))
    parsed = J.with_parsed_query_items(raw, "raw")
    # posexplode_outer + a filter on the generated column: a plain posexplode
    # makes Catalyst infer a not-null filter on ``items`` and push it below
    # the parse projections, which would re-run the parse per reference.
    exploded = parsed.select("reply_id", "run_id", F.posexplode_outer("items").alias("item_pos", "it"))
    return exploded.filter(F.col("it").isNotNull()).select(
        "reply_id", "run_id", "item_pos", F.col("it.query").alias("query"),
        F.coalesce("it.category", F.lit("general")).alias("category"),
        F.array_join("it.key_facts", " | ").alias("key_facts_text"),
        F.size("it.key_facts").alias("n_key_facts"))


@query("batch_infer")
def batch_infer(spark, sf_dir):
    """X1 over the judge prompts with the deterministic stand-in model."""
    from cartograph.operators import infer as XI
    prompts = judge_prompts(spark, sf_dir)
    return XI.batch_infer(prompts, FX.length_model, ["run_id", "query_id"])


def _report_inputs(spark, sf_dir):
    from cartograph.operators import experiment as X
    ev = P.read_table(spark, sf_dir, "events")
    # parsed once, in as many tasks as there are cores however few splits the file has; read for the means and the queries
    parsed = X.parse_judge(FX.judge_raw(ev.repartition("user_id", "event_id"))).checkpoint(eager=True)
    items = ev.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("query_id"),
                      F.concat(F.lit("What did event "), F.col("event_id").cast("string"), F.lit(" record?")).alias("query"),
                      F.col("props").alias("baseline"),
                      F.concat(F.lit("Event of type "), F.col("event_type"), F.lit(" with value "),
                               F.col("value").cast("string")).alias("enhanced"))
    return parsed, X.results(items, parsed)


@query("report_lines")
def report_lines(spark, sf_dir):
    """R2 + R3 as ordered line rows per run (text rounding: see README)."""
    from cartograph.operators import report as R
    parsed, results = _report_inputs(spark, sf_dir)
    return R.report_lines(parsed, results).select(
        "run_id", "block", F.col("query_no").cast("bigint").alias("query_no"), "line_no", "line")


@query("map_unfence")
def map_unfence(spark, sf_dir):
    """P10 on all planted map variants."""
    from cartograph.functions import text as T
    docs = SM.render_documents(SM.corpus_ranked(_index(spark, sf_dir)))
    return FX.planted_variants(docs).select("site", "variant", T.strip_code_fence("doc").alias("doc"))


@query("rewrite_prompts")
def rewrite_prompts(spark, sf_dir):
    """The rewrite prompt for every generated site map."""
    from cartograph.functions import prompts as PR
    docs = SM.render_documents(SM.corpus_ranked(_index(spark, sf_dir)))
    return docs.select("site", PR.rewrite_prompt("doc", "site_name").alias("prompt"))


@query("query_gen_prompts")
def query_gen_prompts(spark, sf_dir):
    """The question-generation prompt for every document."""
    from cartograph.functions import prompts as PR
    return P.read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("run_id"), PR.query_gen_prompt(F.coalesce("text", F.lit(""))).alias("prompt"))


@query("query_limit")
def query_limit(spark, sf_dir):
    """O4 (--max-queries): the first 3 questions of every run by query_id."""
    from cartograph.operators import experiment as X
    qa = X.qa_pairs(P.read_table(spark, sf_dir, "conversations"))
    return X.limit_queries(qa, 3).select("run_id", "query_id", "query")


@query("sitemap_documents_full")
def sitemap_documents_full(spark, sf_dir):
    """The full map, every kept page of every site."""
    return SM.render_documents(SM.corpus_ranked(_index(spark, sf_dir)))


@query("bfs_sitemap_documents")
def bfs_sitemap_documents(spark, sf_dir):
    """The reference's pipeline end to end: traversal (T1) -> site map.

    On the derived tree the visit order is page_id order, so the result
    equals the captured-corpus site maps cut at the traversal's page limit.
    """
    return SM.render_documents(_tree_bfs(spark, sf_dir, F.lit(SM.DEFAULT_MAX_PAGES)))


@query("seed_prefix_scope")
def seed_prefix_scope(spark, sf_dir):
    """Pages per seed under the raw prefix scope and the authority scope.

    Seeds are the corpus sites (``scheme://authority``), so a seed such as
    http://a.example.co would also admit pages of http://a.example.com.
    """
    from cartograph.operators import traverse as TR
    ix = _index(spark, sf_dir).checkpoint(eager=True)
    pages = ix.select("url")
    seeds = ix.filter(F.col("site") != "").select("site", F.col("site").alias("base_url")).distinct()
    # the authority scope is the prefix scope with one more test on the row
    hits = TR.prefix_scope_join(pages, seeds).groupBy("site").agg(
        F.count("*").alias("n_prefix"), F.count_if(U.site_of("url") == U.site_of("base_url")).alias("n_authority"))
    return seeds.join(hits, "site", "left").select(
        "site", F.coalesce("n_prefix", F.lit(0)).alias("n_prefix"),
        F.coalesce("n_authority", F.lit(0)).alias("n_authority"))


@query("experiment_end_to_end")
def experiment_end_to_end(spark, sf_dir):
    """Questions -> arm prompts -> answers -> judge prompts -> replies -> scores -> A4/A5, with stand-in models."""
    from cartograph.operators import chains as CH
    from cartograph.operators import experiment as X
    qa = X.qa_pairs(P.read_table(spark, sf_dir, "conversations"))
    facts = F.filter(F.split(F.coalesce("answer", F.lit("")), "\n", -1), lambda x: x != "")
    queries = qa.select("run_id", "query_id", "query", F.lit(None).cast("string").alias("category"), facts.alias("key_facts"))
    parsed, _ = CH.run_experiment(queries, _contexts(spark, sf_dir), FX.answer_model, FX.judge_model)
    return X.overall_improvement(parsed)


@query("rewrite_end_to_end")
def rewrite_end_to_end(spark, sf_dir):
    """Site maps -> rewrite prompts -> model -> unfenced or basic map -> lost and invented URLs."""
    from cartograph.operators import chains as CH
    docs = SM.render_documents(SM.corpus_ranked(_index(spark, sf_dir))).checkpoint(eager=True)
    return CH.rewrite_preservation(docs, CH.rewrite_maps(docs, FX.rewrite_model))


@query("questions_end_to_end")
def questions_end_to_end(spark, sf_dir):
    """Documents -> question prompts -> model -> strict parse -> question items and reasons."""
    from cartograph.operators import chains as CH
    docs = P.read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), "text")
    return CH.generate_questions(docs, FX.question_model).select(
        "run_id", "item_pos", "query", "category", F.array_join("key_facts", " | ").alias("key_facts_text"), "reason")


@query("map_merged_duplicates")
def map_merged_duplicates(spark, sf_dir):
    """Every variant's lines with near-duplicate entries merged."""
    from cartograph.operators import conform as C
    return C.merge_duplicates(_map_lines(spark, sf_dir), ["site", "variant"]).select(
        "site", "variant", F.col("line_no").cast("int").alias("line_no"), "kind", "url", "description")


@query("map_similar_titles")
def map_similar_titles(spark, sf_dir):
    """C7 on titles, on the generated maps."""
    from cartograph.operators import conform as C
    docs = SM.render_documents(SM.corpus_ranked(_index(spark, sf_dir)))
    # rendered once; read for classes and members
    return C.similar_titles(_spread(C.line_table(docs, ["site"]), ["site"]).checkpoint(eager=True), ["site"])


@query("map_title_classes")
def map_title_classes(spark, sf_dir):
    """C7 on titles, on the generated maps: every entry's class of equal title words, and pairs of similar classes."""
    from cartograph.operators import conform as C
    docs = SM.render_documents(SM.corpus_ranked(_index(spark, sf_dir)))
    return C.similar_title_classes(_spread(C.line_table(docs, ["site"]), ["site"]).checkpoint(eager=True), ["site"])


@query("map_merged_similar")
def map_merged_similar(spark, sf_dir):
    """Every variant's lines with entries of one URL or of similar titles merged, chains of them too."""
    from cartograph.operators import conform as C
    # rendered once; read for entries, URLs and titles
    lines = _spread(_map_lines(spark, sf_dir), ["site", "variant"]).checkpoint(eager=True)
    return C.merge_similar(lines, ["site", "variant"]).select(
        "site", "variant", F.col("line_no").cast("int").alias("line_no"), "kind", "url", "description")


@query("dropped_pages")
def dropped_pages(spark, sf_dir):
    """captured pages that no site map holds, with the reason."""
    ix = _index(spark, sf_dir)
    bad_title = ~F.col("title_state").isin("ok", "absent")
    return ix.filter(bad_title | (F.col("site") == "")).select(
        "page_id", "url", F.when(bad_title, F.concat(F.lit("title_"), F.col("title_state"))).otherwise(F.lit("no_site")).alias("reason"))


@query("row_accounts")
def row_accounts(spark, sf_dir):
    """kept rows (reason null) and dropped rows by reason, of captures with planted faults and of judge replies."""
    from cartograph.operators import accounts as A
    pages = P.page_reasons(FX.faulty_captures(P.read_table(spark, sf_dir, "pages")))
    replies = _judge(spark, sf_dir).withColumn("reason", F.nullif(F.col("reason"), F.lit("ok")))
    return A.reason_counts(pages, "pages").unionByName(A.reason_counts(replies, "replies"))


@query("pages_with_status")
def pages_with_status(spark, sf_dir):
    """F1 on a derived status: every third page failed."""
    pages = P.read_table(spark, sf_dir, "pages").withColumn("status", F.when(F.col("page_id") % 3 == 0, 404).otherwise(200))
    return P.page_index(pages).select("page_id", "url")


def _scratch(spark, name):
    import uuid
    from cartograph.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


@query("io_site_maps")
def io_site_maps(spark, sf_dir):
    """S6 then S2: site maps written as files and read back as context documents."""
    from cartograph.sources import documents as SD
    from cartograph.sources import sinks as SK
    path = _scratch(spark, "io_site_maps")
    SK.write_site_maps(SM.render_documents(SM.corpus_ranked(_index(spark, sf_dir))), path)
    sites = spark.read.text(path, wholetext=True).select("site", F.col("value").alias("doc"))
    sizes = SD.read_context_documents(spark, f"{path}/*").select(F.col("text").alias("doc"), "n_chars").distinct()
    return sites.join(sizes, "doc").select("site", "doc", "n_chars")


@query("io_query_set")
def io_query_set(spark, sf_dir):
    """Benchmark items written as one query-set file and read back."""
    from cartograph.sources import documents as SD
    path = _scratch(spark, "io_query_set")
    item = F.struct(F.col("text").alias("query"), F.array(F.concat(F.lit("item "), F.col("item_id").cast("string"))).alias("key_facts"))
    (P.read_table(spark, sf_dir, "benchmark").agg(F.array_sort(F.collect_list(F.struct("item_id", item.alias("q")))).alias("all"))
     .select(F.to_json(F.transform("all", lambda x: x["q"])).alias("value")).write.text(path))
    return SD.read_query_set(spark, path).select("query_id", "query", "category", F.array_join("key_facts", "|").alias("facts"))


@query("io_reports")
def io_reports(spark, sf_dir):
    """One report file per run, read back."""
    from cartograph.operators import report as R
    path = _scratch(spark, "io_reports")
    R.write_reports(R.report_lines(*_report_inputs(spark, sf_dir)), path)
    return R.read_reports(spark, path)
