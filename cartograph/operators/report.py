"""Report rendering (R2, R3) as ordered line rows, and their text sink.

A run's report is never gathered into one string: it is a set of
(run_id, block, query_no, line_no, line) rows that the sink writes in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from cartograph.functions import text as T
from cartograph.functions.jsonparse import CRITERIA
from cartograph.operators.numbering import row_number_by

# --- fixed values -----------------------------------------------------------
SUMMARY_HEADER = [
    "## Summary Scores (1-10 scale)",
    "",
    "| Criterion | Baseline (no context) | With llms.txt | Improvement |",
    "|-----------|----------------------|---------------|-------------|",
]
OVERALL_LABEL = "**Overall**"
IMPROVEMENT_PREFIX, IMPROVEMENT_SUFFIX = "**Overall improvement: ", "%**"
QUERY_PREFIX, CATEGORY_PREFIX, CATEGORY_SUFFIX = "### Query ", "*Category: ", "*"
BASELINE_NOTE, ENHANCED_NOTE = "**Baseline note:** ", "**Enhanced note:** "
DETAILS_OPEN = ["<details>", "<summary>Response excerpts (click to expand)</summary>"]
BASELINE_LABEL, ENHANCED_LABEL = "**Baseline response:**", "**Enhanced response (with llms.txt):**"
DETAILS_CLOSE = "</details>"
NULL_RUN = "__HIVE_DEFAULT_PARTITION__"      # as Spark names a partition of null
REPORT_FILE = "part-00000.txt"
QUERY_TABLE_HEADER = ["| Criterion | Baseline | Enhanced | Delta |", "|-----------|----------|----------|-------|"]
# ---------------------------------------------------------------------------


def _lines(*items):
    """array of (line_no, line) structs from columns/strings, in order."""
    return F.array(*[F.struct(F.lit(i).alias("line_no"), (F.lit(x) if isinstance(x, str) else x).alias("line"))
                     for i, x in enumerate(items)])


def _num(x):
    """Python's str() of a JSON score: integers without a fraction."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def summary_lines(parsed: DataFrame) -> DataFrame:
    """R2 per run: criterion rows, the bold overall row, the improvement line."""
    from cartograph.operators import experiment as X
    cm = X.criterion_means(parsed)
    ov = X.overall_improvement(parsed)
    order = {c: i for i, c in enumerate(CRITERIA)}
    crit_ord = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])[F.col("criterion")]
    rows = cm.select("run_id", F.lit(1).alias("block"), F.lit(0).alias("query_no"),
                     (crit_ord + len(SUMMARY_HEADER)).alias("line_no"),
                     F.concat(F.lit("| "), T.py_capitalize("criterion"), F.lit(" | "),
                              T.number_text("baseline_mean"), F.lit(" | "),
                              T.number_text("enhanced_mean"), F.lit(" | "),
                              T.signed("delta"), F.lit(" |")).alias("line"))
    head = ov.select("run_id", F.posexplode(F.array(*[F.lit(h) for h in SUMMARY_HEADER])).alias("line_no", "line")) \
        .select("run_id", F.lit(1).alias("block"), F.lit(0).alias("query_no"), "line_no", "line")
    n = len(SUMMARY_HEADER) + len(CRITERIA)
    tail = ov.select("run_id", F.explode(_lines(
        F.concat(F.lit(f"| {OVERALL_LABEL} | **"), T.number_text("overall_baseline"), F.lit("** | **"),
                 T.number_text("overall_enhanced"), F.lit("** | **"), T.signed("overall_delta"),
                 F.lit("** |")),
        "",
        F.when(F.col("improvement_pct").isNotNull(),
               F.concat(F.lit(IMPROVEMENT_PREFIX), T.number_text("improvement_pct", T.SIGNED_WHOLE),
                        F.lit(IMPROVEMENT_SUFFIX))),
        "")).alias("x")).filter(F.col("x.line").isNotNull()) \
        .select("run_id", F.lit(1).alias("block"), F.lit(0).alias("query_no"),
                (F.col("x.line_no") + n).alias("line_no"), F.col("x.line").alias("line"))
    return head.unionByName(rows).unionByName(tail)


def query_lines(results: DataFrame) -> DataFrame:
    """R3 per valid query: heading, category, delta table, notes, excerpts.

    ``results``: run_id, query_id, query, category, baseline, enhanced and
    the parsed b_*/e_* scores and notes.
    """
    # W2 without a per-run window: a run with most of the rows still spreads
    r = row_number_by(results, "run_id", ["query_id"], out="query_no")
    crit = []
    for c in CRITERIA:
        b, e = F.col(f"b_{c}"), F.col(f"e_{c}")
        d = e - b
        crit.append(F.concat(F.lit(f"| {c.capitalize()} | "), _num(b), F.lit(" | "), _num(e), F.lit(" | "),
                             F.when(d > 0, F.lit("+")).otherwise(F.lit("")), _num(d), F.lit(" |")))
    note = lambda arm, label: F.when(F.coalesce(F.col(f"{arm}_notes"), F.lit("")) != "",
                                     F.concat(F.lit(label), F.col(f"{arm}_notes")))
    block = _lines(
        F.concat(F.lit(QUERY_PREFIX), F.col("query_no").cast("string"), F.lit(": "), F.col("query")),
        F.concat(F.lit(CATEGORY_PREFIX), F.col("category"), F.lit(CATEGORY_SUFFIX)),
        "", *QUERY_TABLE_HEADER, *crit, "",
        note("b", BASELINE_NOTE), note("e", ENHANCED_NOTE), "",
        *DETAILS_OPEN, "",
        BASELINE_LABEL, F.concat(F.lit("> "), T.excerpt("baseline")), "",
        ENHANCED_LABEL, F.concat(F.lit("> "), T.excerpt("enhanced")), "",
        DETAILS_CLOSE, "",
    )
    return r.select("run_id", F.lit(2).alias("block"), "query_no", F.explode(block).alias("x")) \
        .filter(F.col("x.line").isNotNull()) \
        .select("run_id", "block", "query_no", F.col("x.line_no").alias("line_no"), F.col("x.line").alias("line"))


def report_lines(parsed: DataFrame, results: DataFrame) -> DataFrame:
    return summary_lines(parsed).unionByName(query_lines(results))


def _store(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop sees them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_reports(lines: DataFrame, path: str) -> None:
    """One text report per run (``run_id=<id>/part-*``), lines in order.

    Without its native library, Hadoop's local file system starts a process
    for every folder, file and checksum it makes, which is most of the time of
    many small reports. In a plain folder each task therefore writes the files
    of its runs itself, under a hidden name until they are whole; a task that
    is tried again writes the same files. Other stores, and ids that are not
    integers, are written by Spark's text sink.
    """
    spark = lines.sparkSession
    order = ["run_id", "block", "query_no", "line_no"]
    ordered = lines.repartition("run_id").sortWithinPartitions(*order)
    at, store = _store(spark, path)
    if store.getUri().getScheme() != "file" or not isinstance(lines.schema["run_id"].dataType, IntegralType):
        ordered.select("run_id", "line").write.mode("overwrite").partitionBy("run_id").text(path)
        return
    store.delete(at, True)
    store.mkdirs(at)
    folder = at.toUri().getPath()

    def run(batches):
        import os

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        hidden, written = f"_part-{TaskContext.get().taskAttemptId()}", 0
        name, out = None, None

        def close():
            out.close()
            os.replace(out.name, os.path.join(os.path.dirname(out.name), REPORT_FILE))

        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            if not len(names):
                continue
            new = pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False)
            start = np.flatnonzero(np.concatenate(([True], new))).tolist()
            for a, z in zip(start, [*start[1:], len(names)]):
                if (this := names[a].as_py()) != name:      # a run may go on from the batch before
                    if out:
                        close()
                    name, written = this, written + 1
                    os.makedirs(f"{folder}/run_id={name}", exist_ok=True)
                    out = open(f"{folder}/run_id={name}/{hidden}", "w", encoding="utf-8", newline="")
                out.write("".join(texts.slice(a, z - a).to_pylist()))
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["n"])

    (ordered.select(F.coalesce(F.col("run_id").cast("string"), F.lit(NULL_RUN)).alias("run"),
                    F.concat(F.coalesce("line", F.lit("")), F.lit("\n")).alias("line"))
     .mapInArrow(run, "n bigint").agg(F.sum("n")).collect())
    store.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS"), True).close()


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, report): the files of ``write_reports``, each whole.

    Spark lists up to 10,000 folders with one task each; a few tasks a core list the same ones.
    """
    tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(tasks)
    spark.conf.set(tasks, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        files = spark.read.schema("value string, run_id long").text(path, wholetext=True)       # lists the folders
    finally:
        spark.conf.set(tasks, before)
    return files.select("run_id", F.col("value").alias("report"))
