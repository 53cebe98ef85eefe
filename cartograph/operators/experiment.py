"""Context experiment: arms, judge parsing, score aggregation.

Every aggregate is grouped by ``run_id`` with partial aggregation, so one run
holding most of the rows is pre-aggregated in every map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from cartograph.functions import jsonparse as J

DEFAULT_CATEGORY = "general"  # fixed value: P13


def parse_judge(raw: DataFrame) -> DataFrame:
    """(run_id, query_id, category, reason, 8 scores, notes); scores only when valid."""
    p = raw.select("run_id", "query_id", F.coalesce("category", F.lit(DEFAULT_CATEGORY)).alias("category"), "raw")
    return J.with_parsed_scores(p, "raw").drop("raw")


def valid(parsed: DataFrame) -> DataFrame:
    """Valid results only.

    Written as an explode of a zero- or one-element array rather than a
    Filter: Catalyst would push a Filter below the parse projections and
    evaluate the whole parse once per reference in the predicate.
    """
    row = F.struct(*[F.col(c) for c in parsed.columns])
    keep = F.when(F.col("reason") == "ok", F.array(row)).otherwise(F.array().cast(ArrayType(row_type(parsed))))
    return parsed.select(F.explode(keep).alias("_v")).select("_v.*")


def row_type(df: DataFrame):
    from pyspark.sql.types import StructType
    return StructType(df.schema.fields)


def scores_long(parsed: DataFrame) -> DataFrame:
    """(run_id, query_id, arm, criterion, score) for valid results."""
    cells = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(c).alias("criterion"),
                               F.col(f"{a[0]}_{c}").alias("score")) for a in J.ARMS for c in J.CRITERIA])
    return valid(parsed).select("run_id", "query_id", F.explode(cells).alias("x")) \
        .select("run_id", "query_id", "x.arm", "x.criterion", "x.score")


def criterion_means(parsed: DataFrame) -> DataFrame:
    """A3: per run and criterion, mean per arm over queries and the delta.

    Eight sums per run first; only their results are turned into rows.
    """
    sums = valid(parsed).groupBy("run_id").agg(
        F.count("*").alias("n"), *[F.sum(f"{a[0]}_{c}").alias(f"{a[0]}_{c}") for a in J.ARMS for c in J.CRITERIA])
    b, e = ("x.b", "x.e")
    rows = sums.select("run_id", "n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("criterion"), (F.col(f"b_{c}") / F.col("n")).alias("b"),
                 (F.col(f"e_{c}") / F.col("n")).alias("e")) for c in J.CRITERIA])).alias("x"))
    return rows.select("run_id", "x.criterion", "n", F.col(b).alias("baseline_mean"), F.col(e).alias("enhanced_mean"),
                       (F.col(e) - F.col(b)).alias("delta"))


def _sum_arm(arm: str):
    return sum((F.col(f"{arm[0]}_{c}") for c in J.CRITERIA[1:]), F.col(f"{arm[0]}_{J.CRITERIA[0]}"))


def overall_improvement(parsed: DataFrame) -> DataFrame:
    """A4/A5: mean of the criterion means per arm (= total / 4n) and percent change."""
    g = valid(parsed).groupBy("run_id").agg(
        F.count("*").alias("n_queries"),
        F.sum(_sum_arm("baseline")).alias("tb"), F.sum(_sum_arm("enhanced")).alias("te"))
    k = len(J.CRITERIA)
    b, e = F.col("tb") / (F.col("n_queries") * k), F.col("te") / (F.col("n_queries") * k)
    return g.select("run_id", "n_queries", b.alias("overall_baseline"), e.alias("overall_enhanced"),
                    (e - b).alias("overall_delta"),
                    F.when(b > 0, (e - b) / b * 100).alias("improvement_pct"))


def query_deltas(parsed: DataFrame) -> DataFrame:
    """Per query, mean of the four criteria per arm, delta, per-criterion deltas."""
    k = float(len(J.CRITERIA))
    b, e = _sum_arm("baseline") / k, _sum_arm("enhanced") / k
    return valid(parsed).select(
        "run_id", "query_id", "category", b.alias("baseline_mean"), e.alias("enhanced_mean"),
        (e - b).alias("delta"),
        *[(F.col(f"e_{c}") - F.col(f"b_{c}")).alias(f"d_{c}") for c in J.CRITERIA])


def pooled_means(parsed: DataFrame) -> DataFrame:
    """Pooled mean over all cells, console percent (0 when the baseline is 0),
    tested and dropped counts."""
    ok = F.col("reason") == "ok"
    g = parsed.groupBy("run_id").agg(
        F.count("*").alias("n_input"), F.count_if(ok).alias("n_tested"),
        F.sum(F.when(ok, _sum_arm("baseline"))).alias("tb"), F.sum(F.when(ok, _sum_arm("enhanced"))).alias("te"))
    cells = F.col("n_tested") * len(J.CRITERIA)
    b, e = F.col("tb") / cells, F.col("te") / cells
    return g.select("run_id", "n_input", "n_tested", (F.col("n_input") - F.col("n_tested")).alias("n_dropped"),
                    b.alias("pooled_baseline"), e.alias("pooled_enhanced"),
                    F.when(b > 0, (e - b) / b * 100).otherwise(F.lit(0.0)).alias("console_pct"))


def judge_failures(parsed: DataFrame) -> DataFrame:
    """dropped items per run and reason."""
    return parsed.groupBy("run_id", "reason").agg(F.count("*").alias("n"))


# --- inputs and prompts (S3, J4, P15, P16, W2, O4) ---------------------------

TURNS_PER_BUCKET = 1024


def qa_pairs(conversations: DataFrame) -> DataFrame:
    """(run_id, query_id, query, answer): each user turn with the next assistant turn.

    Paired by role, not turn parity (some conversations open with a system
    turn). Windows see turns in buckets of ``TURNS_PER_BUCKET``, so one huge
    conversation spreads over many tasks; a question whose answer lies in a
    later bucket gets it from a table with one row per bucket. Only numbers
    go through the windows; the answer's text is joined at the end.
    """
    narrow = conversations.select("conv_id", "turn", "role", F.floor(F.col("turn") / TURNS_PER_BUCKET).alias("_b"))
    said = F.when(F.col("role") == "assistant", F.col("turn"))
    ahead = Window.partitionBy("conv_id", "_b").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    later = Window.partitionBy("conv_id").orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    users = narrow.withColumn("_near", F.min(said).over(ahead)).filter(F.col("role") == "user")
    buckets = narrow.groupBy("conv_id", "_b").agg(F.min(said).alias("_first"))
    buckets = buckets.select("conv_id", "_b", F.min("_first").over(later).alias("_far"))
    paired = users.join(buckets, ["conv_id", "_b"]).select(
        "conv_id", "turn", F.coalesce("_near", "_far").alias("_answer"))
    asked = conversations.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    answers = conversations.filter(F.col("role") == "assistant").select(
        "conv_id", F.col("turn").alias("_answer"), F.col("text").alias("answer"))
    return (asked.join(paired, ["conv_id", "turn"]).join(answers, ["conv_id", "_answer"], "left")
            .select(F.col("conv_id").alias("run_id"), F.col("turn").alias("query_id"), "query", "answer"))


def choose_context(runs: DataFrame, index: DataFrame) -> DataFrame:
    """S3: the full document when given and present, else the index document.

    ``runs``: (run_id, full) with ``full`` NULL when not given; ``index``:
    (run_id, idx). A run may be in either or both. Returns (run_id, kind,
    context, n_chars).
    """
    j = runs.join(index, "run_id", "full_outer")
    ctx = F.coalesce("full", "idx")
    return j.select(
        "run_id",
        F.when(F.col("full").isNotNull(), F.lit("full")).otherwise(F.lit("index")).alias("kind"),
        ctx.alias("context"), F.length(ctx).cast("bigint").alias("n_chars"))


def limit_queries(queries: DataFrame, n: int | None) -> DataFrame:
    """First ``n`` queries per run by query_id; ``None`` or 0 keeps all."""
    if not n:
        return queries
    if n < 0:
        raise ValueError("a negative query limit is not supported")
    w = Window.partitionBy("run_id").orderBy("query_id")
    return queries.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def arm_prompts(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """J4 + P15: every query in both arms with the run's context (joined on run_id).

    The two arms are generated per row, not joined.
    """
    from cartograph.functions import prompts as PR
    q = queries.join(contexts.select("run_id", "context"), "run_id", "left")
    return q.select("run_id", "query_id", F.explode(F.array(*[F.lit(a) for a in PR.ARM_NAMES])).alias("arm"),
                    "query", F.coalesce("context", F.lit("")).alias("context")) \
        .select("run_id", "query_id", "arm", PR.arm_system("arm", "context").alias("system"),
                F.col("query").alias("prompt"))


def judge_prompts(items: DataFrame) -> DataFrame:
    """(run_id, query_id, system, prompt) from query, key_facts, baseline, enhanced."""
    from cartograph.functions import prompts as PR
    return items.select("run_id", "query_id", F.lit(PR.JUDGE_SYSTEM).alias("system"),
                        PR.judge_prompt("query", "key_facts", "baseline", "enhanced").alias("prompt"))


def results(items: DataFrame, parsed: DataFrame) -> DataFrame:
    """Query item x responses x valid scores on (run_id, query_id); a failure on
    any side drops the query. The category is the parsed one."""
    return items.drop("category").join(valid(parsed), ["run_id", "query_id"], "inner")
