"""The three model chains end to end: experiment, site-map rewrite, generated questions.

The model is a batch function (X1). Each chain's model outputs are written
once; what fails on the way is kept with a reason (F5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.functions import jsonparse as J
from cartograph.functions import prompts as PR
from cartograph.functions import text as T
from cartograph.operators import conform as C
from cartograph.operators import experiment as X
from cartograph.operators.infer import InferFn, batch_infer


def run_experiment(queries: DataFrame, contexts: DataFrame, answer: InferFn, judge: InferFn,
                   ledger_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(parsed scores, results): arm prompts -> answers -> judge prompts -> replies -> scores.

    ``queries``: run_id, query_id, query, category, key_facts; ``contexts``:
    run_id, context. A query with a failed answer or judge call is kept in the
    parsed scores with the reason ``model_error``, without scores; ``error``
    says which calls failed and how, as ``call: message``. With ``ledger_path``
    a run that broke off goes on where it stopped.
    """
    ask = lambda prompts, fn, keys, call: batch_infer(
        prompts, fn, keys, ledger_path=ledger_path and f"{ledger_path}/{call}")
    answers = ask(X.arm_prompts(queries, contexts), answer, ["run_id", "query_id", "arm"], "answers")
    said = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.concat("arm", F.lit(": "), "error"))))
    both = answers.groupBy("run_id", "query_id").agg(*[
        F.max(F.when(F.col("arm") == a, F.col("response"))).alias(a) for a in PR.ARM_NAMES], said.alias("answer_errors"))
    answered = queries.join(both, ["run_id", "query_id"])
    items = answered.drop("answer_errors")
    complete = F.col("baseline").isNotNull() & F.col("enhanced").isNotNull()
    replies = ask(X.judge_prompts(items.filter(complete)), judge, ["run_id", "query_id"], "judge")
    judged = F.when(F.col("error").isNotNull(), F.array(F.concat(F.lit("judge: "), "error"))).otherwise(F.array().cast("array<string>"))
    errors = F.concat("answer_errors", judged)
    raw = answered.select("run_id", "query_id", "category", "answer_errors").join(replies, ["run_id", "query_id"], "left").select(
        "run_id", "query_id", "category", F.coalesce("response", F.lit("")).alias("raw"), F.col("response").isNull().alias("failed"),
        F.when(F.size(errors) > 0, F.array_join(errors, "; ")).alias("error"))
    parsed = X.parse_judge(raw.select("run_id", "query_id", "category", "raw")).join(
        raw.select("run_id", "query_id", "failed", "error"), ["run_id", "query_id"])
    parsed = parsed.withColumn("reason", F.when(F.col("failed"), F.lit("model_error")).otherwise(F.col("reason"))).drop("failed")
    return parsed, X.results(items, parsed)


def rewrite_maps(docs: DataFrame, rewrite: InferFn, ledger_path: str | None = None) -> DataFrame:
    """(site, source, doc): the unfenced rewrite of each map, or the basic map where the model failed."""
    prompts = docs.select("site", F.lit(None).cast("string").alias("system"),
                          PR.rewrite_prompt("doc", "site_name").alias("prompt"))
    replies = batch_infer(prompts, rewrite, ["site"], system_col=None, ledger_path=ledger_path)
    better = replies.select("site", T.strip_code_fence("response").alias("better"))
    return docs.select("site", "doc").join(better, "site", "left").select(
        "site", F.when(F.col("better").isNull(), F.lit("basic")).otherwise(F.lit("rewritten")).alias("source"),
        F.coalesce("better", "doc").alias("doc"))


def rewrite_preservation(docs: DataFrame, rewritten: DataFrame) -> DataFrame:
    """C8 per site between the basic maps and what is kept of the rewrite."""
    counts = C.url_preservation(C.line_table(docs.select("site", "doc"), ["site"]),
                                C.line_table(rewritten.select("site", "doc"), ["site"]), ["site"])
    return rewritten.select("site", "source").join(counts, "site")


def generate_questions(docs: DataFrame, ask: InferFn, key: str = "run_id", ledger_path: str | None = None) -> DataFrame:
    """(key, item_pos, query, category, key_facts, reason): question items, or one row with the reason there are none.

    ``docs``: key, text. Items without a query or key facts get a reason too.
    """
    prompts = docs.select(key, F.lit(PR.QUERY_GEN_SYSTEM).alias("system"),
                          PR.query_gen_prompt(F.coalesce("text", F.lit(""))).alias("prompt"))
    replies = batch_infer(prompts, ask, [key], ledger_path=ledger_path).select(key, "response", "error")
    parsed = J.with_parsed_query_items(replies.withColumn("raw", F.coalesce("response", F.lit(""))), "raw")
    why = F.when(F.col("error").isNotNull(), F.lit("model_error")).otherwise(F.col("reason"))
    rows = parsed.select(key, why.alias("why"), F.posexplode_outer("items").alias("item_pos", "it"))
    reason = (F.when(F.col("why") != "ok", F.col("why")).when(F.col("it").isNull(), F.lit("empty"))
              .when(F.col("it.query").isNull(), F.lit("no_query"))
              .when(F.col("it.key_facts").isNull(), F.lit("no_key_facts")).otherwise(F.lit("ok")))
    return rows.select(key, "item_pos", F.col("it.query").alias("query"),
                       F.when(F.col("it").isNotNull(), F.coalesce("it.category", F.lit(X.DEFAULT_CATEGORY))).alias("category"),
                       F.col("it.key_facts").alias("key_facts"), reason.alias("reason"))
