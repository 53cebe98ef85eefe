"""Batch inference through a user-supplied function, one row out per prompt.

``fn(prompts: list[str], systems: list[str] | None) -> list[str]`` is called
on Arrow batches inside ``mapInPandas``. If a call raises, the batch is
halved until the error stands on the row that caused it (F5).

Replies go to a ledger, a folder of Parquet files with one row per prompt that
was answered, keyed by a hash of prompt, system text and model name. Prompts
are distinct before the model sees them, and those in the ledger are left out.
The rest is dealt to micro-batches by that hash, and every micro-batch is
committed by itself, so a run that breaks off has lost at most one: the next
run calls the model for uncommitted prompts only. Failed prompts are not
entered and are called again by the next run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.session import ensure_checkpoint_dir

InferFn = Callable[[list, "list | None"], list]

LEDGER = "prompt_key string, response string"
MICRO_BATCH = 200_000      # prompts committed together


def prompt_key(prompt_col: str, system_col: str | None, model: str) -> F.Column:
    """SHA-256 of model name, prompt and system text, null apart from empty."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    return F.sha2(F.concat(F.lit(f"{len(model)}:{model}"), part(prompt_col), part(system_col) if system_col else F.lit("-")), 256)


class Ledger:
    """Committed replies in one folder, a sub-folder per commit."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[str]:
        """Folders whose write ended; a commit that broke off has no success marker."""
        path, fs = self._fs()
        if not fs.exists(path):
            return []
        mark = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().toString() for s in fs.listStatus(path) if s.isDirectory()]
        return sorted(n for n in names if fs.exists(mark(f"{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        """(prompt_key, response), one row per key."""
        done = self.commits()
        if not done:
            return self.spark.createDataFrame([], LEDGER)
        return (self.spark.read.schema(LEDGER).parquet(*done).filter("response IS NOT NULL")
                .groupBy("prompt_key").agg(F.min("response").alias("response")))

    def commit(self, rows: DataFrame) -> str:
        """Write (prompt_key, response, error) rows as one commit; replies and errors are in the folder returned."""
        folder = f"{self.path}/commit-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return folder


def caller(fn: InferFn, batch_size: int):
    """mapInPandas function over (prompt_key, prompt, system): (prompt_key, response, error)."""
    def call(prompts, systems):
        """Responses and errors of a batch; a batch that fails is halved until the failing rows stand alone."""
        try:
            out = list(fn(prompts, systems))
            if len(out) != len(prompts):
                raise ValueError("batch function returned a different number of rows")
            return [None if r is None else str(r) for r in out], [None] * len(out)
        except Exception as e:  # noqa: BLE001 - isolate the failing rows
            if len(prompts) == 1:
                return [None], [f"{type(e).__name__}: {e}"]
            half = len(prompts) // 2
            parts = [call(prompts[lo:hi], systems and systems[lo:hi]) for lo, hi in ((0, half), (half, None))]
            return [x for p in parts for x in p[0]], [x for p in parts for x in p[1]]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size]
                systems = part["system"].tolist() if "system" in part else None
                out, err = call(part["prompt"].tolist(), systems)
                yield pd.DataFrame({"prompt_key": part["prompt_key"].tolist(), "response": out, "error": err})

    return run


def batch_infer(df: DataFrame, fn: InferFn, keys: list[str], prompt_col: str = "prompt",
                system_col: str | None = "system", batch_size: int = 32, output_path: str | None = None,
                ledger_path: str | None = None, model: str = "", micro_batch: int = MICRO_BATCH) -> DataFrame:
    """Returns (keys..., response, error); exactly one row per input row.

    With ``ledger_path`` (a shared folder) replies of earlier runs with the
    same ``model`` name are used; without it the ledger lasts for this call
    alone. Equal prompts are answered once. Within a micro-batch, a task that
    is retried before its commit calls the model again for its own rows.
    ``output_path`` also writes the result there.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/batch_infer/{uuid.uuid4().hex}"
    ledger = Ledger(spark, ledger_path or f"{folder}/ledger")
    cols = [F.col(prompt_col).alias("prompt")] + ([F.col(system_col).alias("system")] if system_col else [])
    keyed = df.select(*keys, *cols, prompt_key(prompt_col, system_col, model).alias("prompt_key"))
    # the prompts of this call are written once: whatever made them is not run again per micro-batch
    keyed.write.parquet(f"{folder}/prompts")
    prompts = spark.read.schema(keyed.schema).parquet(f"{folder}/prompts")
    distinct = prompts.select("prompt_key", "prompt", *(["system"] if system_col else [])).dropDuplicates(["prompt_key"])
    n = max(1, -(-prompts.count() // micro_batch))
    todo = distinct.join(ledger.read(), "prompt_key", "left_anti").withColumn("part", F.pmod(F.xxhash64("prompt_key"), F.lit(n)))
    todo.write.partitionBy("part").parquet(f"{folder}/todo")
    todo = spark.read.schema(todo.schema).parquet(f"{folder}/todo")
    own = []
    for k in range(n):
        own.append(ledger.commit(todo.filter(F.col("part") == k).drop("part").mapInPandas(
            caller(fn, batch_size), "prompt_key string, response string, error string").filter("response IS NOT NULL OR error IS NOT NULL")))
    failed = spark.read.schema(f"{LEDGER}, error string").parquet(*own).filter("error IS NOT NULL").select("prompt_key", "error")
    result = (prompts.select(*keys, "prompt_key").join(ledger.read(), "prompt_key", "left")
              .join(failed, "prompt_key", "left").select(*keys, "response", "error"))
    if output_path is None:
        return result
    result.write.mode("overwrite").parquet(output_path)
    return spark.read.schema(result.schema).parquet(output_path)
