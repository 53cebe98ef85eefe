"""Context documents and query sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.functions.jsonparse import QUERY_ITEM_SCHEMA


def read_context_documents(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Each file as one UTF-8 string: (path, text, n_chars)."""
    df = spark.read.text(paths, wholetext=True)
    return df.select(F.input_file_name().alias("path"), F.col("value").alias("text"),
                     F.length("value").cast("bigint").alias("n_chars"))


def read_query_set(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array file of {query, category, key_facts} objects.

    Rows keep the file order as ``query_id`` (0-based); a missing category
    becomes ``general`` (P13). An item without ``query`` or ``key_facts`` is
    not a question: see ``read_query_errors``.
    """
    items = _query_items(spark, path)
    return items.filter(F.col("reason").isNull()).select(
        "query_id", "query", F.coalesce("category", F.lit("general")).alias("category"), "key_facts")


def read_query_errors(spark: SparkSession, path: str) -> DataFrame:
    """F5 for S4: (query_id, reason) of the items that ``read_query_set`` leaves out."""
    return _query_items(spark, path).filter(F.col("reason").isNotNull()).select("query_id", "reason")


def _query_items(spark: SparkSession, path: str) -> DataFrame:
    # the file is one JSON value, so it is one row until its array is exploded with positions
    text = spark.read.text(path, wholetext=True)
    items = text.select(F.posexplode(F.from_json("value", f"array<struct<{QUERY_ITEM_SCHEMA}>>")).alias("query_id", "it"))
    reason = F.when(F.col("it.query").isNull(), F.lit("no_query")).when(F.col("it.key_facts").isNull(), F.lit("no_key_facts"))
    return items.select(F.col("query_id").cast("bigint").alias("query_id"), "it.*", reason.alias("reason"))
