"""Lenient extraction, strict parsing of model replies.

The reference takes the first fenced block if any, slices from the first
opening to the last closing bracket and parses strictly; any failure drops
the item. Here every step is a column expression; failures become a
``reason`` instead of an exception (F5).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import PY_WS_CLASS, col

# --- fixed values -----------------------------------------------------------
FENCE_PATTERN = rf"(?s)```(?:json)?{PY_WS_CLASS}*(.*?)```"
CRITERIA = ["accuracy", "completeness", "specificity", "actionability"]
ARMS = ["baseline", "enhanced"]
# ---------------------------------------------------------------------------

ARM_SCHEMA = ", ".join(f"{c} DOUBLE" for c in CRITERIA) + ", notes STRING"
SCORES_SCHEMA = ", ".join(f"{a} STRUCT<{ARM_SCHEMA}>" for a in ARMS)
QUERY_ITEM_SCHEMA = "query STRING, category STRING, key_facts ARRAY<STRING>"
JSON_OPTIONS = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def unfence(raw) -> Column:
    raw = col(raw)
    return F.when(raw.rlike(FENCE_PATTERN), F.regexp_extract(raw, FENCE_PATTERN, 1)).otherwise(raw)


def bracket_slice(s, open_ch: str, close_ch: str) -> Column:
    """Text from the first ``open_ch`` to the last ``close_ch``; unchanged if either is missing."""
    s = col(s)
    start = F.instr(s, open_ch)
    rpos = F.instr(F.reverse(s), close_ch)
    end = F.length(s) - rpos + 1
    return (F.when((start == 0) | (rpos == 0), s)
            .when(end >= start, F.substring(s, start, end - start + 1))
            .otherwise(F.lit("")))


def has_brackets(s, open_ch: str, close_ch: str) -> Column:
    s = col(s)
    return (F.instr(s, open_ch) > 0) & (F.instr(s, close_ch) > 0)


def single_value(s) -> Column:
    """True when the text is one JSON value with nothing after it, as deep and with numbers as long as the engine's parser takes.

    The text is parsed strictly inside an array and inside an object: two
    values, a stray bracket or trailing text break one of the two. Unlike
    Python's ``json``, ``NaN`` and objects that repeat a key are rejected.
    """
    s = col(s)
    listed = F.try_parse_json(F.concat(F.lit("["), s, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), s, F.lit("}")))
    return listed.isNotNull() & member.isNotNull()


def with_parsed_scores(df: DataFrame, raw: str) -> DataFrame:
    """Add ``reason`` and, for valid replies, ``b_*``/``e_*`` scores and notes.

    Staged projections keep the parse from being re-evaluated per output
    column.
    """
    df = df.withColumn("_s1", unfence(raw))
    df = df.withColumn("_s2", bracket_slice("_s1", "{", "}"))
    df = df.select("*", F.from_json("_s2", SCORES_SCHEMA, JSON_OPTIONS).alias("_p"),
                   has_brackets("_s1", "{", "}").alias("_has"),
                   (F.json_object_keys("_s2").isNotNull() & single_value("_s2")).alias("_strict"))
    all_numbers = F.lit(True)
    for a in ARMS:
        for c in CRITERIA:
            all_numbers = all_numbers & F.col(f"_p.{a}.{c}").isNotNull()
    reason = (F.when(~F.col("_has"), F.lit("no_object"))
              .when(~F.col("_strict"), F.lit("not_strict_json"))
              .when(~all_numbers, F.lit("bad_scores"))
              .otherwise(F.lit("ok")))
    df = df.withColumn("reason", reason)
    ok = F.col("reason") == "ok"
    cols = [F.when(ok, F.col(f"_p.{a}.{c}")).alias(f"{a[0]}_{c}") for a in ARMS for c in CRITERIA]
    notes = [F.when(ok, F.col(f"_p.{a}.notes")).alias(f"{a[0]}_notes") for a in ARMS]
    return df.select("*", *cols, *notes).drop("_s1", "_s2", "_p", "_has", "_strict")


def with_parsed_query_items(df: DataFrame, raw: str) -> DataFrame:
    """Add ``reason`` and ``items ARRAY<STRUCT<query, category, key_facts>>``."""
    df = df.withColumn("_s1", unfence(raw))
    df = df.withColumn("_s2", bracket_slice("_s1", "[", "]"))
    df = df.select("*", F.from_json("_s2", f"ARRAY<STRUCT<{QUERY_ITEM_SCHEMA}>>", JSON_OPTIONS).alias("_items"),
                   has_brackets("_s1", "[", "]").alias("_has"), single_value("_s2").alias("_strict"))
    reason = (F.when(~F.col("_has"), F.lit("no_array"))
              .when(~F.col("_strict") | F.col("_items").isNull(), F.lit("not_strict_json"))
              .otherwise(F.lit("ok")))
    df = df.withColumn("reason", reason)
    return df.withColumn("items", F.when(F.col("reason") == "ok", F.col("_items"))) \
        .drop("_s1", "_s2", "_items", "_has", "_strict")
