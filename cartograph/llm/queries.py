"""Registered queries of the operators, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartograph.llm import (alignment, ann, linededup, merkle, mixing, packing, pitmanyor, quality, simhash, substring,
                            tokencounts, toxicity, vectordedup)
from cartograph.llm.common import read_table
from cartograph.session import prepare_session


def _on_documents(fn):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare_session(spark)
        return fn(read_table(spark, sf_dir, "documents"))
    return query


def _on_embeddings(fn):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare_session(spark)
        return fn(read_table(spark, sf_dir, "embeddings"))
    return query


def _on_labelled(fn):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare_session(spark)
        return fn(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return query


QUERIES = {
    "op1_quality_classifier": _on_labelled(quality.classify),
    "op2_best_fit_packing": _on_documents(packing.packed_pieces),
    "op3_line_dedup": _on_documents(linededup.digest),
    "op4_nearest_neighbours": _on_embeddings(ann.digest),
    "op5_mixing": _on_documents(mixing.digest),
    "op6_token_counts": _on_documents(tokencounts.maintained),
    "op7_embedding_near_dedup": _on_embeddings(vectordedup.digest),
    "op8_simhash_near_dedup": _on_documents(simhash.digest),
    "op9_toxicity": _on_labelled(toxicity.classify),
    "op10_substring_dedup": _on_documents(substring.digest),
    "op11_language_scores": _on_documents(pitmanyor.language_scores),
    "op12_cross_tokenizer_alignment": _on_documents(alignment.align),
    "op13_merkle_manifest": _on_documents(merkle.digest),
}

ORACLE: dict[str, str] = {
    "op3_line_dedup": linededup.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
