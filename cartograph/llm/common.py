"""Helpers that several operators share: scratch tables, document keys, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.session import ensure_checkpoint_dir, prepare_session

WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Written tables in the shared checkpoint folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        prepare_session(spark)
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Collect garbage on the driver, so that Spark's cleaner deletes shuffle files that no live plan needs."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The test fold: crc32 of the id as text leaves 0 modulo 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than space and U+0009-U+000D (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def word_count_sql(text: str) -> str:
    """DuckDB twin of ``n_words``."""
    return f"coalesce(len(regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')), 0)"


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", name: str = "cc") -> DataFrame:
    """Connected components of an undirected edge table: (node, component = smallest node).

    Alternates large-star and small-star steps until the edge set is stable.
    Every step is one pre-aggregated minimum per node and one join, both on
    edges only; each round's edges are written, so lineage stays short. A node
    with very many neighbours is pre-aggregated in the minimum, and its side of
    the join can be split by adaptive execution. Self-loops are ignored; nodes
    without another neighbour are not returned.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def digest(e: DataFrame):
        h = F.xxhash64("u", "v").cast("decimal(38,0)")
        return tuple(e.agg(F.count(F.lit(1)), F.sum(h)).first())

    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .where(F.col("u") != F.col("v")).distinct())
    e = scratch.write(e, f"{name}-0")
    seen, k = digest(e), 0
    while True:
        # large star: every larger neighbour of u is tied to u's smallest neighbour
        sym = both(e)
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (sym.where(F.col("v") > F.col("u")).join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: u and its smaller neighbours are tied to the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u")
                 .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.*").where(F.col("u") != F.col("v")).distinct())
        k += 1
        new = scratch.write(small, f"{name}-{k}")
        now = digest(new)
        scratch.drop(f"{name}-{k - 1}")
        e = new
        if now == seen:
            break
        seen = now
    # stable: every edge points at its component's smallest node
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
