"""Row numbers per key without putting a key's rows in one task.

``row_number() OVER (PARTITION BY key ORDER BY ...)`` sends every row of a
key to one task. Here only (key, order) are range-partitioned, so a hot key
spans many partitions; each partition numbers its own rows of a key, and the
rows of the same key in earlier partitions are added from a table with one
row per (partition, key). Other columns are joined back by (key, order).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartograph.session import ensure_checkpoint_dir


def row_number_by(df: DataFrame, key: str | list[str], order: list[str], out: str = "row_no",
                  num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based position of the row within its ``key`` by ``order``.

    ``order`` must be unique within a key (as for a deterministic row_number),
    and neither may be null.
    """
    spark = df.sparkSession
    keys = [key] if isinstance(key, str) else key
    cols = [*keys, *order]
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written once: the range bounds come from sampling and must not be drawn twice
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/row_numbers/{uuid.uuid4().hex}"
    narrow = df.select(*cols)
    narrow.repartitionByRange(n, *cols).withColumn("_pid", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.schema(narrow.withColumn("_pid", F.lit(0)).schema).parquet(path)
    local = F.row_number().over(Window.partitionBy(*keys, "_pid").orderBy(*order))
    pieces = ranged.groupBy("_pid", *keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("_pid", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    numbers = (ranged.withColumn("_local", local).join(offsets, ["_pid", *keys])
               .select(*cols, (F.col("_off") + F.col("_local")).alias(out)))
    return df.join(numbers, cols)
