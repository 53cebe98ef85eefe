"""The last value above a row, without putting a key's rows in one task.

``last(value) IGNORE NULLS OVER (PARTITION BY key ORDER BY n)`` sends every
row of a key to one task. Here a key is cut into bins of its row numbers: a
window sees one bin, and what a bin inherits from the bins above it comes from
a table with one row per (key, bin).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 4096      # row numbers in a bin


def carry_last(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], above: bool = False,
               width: int = BIN) -> DataFrame:
    """Add, for every name in ``values``, the last value that is not null at or above the row (``above``: strictly above).

    ``order`` is a whole number, unique within a key; gaps are allowed. Keys
    and ``order`` may not be null. A row without such a value gets null. ``df``
    is read twice: write it first if it is costly.
    """
    rows = df.withColumn("_bin", F.floor(F.col(order) / width)).select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    inside = (Window.partitionBy(*keys, "_bin").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, -1 if above else 0))
    higher = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, "_bin").agg(*[
        F.max(F.when(F.col(f"_v_{n}").isNotNull(), F.struct(order, f"_v_{n}")))[f"_v_{n}"].alias(f"_e_{n}") for n in values])
    # only bins below the first inherit anything
    inherited = ends.select(*keys, "_bin", *[F.last(f"_e_{n}", ignorenulls=True).over(higher).alias(f"_i_{n}") for n in values])
    local = rows.select(*df.columns, "_bin", *[F.last(f"_v_{n}", ignorenulls=True).over(inside).alias(f"_l_{n}") for n in values])
    return local.join(inherited, [*keys, "_bin"], "left").select(
        *df.columns, *[F.coalesce(f"_l_{n}", f"_i_{n}").alias(n) for n in values])
