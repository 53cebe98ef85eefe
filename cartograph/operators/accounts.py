"""Row accounts (F5): what came in is what was kept plus what was left out, by reason.

A table of judged rows has a ``reason`` column, null for a row that is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observe_reasons(df: DataFrame, name: str, reason: Column | str = "reason") -> tuple[DataFrame, Observation]:
    """``df`` with two counts taken while it runs: ``n_input`` and ``n_kept``; read them from the Observation after an action."""
    seen = Observation(name)
    reason = F.col(reason) if isinstance(reason, str) else reason
    return df.observe(seen, F.count(F.lit(1)).alias("n_input"), F.count_if(reason.isNull()).alias("n_kept")), seen


def reason_counts(df: DataFrame, step: str, reason: Column | str = "reason") -> DataFrame:
    """(step, reason, n_rows): kept rows under a null reason."""
    reason = F.col(reason) if isinstance(reason, str) else reason
    return df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(step).alias("step"), "reason", "n_rows")
