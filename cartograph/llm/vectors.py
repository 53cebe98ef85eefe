"""Embedding columns: which rows take part, and Arrow lists as matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """True for vectors that are not null, not zero, and hold only finite numbers."""
    finite = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def common_width(df: DataFrame, vec: str) -> int:
    """The most frequent length among usable vectors (ties: the smaller); 0 if there are none."""
    top = (df.where(usable(F.col(vec))).groupBy(F.size(vec).alias("n")).agg(F.count(F.lit(1)).alias("c"))
           .orderBy(F.desc("c"), "n").limit(1).collect())
    return int(top[0]["n"]) if top else 0


def matrix(column, width: int):
    """Arrow list column (no nulls) as a float64 matrix."""
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def runs(*keys):
    """Start positions of runs of equal keys, plus the end."""
    import numpy as np

    n = len(keys[0])
    change = np.zeros(max(n - 1, 0), bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1, [n])).astype(np.int64) if n else np.zeros(1, np.int64)


def by_group(batches, n_keys: int):
    """Regroup sorted Arrow batches so that all rows of a key (first ``n_keys`` columns) come together.

    Yields record batches that end at a change of key; only the last key's rows
    are held back.
    """
    import pyarrow as pa

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        at = runs(*(table.column(i).to_numpy() for i in range(n_keys)))
        cut = int(at[-2])
        if cut:
            yield table.slice(0, cut).combine_chunks().to_batches()[0]
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks().to_batches()[0]
